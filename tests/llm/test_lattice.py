"""Lattice scores against the sum over listed segmentations, base scores against counting."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import lattice
from tests.llm.test_dedup import frame, hostile, lowered

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def listed(word, own, logp):
    """Probability of a word and expected uses of pieces, every segmentation written out."""
    text = "▁" + word
    total, uses = 0.0, Counter()
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, begin = [], 0
        for k, cut in enumerate([*cuts, 1]):
            if cut:
                parts.append(text[begin : k + 1])
                begin = k + 1
        p = 1.0
        for part in parts:
            if part in own.names:
                p *= math.exp(logp[own.names.index(part)])
            elif len(part) == 1:
                p *= math.exp(logp[len(own.names)]) ** len(part.encode())
            else:
                p = 0.0
        total += p
        for part in parts:
            uses[part] += p
    return total, {k: v / total for k, v in uses.items()}


def test_recursions_equal_listing():
    rng = random.Random(1)
    own = lattice.Lattice({p: -float(k) for k, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "bab", "▁ab", "é", "aéb"])})
    logp = own.fitted(np.array([rng.random() * 50 for _ in own.names]), 3.0)
    assert math.isclose(np.exp(logp[:-2]).sum() + 256 * math.exp(logp[-2]) + math.exp(logp[-1]), 1.0)
    words = ["", "a", "zz", "é中", *["".join(rng.choice("abéz") for _ in range(rng.randint(1, 9))) for _ in range(60)]]
    got = own.scores(words, logp)
    weights = np.array([rng.randint(1, 5) for _ in words], float)
    uses = own.expected(words, weights, logp)
    want = Counter()
    for w, g, weight in zip(words, got, weights):
        p, by_piece = listed(w, own, logp)
        assert math.isclose(g, math.log(p), rel_tol=1e-9)
        for piece, n in by_piece.items():
            want[piece] += n * weight
    assert np.allclose(uses, [want[p] for p in own.names])


def test_long_words_stay_finite():
    with open(MODEL, "rb") as f:
        own = lattice.Lattice.of_model(f.read())
    found = own.scores(["a" * 20_000, "a"], own.first_guess())
    assert np.isfinite(found).all() and found[0] < found[1]


@pytest.mark.parametrize("block", [lattice.BLOCK_TOKENS, 50])
def test_documents(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK_TOKENS", block)
    rows = [r for r in hostile(4)]
    docs = frame(spark, rows)
    train = F.col("doc_id") % 3 != 0
    got = lattice.lm_score(docs, train, MODEL).collect()
    assert len(got) == len(rows)
    used = [lowered(t).split() for i, t in rows if i is not None and i % 3 != 0]
    counts = Counter(w for words in used for w in words)
    total, distinct, ends = sum(counts.values()) + len(used), len(counts) + 1, len(used)

    def plain(i, t):
        words = lowered(t).split()
        score = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        return str(i), len(words) + 1, sum(counts[w] > 0 for w in words) + 1, round(score + math.log10((ends + 1) / (total + distinct + 1)), 6)

    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(plain(i, t) for i, t in rows)
    assert {r.train_tokens for r in got} == {total}
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault((r.n_tokens, r.base_score), set()).add(round(r.score, 6))
    assert max(map(len, by_text.values())) <= 2


def test_document_scores(spark):
    """Scores of whole documents are the sums of their words' marginals under the fit to the training words."""
    rows = [(i, t) for i, t in hostile(5) if t is None or len(t) < 3000]
    got = lattice.lm_score(frame(spark, rows), F.col("doc_id") % 3 != 0, MODEL).collect()
    with open(MODEL, "rb") as f:
        own = lattice.Lattice.of_model(f.read())
    used = [lowered(t).split() for i, t in rows if i is not None and i % 3 != 0]
    counts = Counter(w.decode() if isinstance(w, bytes) else w for words in used for w in words)
    words, weights, logp, steps = list(counts), np.array(list(counts.values()), float), own.first_guess(), 0
    while True:
        uses = own.expected(words, weights, logp)
        before, logp, steps = logp, own.fitted(uses, float(len(used))), steps + 1
        if uses @ (logp - before)[: len(uses)] / (weights.sum() + len(used)) / math.log(10) < lattice.SETTLED:
            break
    assert steps > 2

    def plain(text):
        each = [w.decode() if isinstance(w, bytes) else w for w in lowered(text).split()]
        return (sum(own.scores(each, logp)) if each else 0.0) / math.log(10) + logp[-1] / math.log(10)

    want = sorted((str(i), plain(t)) for i, t in rows)
    mine = sorted((str(r.doc_id), r.score) for r in got)
    assert [i for i, _ in mine] == [i for i, _ in want]
    assert np.allclose([s for _, s in mine], [s for _, s in want], rtol=1e-5, atol=1e-4)


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    got = {r.doc_id: r for r in lattice.lm_score(docs, F.lit(None).cast("boolean"), MODEL).collect()}
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and got[2].n_tokens == 1 and got[2].base_score == 0.0
    assert lattice.lm_score(docs.where("doc_id > 9"), F.lit(True), MODEL).count() == 0
