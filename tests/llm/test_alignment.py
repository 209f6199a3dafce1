"""Alignment against counting every link one by one with the libraries."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from flowsieve.llm import alignment
from flowsieve.llm.common import durable

FILES = [public_tokenizers.path(f) for f in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json")]
SCHEMA = "doc_id long, text string, a string, b string, links string, container string"


def by_hand(rows):
    with open(FILES[0], "rb") as f:
        a_bytes = {int(k): base64.b64decode(t) for t, k in map(bytes.split, f)}
    a = Tokenizer.from_file(FILES[2])
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=FILES[1])

    def b_token(k):
        piece = sp.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if sp.is_byte(k) else piece.replace("▁", " ").encode()

    texts, count = [], Counter()
    for _, text, *_ in rows:
        links, groups = [], []
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        parts_a, parts_b = [a_bytes[k] for k in ids_a], [b_token(k) for k in ids_b]
        if text and b"".join(parts_a) == b"".join(parts_b) == b" " + text.encode():
            ends = {}
            at = 0
            for k, part in zip(ids_b, parts_b):
                at += len(part)
                ends[at] = k
            at, now_a, now_b, done = 0, [], [], 0
            todo = list(zip(ids_b, np.cumsum([len(p) for p in parts_b]).tolist()))
            for k, part in zip(ids_a, parts_a):
                at += len(part)
                now_a.append(k)
                if at in ends:
                    while done < len(todo) and todo[done][1] <= at:
                        now_b.append(todo[done][0])
                        done += 1
                    groups.append(",".join(map(str, now_a)) + "|" + ",".join(map(str, now_b)))
                    links.append((k, ends[at]))
                    now_a, now_b = [], []
        else:
            ids_a, ids_b = [], []
        texts.append((len(ids_a), len(ids_b), groups, links))
        count.update(links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = Counter()
    for (id_, *_), (n_a, n_b, groups, links) in zip(rows, texts):
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        top = sum(count[x] == best[x[1]] for x in links)
        out[id_, n_a, n_b, len(groups), len(links), top, sum(count[x] for x in links), sha] += 1
    return out, count, texts


def corpus(rng):
    words = ["the", "Over", "naïve", "中文", "😀", "x1", "can't", "  ", "\n", "\t", "…", "<|endoftext|>", "<s>", "</s>", "<unk>", "▁", "\x00", "<0x41>", "12345", "é", "ﬁ"]
    rows = [(k, rng.choice(["", " ", "\n\n"]) + rng.choice([" ", "", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(300)]
    rows += [(None, None), (None, "the the the"), (7, ""), (7, "same text, same text"), (7, "same text, same text"), (8, " "), (9, "a" * 3000), (10, " " * 2000 + "x"), (11, "word " * 5000)]
    return [(*r, "x", "y", "z", "w") for r in rows]


@pytest.mark.parametrize("limits", [(65_536, 2_000_000, 1 << 20), (40, 50, 200)])
def test_every_link(spark, limits, monkeypatch):
    monkeypatch.setattr(alignment, "CONTAINER", limits[0])
    monkeypatch.setattr(alignment, "POSTINGS", limits[1])
    monkeypatch.setattr(alignment, "TEXT_BYTES", limits[2])
    rows = corpus(random.Random(6))
    if limits[0] < 300:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, count, texts = by_hand(rows)
    got = alignment.align(docs, *FILES).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert Counter(tuple(r) for r in got) == want
    indexed = durable(alignment.index(docs, alignment.ship(docs, *FILES)), "pairs")
    pairs = {(r.a, r.b): (r.documents, r.links) for r in alignment.pair_counts(indexed).collect()}
    holders = Counter(x for *_, links in texts for x in set(links))
    assert pairs == {x: (holders[x], n) for x, n in count.items()}


def test_bitmaps():
    rng = random.Random(1)
    for size in (1, 5, 8, 100, 5000, 60_000):
        some = np.array(sorted(rng.sample(range(65_536), size)))
        blob = alignment.compressed(some)
        assert alignment.positions_of(blob).tolist() == some.tolist() and alignment.population(blob) == size
        assert len(blob) <= 2 + min(2 * size, 8192)


def test_empty_table_and_very_long_text(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), *FILES).count() == 0
    row = alignment.align(spark.createDataFrame([(1, "This is a text. " * 150_000)], "doc_id long, text string"), *FILES).first()
    assert row.n_links == row.n_groups > 500_000 and row.count_sum > row.n_links
