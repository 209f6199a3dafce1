"""Repeated byte strings and word sequences against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import anchors, repeats, suffix_array, suffix_tree
from flowsieve.llm.common import durable
from tests.llm.test_dedup import frame, prose

SMALL = repeats.Scheme(24, 8, False)


def passages(seed, alphabet="ab cdé\n"):
    """Texts that share passages, hold periodic stretches and each other's copies."""
    rng = random.Random(seed)
    shared = ["".join(rng.choice(alphabet) for _ in range(rng.randint(10, 90))) for _ in range(6)]
    rows = [(None, "x" * 60), (1, None), (2, ""), (3, "a" * 23), (4, "b" * 24), (5, "b" * 25), (6, "ab" * 40), (6, "ab" * 40)]
    for k in range(60):
        parts = [prose(rng, rng.randint(0, 8)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randint(1, 6))]
        rows.append((10 + k, "".join(parts)))
    rows += [(100 + k, prose(rng, 6) + shared[0] + shared[1] + prose(rng, 6)) for k in range(40)]
    return rows


def plain_kept(texts, width):
    """Kept bytes and removed spans of each text, from every window of the corpus."""
    raw = [(t or "").encode() for t in texts]
    counts = Counter(r[k : k + width] for r in raw for k in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 2, bool)
        for k in range(len(r) - width + 1):
            if counts[r[k : k + width]] > 1:
                gone[k + 1 : k + width + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((len(r), spans, bytes(b for b, g in zip(r, gone[1:]) if not g)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_shard_flags(seed):
    rng = random.Random(seed)
    for _ in range(25):
        alphabet = rng.choice([b"a", b"ab", b"abcdefgh"])
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 8))]
        depth = rng.choice([8, 9, 16, 21, 24])
        shard = suffix_array.Shard(texts, depth)
        suffixes = [(t[k:] + bytes([255]), n, k) for n, t in enumerate(texts) for k in range(len(t))]
        assert len(shard.order) == len(suffixes)
        cut = [bytes(shard.data[p : p + depth]) for p in shard.order.tolist()]
        assert [c.split(b"\xff")[0] + (b"\xff" if b"\xff" in c else b"") for c in cut] == sorted(c.split(b"\xff")[0] + (b"\xff" if b"\xff" in c else b"") for c in cut)
        counts = Counter(t[k : k + depth] for t in texts for k in range(len(t) - depth + 1))
        found = shard.repeated()
        for n, t in enumerate(texts):
            for k in range(len(t) - depth + 1):
                assert found[shard.starts[n] + k] == (counts[t[k : k + depth]] > 1)
        other = suffix_array.Shard([bytes(rng.choice(alphabet) for _ in range(40)), texts[0] + b"z"], depth)
        mine, theirs = shard.found_in(other)
        own = {t[k : k + depth] for t in texts for k in range(len(t) - depth + 1)}
        listed = [bytes(other.data[s : s + n]) for s, n in zip(other.starts.tolist(), other.sizes.tolist())]
        held = {t[k : k + depth] for t in listed for k in range(len(t) - depth + 1)}
        for n, t in enumerate(listed):
            for k in range(len(t) - depth + 1):
                assert theirs[other.starts[n] + k] == (t[k : k + depth] in own)
        for n, t in enumerate(texts):
            for k in range(len(t) - depth + 1):
                if t[k : k + depth] in held:
                    assert mine[shard.starts[n] + k]


@pytest.mark.parametrize("seed", range(5))
def test_collapsed_contexts(seed):
    """Each context is followed by as many copies of itself as it says, and none is lost."""
    rng = random.Random(seed)
    for _ in range(60):
        parts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) * rng.randint(1, 40) for _ in range(rng.randint(1, 5))]
        data = np.frombuffer(b"".join(parts), np.uint8)
        found = anchors.contexts(anchors.byte_grams(data, 8), 24, 8)
        fewer = anchors.collapsed(found, 24, data)
        spread = [(f + r * c, c) for f, c, t in zip(fewer.first, fewer.count, fewer.times) for r in range(t)]
        assert spread == list(zip(found.first, found.count))
        for f, c, t in zip(fewer.first, fewer.count, fewer.times):
            assert len({data[f + r * c : f + r * c + c + 23].tobytes() for r in range(t)}) <= 1
        ahead = zip(found.first, found.count, found.first[1:], found.count[1:])
        same = sum(c == d and data[f : f + c + 23].tobytes() == data[g : g + d + 23].tobytes() for f, c, g, d in ahead)
        assert len(found.first) - len(fewer.first) == same


def periodic(rng):
    unit = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 30)))
    return prose(rng, rng.randint(0, 5)) + (unit * rng.randint(2, 40))[: rng.randint(10, 400)] + prose(rng, rng.randint(0, 5))


@pytest.mark.parametrize("seed", [1, 2])
def test_periodic_texts(spark, seed):
    rng = random.Random(seed)
    rows = [(k, periodic(rng)) for k in range(150)] + [(200 + k, "ab" * n) for k, n in enumerate((11, 12, 13, 24, 200))]
    got = suffix_array.remove_repeats(frame(spark, rows), scheme=SMALL).collect()
    mine = sorted((r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in got)
    assert mine == sorted((i, *w) for (i, _), w in zip(rows, plain_kept([t for _, t in rows], SMALL.width)))
    spaced = [(k, " ".join(t.replace(" ", "x"))) for k, t in rows]
    got = suffix_tree.remove_seen_words(frame(spark, spaced)).collect()
    mine = sorted((r.doc_id, r.n_words, sum(s.end - s.begin for s in r.spans), r.kept) for r in got)
    assert mine == sorted((i, *w) for (i, _), w in zip(spaced, plain_words(spaced, 13)))


def test_five_megabytes_of_one_symbol(spark):
    rows = [(1, "a" * 5_000_000), (2, "b" + "a" * 600), (3, "-" * 399), (4, "xyz " * 1_250_000)]
    got = {r.doc_id: r for r in suffix_array.remove_repeats(frame(spark, rows)).collect()}
    assert {k: (r.n_bytes, bytes(r.kept)) for k, r in got.items()} == {1: (5_000_000, b""), 2: (601, b"b"), 3: (399, b"-" * 399), 4: (5_000_000, b"")}
    rows = [(1, "a " * 2_500_000), (2, "a " * 2_000_000 + "b"), (3, "a b c " * 500_000), (5, "c a b " * 10)]
    got = {r.doc_id: r for r in suffix_tree.remove_seen_words(frame(spark, rows)).collect()}
    assert {k: (r.n_words, sum(s.end - s.begin for s in r.spans)) for k, r in got.items()} == {1: (2_500_000, 0), 2: (2_000_001, 2_000_000), 3: (1_500_000, 0), 5: (30, 30)}


def test_equal_windows_share_their_anchor():
    rng = np.random.default_rng(7)
    data = np.concatenate([p := rng.integers(97, 103, 500, dtype=np.uint8), rng.integers(97, 103, 300, dtype=np.uint8), p])
    found = anchors.contexts(anchors.byte_grams(data, 8), 24, 8)
    assert found.count.sum() == len(data) - 23
    by_window = {}
    for first, count, at, gram in zip(found.first, found.count, found.anchor, found.gram):
        for w in range(first, first + count):
            assert w <= at <= w + 16
            by_window.setdefault(data[w : w + 24].tobytes(), set()).add((int(gram), int(at - w)))
    assert all(len(v) == 1 for v in by_window.values())


@pytest.mark.parametrize(("seed", "unit", "block"), [(1, 1 << 22, 1 << 20), (2, 300, 2000), (3, 60, 500)])
def test_removed_bytes(spark, monkeypatch, seed, unit, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "RANGE_BYTES", 4 * block)
    rows = passages(seed)
    got = suffix_array.remove_repeats(frame(spark, rows), scheme=SMALL, unit_bytes=unit).collect()
    mine = sorted((str(r.doc_id), r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in got)
    want = plain_kept([t for _, t in rows], SMALL.width)
    assert mine == sorted((str(i), *w) for (i, _), w in zip(rows, want))


def test_contexts_of_a_frequent_gram_spread_over_tasks(spark, monkeypatch):
    rng = random.Random(4)
    alphabet = "abcdefghijklmnop"
    shared = "".join(rng.choice(alphabet) for _ in range(22))
    sides = [["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(2)] for _ in range(400)]
    rows = [(k, a + shared + b) for k, (a, b) in enumerate(sides)] + [(500, sides[0][0] + shared + "z")]
    shares = []

    def seen(df, label):
        if label == "members":
            tasks = df.groupBy("fp", F.spark_partition_id().alias("task")).count().collect()
            grams = Counter()
            for r in tasks:
                grams[r.fp] += r["count"]
            hot, size = grams.most_common(1)[0]
            shares.append((size, max(r["count"] for r in tasks if r.fp == hot)))
        return durable(df, label)

    monkeypatch.setattr(suffix_array, "durable", seen)
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        got = suffix_array.remove_repeats(frame(spark, rows), scheme=SMALL).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    mine = sorted((r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in got)
    assert mine == sorted((i, *w) for (i, _), w in zip(rows, plain_kept([t for _, t in rows], SMALL.width)))
    [(size, most)] = shares
    assert size > 100 and most < size / 2


def test_production_width(spark):
    rng = random.Random(9)
    passage = prose(rng, 150)
    rows = [(k, prose(rng, 40) + passage + prose(rng, 30)) for k in range(12)] + [(90, prose(rng, 3000)), (91, "é" * 500), (92, "z" * 399)]
    rows += [(93, rows[12][1][:5000]), (94, rows[0][1])]
    got = suffix_array.remove_repeats(frame(spark, rows)).collect()
    mine = sorted((r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in got)
    assert mine == sorted((i, *w) for (i, _), w in zip(rows, plain_kept([t for _, t in rows], 400)))
    assert suffix_array.remove_repeats(frame(spark, rows).where("doc_id < 0")).count() == 0


def plain_words(rows, width):
    """Kept words of each row when windows that a smaller id holds go."""
    split = [(i if i is not None else 1 << 70, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, words in split:
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            least[w] = min(least.get(w, i), i)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            if least[tuple(words[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return out


def word_rows(seed):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice(["a", "b", "cc", "dé"]) for _ in range(rng.randint(3, 40))) for _ in range(5)]
    rows = [(None, "a b " * 20), (None, shared[0]), (1, None), (2, ""), (3, "a " * 30), (4, " a\t" * 30), (5, "a\n" * 12), (7, shared[1]), (7, shared[1])]
    for k in range(60):
        parts = [prose(rng, rng.randint(0, 6)) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(1, 6))]
        rows.append((200 - k, rng.choice([" ", "  ", "\n"]).join(parts)))
    rows += [(300 + k, prose(rng, 3) + " " + shared[4] + " " + shared[2] + " " + prose(rng, 3)) for k in range(40)]
    return rows


@pytest.mark.parametrize(("seed", "width", "unit", "tree"), [(1, 13, 1 << 22, 20_000), (2, 5, 400, 6), (3, 13, 200, 3)])
def test_removed_words(spark, monkeypatch, seed, width, unit, tree):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(repeats, "RANGE_BYTES", 4000)
    rows = word_rows(seed)
    scheme = repeats.Scheme(width, 2, True)
    got = suffix_tree.remove_seen_words(frame(spark, rows), scheme=scheme, unit_bytes=unit, suffixes_of_tree=tree).collect()
    mine = sorted((str(r.doc_id), r.n_words, sum(s.end - s.begin for s in r.spans), r.kept) for r in got)
    assert mine == sorted((str(i), *w) for (i, _), w in zip(rows, plain_words(rows, width)))
    assert any(n for _, _, n, _ in mine)


def test_no_words(spark):
    none = frame(spark, [(1, "a")]).where("doc_id < 0")
    assert suffix_tree.remove_seen_words(none).count() == 0


def test_subtree_nodes():
    tree = suffix_tree.Subtree([x.split() for x in sorted(["a b c", "a b c", "a b d", "a b d", "a x y", "b b b"])])
    assert sorted(tree.nodes) == [(0, 0, 5), (1, 0, 4), (2, 0, 3), (3, 0, 1), (3, 2, 3)]
    assert tree.deep(3) == [(0, 1), (2, 3)] and tree.deep(2) == [(0, 3)]
