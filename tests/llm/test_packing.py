"""Packing against the library's ids, the definition of a packing, and plain best fit."""

import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowsieve.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, _shares string, rank string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def hostile(rng, n):
    letters = [chr(k) for k in range(0x300)] + ["'s", " ", "\n", " ", "<|endoftext|>", "İ", "Σ", "ς", "K", "中", "😀", "é", "̸", "=", "<|ENDOFTEXT|>"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_equal_the_library(library):
    texts = hostile(random.Random(3), 4000) + ["a" * 3000, " " * 5000, "x <|startoftext|>y", "CAN'T can't 'LL", "12345 a1b2 ²½ ٠", "…—« »"]
    codec = packing.WordCodec(PATH)
    for _ in range(2):
        got = codec.encode([t.encode() for t in texts])
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [packing.np.frombuffer(x, "<u4").tolist() for x in got] == want


def bins_of(plan, counts):
    """Every single item put where the plan says."""
    bins = {}
    for size, n in counts.items():
        steps = sorted((f, e, b, o) for s, f, e, b, o in zip(plan.length, plan.first, plan.each, plan.bin, plan.offset) if s == size)
        for rank in range(n):
            first, each, bin_, offset = [s for s in steps if s[0] <= rank][-1]
            bins.setdefault(bin_ + (rank - first) // each, []).append((offset + (rank - first) % each * size, size))
    return bins


def best_fit(counts, capacity):
    gaps = []
    for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        gap = min((g for g in gaps if g >= size), default=None)
        if gap is None:
            gap = capacity
        else:
            gaps.remove(gap)
        gaps.append(gap - size)
    return len(gaps)


def test_plans(library):
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([1, 6, 10, 31, 64])
        counts = {rng.randint(1, capacity): rng.randint(0, 12) for _ in range(rng.randint(0, 12))}
        plan = packing.plan_bins(counts, capacity)
        bins = bins_of(plan, counts)
        assert sorted(bins) == list(range(plan.bins)) and plan.bins <= best_fit(counts, capacity)
        for items in bins.values():
            at = 0
            for offset, size in sorted(items):
                assert offset == at
                at += size
            assert at <= capacity
            assert sum(3 * size > capacity for _, size in items) <= 2
    with pytest.raises(ValueError):
        packing.plan_bins({7: 1}, 6)


def test_large_items_pair_as_often_as_they_can():
    """Against trying out all pairings."""
    rng = random.Random(8)

    def most(items, capacity):
        if not items:
            return 0
        rest = items[1:]
        return max([most(rest, capacity)] + [1 + most(rest[:k] + rest[k + 1 :], capacity) for k in range(len(rest)) if items[0] + rest[k] <= capacity])

    for _ in range(100):
        items = [rng.randint(11, 30) for _ in range(rng.randint(0, 8))]
        assert packing.plan_bins(Counter(items), 30).bins == len(items) - most(items, 30)


def test_documents(spark, library):
    rng = random.Random(4)
    texts = [None, "", "", " "] + hostile(rng, 200) + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 300))) for _ in range(150)]
    rows = [(k if k % 9 else None, t, "x", "y", "z") for k, t in enumerate(texts)] + [(5, "same text", "x", "y", "z")] * 40
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    capacity = 50
    pieces = packing.durable(packing.token_pieces(docs, PATH, capacity=capacity, with_ids=True), "p")
    got = packing.pack(pieces, capacity, share=7).collect()
    want = Counter()
    for id_, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            raw = packing.np.array(ids[k : k + capacity], "<u4").tobytes()
            want[id_, k // capacity, k, len(raw) // 4, zlib.crc32(raw)] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, bytes(r.ids)))
    whole = {k: b"".join(x for _, x in sorted(v)) for k, v in bins.items()}
    for key, some in bins.items():
        at = 0
        for offset, ids in sorted(some):
            assert offset == at
            at += len(ids) // 4
        assert at <= capacity
    counts = Counter(r.length for r in got)
    assert sorted(bins) == list(range(packing.plan_bins(counts, capacity).bins))
    assert len(bins) <= best_fit(counts, capacity)
    made = packing.sequences(packing.pack(pieces, capacity, share=7)).collect()
    assert {r.sequence_id: len(r.ids) // 4 for r in made} == {r.sequence_id: r.length for r in made}
    assert sorted(len(x) for x in whole.values()) == sorted(len(r.ids) for r in made)


def test_empty_table_and_long_text(spark, library):
    none = packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH)
    assert none.count() == 0 and none.columns[-2:] == ["sequence_id", "offset"]
    long = spark.createDataFrame([(1, "ab cd " * 400_000), (2, "é" * 100_000)], "doc_id long, text string")
    rows = packing.pack_documents(long, PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 800_001
    assert sum(r.length == 2048 for r in rows) >= 390
