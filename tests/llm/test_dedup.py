"""Exact dedup and SimHash against brute force on small hostile tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from flowsieve.llm import exact, simhash
from flowsieve.llm.common import tune
from flowsieve.llm.components import components

SCHEMA = "doc_id long, text string, uid string, kind string, recipe string, fp string, h string"


def frame(spark, rows, parts=3):
    """Rows with extra columns whose names clash with the operators' own."""
    tune(spark)
    return spark.createDataFrame([(i, t, "x", "y", "z", "p", "q") for i, t in rows], SCHEMA).repartition(parts)


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def hostile(seed=1):
    rng = random.Random(seed)
    long_text = prose(rng, 9000)
    rows = [(1, None), (2, ""), (3, " "), (4, "A b"), (5, "a B"), (5, "a b"), (None, "a b"), (6, "É"), (7, "é")]
    rows += [(10, long_text), (11, long_text.upper()), (12, long_text + "!"), (13, long_text), (13, long_text)]
    rows += [(20 + k, "the very same line") for k in range(40)]
    rows += [(100 + k, prose(rng, rng.randint(1, 400))) for k in range(30)]
    return rows


@pytest.mark.parametrize("hash_bytes", [16, 1])
def test_exact(spark, hash_bytes):
    rows = hostile()
    got = exact.exact_dedup(frame(spark, rows), hash_bytes=hash_bytes).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    want = sorted(
        (str(i), str(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t).hexdigest())
        for t, ids in groups.items()
        for i in ids
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).where("doc_id > 5")
    assert exact.exact_dedup(none).count() == 0
    assert simhash.simhash_dedup(none).count() == 0


def test_chunk_borders_follow_content():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 60_000, dtype=np.uint8)
    gear = exact._gear()
    ends = exact.chunk_ends(data, gear)
    assert ends[-1] == len(data) and all(b - a <= exact.MOST for a, b in zip([0, *ends], ends))
    shifted = exact.chunk_ends(np.concatenate([data[:7], data]), gear)
    assert len({e + 7 for e in ends} & set(shifted)) > len(ends) // 2
    flat = np.zeros(100_000, np.uint8)
    assert sum(b - a for a, b in zip([0, *exact.chunk_ends(flat, gear)], exact.chunk_ends(flat, gear))) == 100_000


def plain_fingerprint(text, width):
    words = lowered(text).split()
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        out |= (ones * 2 > len(shingles)) << bit
    return out


def plain_classes(rows, width, bits):
    fps = [plain_fingerprint(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted((str(i), f"{fps[k]:016x}", str(least[root(k)])) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "bits", "size"), [(3, 3, 8192), (3, 3, 4), (5, 6, 8192)])
def test_simhash(spark, width, bits, size):
    rng = random.Random(5)
    rows = [r for r in hostile(2) if not (r[0] and 10 <= r[0] <= 13)]
    base = prose(rng, 300).split()
    for k in range(60):  # a chain of near copies
        base[rng.randrange(len(base))] = "x" + str(k)
        rows.append((1000 - k, " ".join(base)))
    got = simhash.simhash_dedup(frame(spark, rows), words=width, bits=bits, slice_size=size).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == plain_classes(rows, width, bits)


@pytest.mark.parametrize("bits", sorted(simhash.LAYOUTS))
def test_block_masks_miss_nothing(bits):
    rng = random.Random(bits)
    masks = simhash.block_masks(bits)
    for _ in range(3000):
        flips = sum(1 << k for k in rng.sample(range(64), bits))
        assert any(flips & m == 0 for m in masks)


def test_links_in_dense_and_sparse_runs():
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in set(rng.integers(0, 64, k % 5).tolist())) for k in range(50)], np.uint64)
    fps = np.unique(np.concatenate([c ^ flips for c in centres]))
    run = np.sort(rng.integers(0, 3, len(fps)))
    got = simhash.linked(run, fps, 3)
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if run[a] == run[b] and int(fps[a] ^ fps[b]).bit_count() <= 3:
                parent[root(a)] = root(b)
    mine = {}
    for k in range(len(fps)):
        mine.setdefault(root(k), set()).add(int(got[k]))
    assert all(len(v) == 1 for v in mine.values()) and len({min(v) for v in mine.values()}) == len(mine)


def test_components(spark):
    rng = random.Random(4)
    chain = list(range(0, 300, 3))
    edges = list(zip(chain, chain[1:])) + [(1, 1), (4, 7), (7, 4), (1000, 2)] + [(5000, 5000 + k) for k in range(200)]
    rng.shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[x] for x in chain} == {0} and got[7] == 4 and got[1000] == 2 and got[5199] == 5000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
