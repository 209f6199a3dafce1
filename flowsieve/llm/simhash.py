"""SimHash near-dedup with pivot distance tables.

Fingerprints link when they differ in at most ``bits`` of their 64 bits. Fingerprints
that could link must agree on some of a few bit blocks (``bits`` errors cannot touch
every block), which lays them out in buckets without comparing everything with
everything. Inside a bucket the work is done by a pivot table: the Hamming distances
of each fingerprint to a fixed list of reference fingerprints. Distance is a metric,
so two fingerprints whose distances to any pivot differ by more than ``bits`` cannot
link. Pairs that survive the largest coordinate difference are verified bit by bit.

A pivot table alone cannot partition the work: distances of unrelated fingerprints to
any pivot all lie near 32, so about half of all pairs pass each coordinate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import LOWER, batch_of, durable, narrow, runs, spread, text_bytes
from flowsieve.llm.components import components

SEED = 42  # of the shingle hash
BITS = 3  # differing bits that still link
PIVOTS = 24
SLICE = 8192  # members of a bucket compared in one go; larger buckets are dealt out in slices

# blocks the 64 bits are cut into, and how many of them must agree, by allowed errors
LAYOUTS = {0: (1, 1), 1: (3, 2), 2: (4, 2), 3: (5, 2), 4: (6, 2), 5: (8, 3), 6: (9, 3)}


def fingerprint(words: list[bytes], width: int) -> int:
    """SimHash of a word list: each bit says what over half of the shingle hashes have there."""
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [h(b" ".join(words), SEED)]
    else:
        hashes = [h(b" ".join(s), SEED) for s in zip(*[words[k:] for k in range(width)], strict=False)]
    n, ones = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        part = np.array(hashes[k : k + 65_536], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprinter(width: int):
    schema = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("fp", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            lowered = LOWER[data]
            fps = [
                fingerprint(lowered[lo:hi].tobytes().split(), width)
                for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
            ]
            signed = np.array(fps, np.uint64).view(np.int64)
            yield batch_of(schema, {"uid": batch.column("uid"), "id": batch.column("id"), "fp": signed})

    return hashed


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(uid, id, fp) of every row. Words are separated by ASCII white space; A-Z is lower-cased."""
    base = narrow(docs, id=id_col, text=text_col)
    return base.mapInArrow(_fingerprinter(words), "uid long, id long, fp long")


def block_masks(bits: int) -> list[int]:
    """Bit masks, one of which two fingerprints within ``bits`` errors must agree on."""
    blocks, keep = LAYOUTS[bits]
    if blocks - bits < keep:
        raise ValueError("errors could touch too many blocks")
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(some) for some in combinations(masks, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class _Labels:
    """Components of the rows of one table, merged from batches of links."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.of[a], self.of[b]], 1), axis=0)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if parent:
            table = np.arange(len(self.of))
            for x in list(parent):
                table[x] = root(x)
            self.of = table[self.of]


def pivot_table(fps: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Hamming distances (n x count) to fixed reference fingerprints."""
    pivots = np.random.default_rng(64).integers(0, 1 << 64, count, dtype=np.uint64)
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def linked(run: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """For rows in runs: the row each is linked to, directly or over others of its run (itself if none).

    Rows are sorted by run and first pivot distance. Row i meets row i + 1, i + 2, ...
    while the run and the first coordinate allow it; pairs already in one component
    need no comparison, the others pass the remaining coordinates and are verified.
    """
    table = pivot_table(fps)
    order = np.lexsort((table[:, 0], run))
    run, fps, table = run[order], fps[order], table[order]
    first, n = table[:, 0].astype(np.int16), len(run)
    labels, at, step = _Labels(n), np.arange(n), 0
    while len(at):
        step += 1
        at = at[at + step < n]
        to = at + step
        near = (run[to] == run[at]) & (first[to] - first[at] <= bits)
        at, to = at[near], to[near]
        open_ = labels.of[at] != labels.of[to]
        a, b = at[open_], to[open_]
        for c in range(1, table.shape[1]):
            if not len(a):
                break
            keep = np.abs(table[a, c] - table[b, c]) <= bits
            a, b = a[keep], b[keep]
        close = np.bitwise_count(fps[a] ^ fps[b]) <= bits
        if close.any():
            labels.merge(a[close], b[close])
    out = np.empty(n, np.int64)
    out[order] = order[labels.of]
    return out


def _linker(bits: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "layout", "block", "pair"):
            fps = table.column("fp").to_numpy().view(np.uint64)
            keys = np.stack([table.column(k).to_numpy() for k in ("layout", "block", "pair")])
            run = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
            met = np.bincount(run)[run] > 1  # most fingerprints are alone in their bucket
            run, fps = run[met], fps[met]
            to = linked(run, fps, bits)
            moved = np.flatnonzero(to != np.arange(len(to)))
            signed = fps.view(np.int64)
            yield batch_of(schema, {"a": signed[moved], "b": signed[to[moved]]})

    return link


def links(fps: DataFrame, bits: int = BITS, slice_size: int = SLICE) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that lie within ``bits``.

    ``fps`` has one row for each distinct fingerprint. A bucket of n members is dealt
    out in ceil(n / slice_size) slices, and each pair of slices is one unit of work, so
    no task gathers a bucket however many fingerprints agree on its blocks.
    """
    masks = F.array(*[F.struct(F.lit(k).alias("layout"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block")) for k, m in enumerate(block_masks(bits))])
    laid = fps.select("fp", F.inline(masks))
    large = laid.groupBy("layout", "block").count().where(F.col("count") > slice_size)
    shared = laid.join(durable(large, "large-buckets"), ["layout", "block"], "left")
    slices = F.ceil(F.coalesce("count", F.lit(1)) / slice_size).cast("long")
    dealt = shared.withColumn("slices", slices).withColumn("own", F.pmod(F.xxhash64("fp"), "slices"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    dealt = dealt.withColumn("other", other).select(
        "fp", "layout", "block", (F.least("own", "other") * F.col("slices") + F.greatest("own", "other")).alias("pair")
    )
    laid_out = spread(dealt, "layout", "block", "pair").sortWithinPartitions("layout", "block", "pair")
    return laid_out.mapInArrow(_linker(bits), "a long, b long")


def classes(fps: DataFrame, bits: int = BITS, slice_size: int = SLICE) -> DataFrame:
    """(fp, component_id) for every fingerprint of (id, fp): the smallest id that links reach."""
    nodes = durable(fps.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    roots = components(links(nodes.select("fp"), bits, slice_size)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def simhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    bits: int = BITS,
    slice_size: int = SLICE,
) -> DataFrame:
    """One row for every row of ``docs``: its fingerprint and its class of near duplicates.

    Texts without words have fingerprint 0 and link like any other; texts with fewer
    words than a shingle have one shingle of all their words. Null counts as empty.
    ``component_id`` is the smallest id that links reach, a null id counting as larger
    than any number (a class of null ids only has none). Repeated rows keep a row each.
    Columns: id_col, uid, fp (signed), fingerprint (16 hex digits), component_id.
    """
    rows = durable(fingerprints(docs, id_col, text_col, words), "simhash")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(classes(rows, bits, slice_size), "fp").select(
        F.col("id").alias(id_col), "uid", "fp", hexed.alias("fingerprint"), "component_id"
    )
