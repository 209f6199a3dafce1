"""Candidate contexts of windows that repeat across a corpus, for the substring operators.

Three passes over the texts, none of which gathers copies in one task:

1. Each task packs the anchor grams of its texts by (gram range, block of documents);
   a pack holds a gram twice at most. Each gram range is then looked through once for
   grams that occur again, which are sent back to the blocks that hold them.
2. Each block cuts out the contexts of those grams: one narrow row for each occurrence,
   and the bytes of each distinct context once.
3. Whatever was decided on contexts returns to the blocks and is applied to the texts.

Blocks and gram ranges hold about the same amount whatever the table's size: their
number follows from the bytes of the table. Copies of a text spread over the blocks,
since a block is chosen by a hash of id and text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm import anchors
from flowsieve.llm.common import batch_of, durable, narrow, spread, text_bytes

BLOCK_BYTES = 6 << 20  # text in a block of documents
RANGE_BYTES = 32 << 20  # text whose grams share a range
PACK_GRAMS = 1 << 20  # grams a task holds before it packs them
UNIT_BYTES = 4 << 20  # context bytes that are compared in one go

Cut = Callable[[bytes], tuple[bytes, anchors.Runs, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Scheme:
    """Windows of ``width`` symbols; ``cut`` gives a text's runs and where its symbols begin and end."""

    width: int
    gram: int
    words: bool

    def cut(self, raw: bytes) -> tuple[bytes, anchors.Runs, np.ndarray, np.ndarray]:
        """(text as compared, runs, byte where each symbol starts, byte where each ends)."""
        if not self.words:
            data = np.frombuffer(raw, np.uint8)
            at = np.arange(len(data))
            found = anchors.contexts(anchors.byte_grams(data, self.gram), self.width, self.gram)
            return raw, anchors.collapsed(found, self.width, data), at, at + 1
        flat = b" ".join(raw.split())
        data = np.frombuffer(flat, np.uint8)
        starts, ends = anchors.word_borders(data)
        hashes = anchors.word_hashes(data, starts, ends)
        grams = anchors.word_grams(hashes, self.gram)
        size = np.minimum(255, ends[self.gram - 1 :] - starts[: len(grams)])  # long grams are rare ones
        found = anchors.contexts(grams, self.width, self.gram, size)
        fewer = anchors.collapsed(found, self.width, hashes)
        if fewer is found:
            return flat, found, starts, ends
        for k in np.flatnonzero(fewer.times > 1).tolist():
            first, step = int(fewer.first[k]), int(fewer.count[k])
            last = first + int(fewer.times[k]) * step + self.width - 2
            if flat[starts[first] : ends[last - step]] != flat[starts[first + step] : ends[last]]:
                return flat, found, starts, ends  # word hashes clash: every context by itself
        return flat, fewer, starts, ends


BYTES = Scheme(400, 32, False)
WORDS = Scheme(13, 2, True)


@dataclass
class Texts:
    """The documents with the block and the two-part key that a later pass finds them by."""

    rows: DataFrame  # block, d1, d2, id, text
    blocks: int
    ranges: int


def prepared(docs: DataFrame, id_col: str, text_col: str) -> Texts:
    base = narrow(docs, id=id_col, text=text_col).drop("uid")
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks, ranges = max(1, math.ceil(size / BLOCK_BYTES)), max(1, math.ceil(size / RANGE_BYTES))
    rows = base.withColumn("d1", F.xxhash64("id", "text")).withColumn("d2", F.xxhash64("text", F.lit(2), "id"))
    rows = rows.withColumn("block", F.pmod(F.col("d1"), F.lit(blocks)))
    return Texts(rows.select("block", "d1", "d2", "id", "text"), blocks, ranges)


def raw_texts(table: pa.Table | pa.RecordBatch) -> Iterator[bytes]:
    column = table.column("text")
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        data, offsets = text_bytes(chunk)
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield data[lo:hi].tobytes()


def _packer(scheme: Scheme, ranges: int):
    schema = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("grams", pa.binary())])

    def packed(grams: list[np.ndarray], blocks: list[np.ndarray]) -> pa.RecordBatch:
        gram, block = np.concatenate(grams), np.concatenate(blocks)
        part = ((gram >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((gram, block, part))
        gram, block, part = gram[order], block[order], part[order]
        third = (gram[2:] == gram[:-2]) & (block[2:] == block[:-2])
        kept = np.concatenate([np.ones(min(2, len(gram)), bool), ~third])
        gram, block, part = gram[kept], block[kept], part[kept]
        edge = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1
        begins = np.concatenate([[0], edge])
        packs = [g.tobytes() for g in np.split(gram, edge)]
        return batch_of(schema, {"range": part[begins], "block": block[begins], "grams": packs})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[np.ndarray] = []
        blocks: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), raw_texts(batch), strict=True):
                runs = scheme.cut(raw)[1]
                found = np.repeat(runs.gram, np.minimum(runs.times, 2))
                if len(found):
                    grams.append(found)
                    blocks.append(np.full(len(found), block))
                    held += len(found)
            if held >= PACK_GRAMS:
                yield packed(grams, blocks)
                grams, blocks, held = [], [], 0
        if held:
            yield packed(grams, blocks)

    return run


def _again(group: pa.Table) -> pa.Table:
    """Grams of one range that occur more than once, listed for each block that holds them."""
    schema = pa.schema([("block", pa.int64()), ("grams", pa.binary())])
    by_block: dict[int, list[np.ndarray]] = {}
    for block, pack in zip(group.column("block").to_pylist(), group.column("grams").to_pylist(), strict=True):
        by_block.setdefault(block, []).append(np.frombuffer(pack, np.uint64))
    every = np.sort(np.concatenate([p for packs in by_block.values() for p in packs]))
    repeated = np.unique(every[1:][every[1:] == every[:-1]])
    rows = []
    for block, packs in by_block.items():
        own = np.unique(np.concatenate(packs))
        own = own[among(own, repeated)]
        if len(own):
            rows.append((block, own.tobytes()))
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


CANDIDATES = (
    "fp long, c1 long, c2 long, block long, d1 long, d2 long, id long, first int, count int, times int, anchor int, content binary"
)


def _cutter(scheme: Scheme):
    schema = pa.schema(
        [("fp", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("block", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
         ("id", pa.int64()), ("first", pa.int32()), ("count", pa.int32()), ("times", pa.int32()), ("anchor", pa.int32()),
         ("content", pa.binary())]
    )

    def run(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        wanted = wanted_grams(repeated.column("grams").to_pylist())
        rows: list[tuple] = []
        seen: set[bytes] = set()
        if len(wanted):
            meta = zip(*[docs.column(c).to_pylist() for c in ("block", "d1", "d2", "id")], strict=True)
            for (block, d1, d2, own), raw in zip(meta, raw_texts(docs), strict=True):
                flat, found, starts, ends = scheme.cut(raw)
                for k in np.flatnonzero(among(found.gram, wanted)).tolist():
                    first, count = int(found.first[k]), int(found.count[k])
                    content = flat[starts[first] : ends[first + count + scheme.width - 2]]
                    digest = xxhash.xxh3_128_digest(content)
                    c1, c2 = np.frombuffer(digest, np.int64).tolist()
                    fp = int(found.gram[k].view(np.int64))
                    anchor = int(found.anchor[k]) - first
                    rows.append((fp, c1, c2, block, d1, d2, own, first, count, int(found.times[k]), anchor, None))
                    if digest not in seen:
                        seen.add(digest)
                        rows.append((fp, c1, c2, block, None, None, None, None, count, None, anchor, content))
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def repeated_grams(texts: Texts, scheme: Scheme) -> DataFrame:
    """(home, grams): packed anchor grams that occur more than once in the corpus, for each block that holds them."""
    packs = texts.rows.select("block", "text").mapInArrow(_packer(scheme, texts.ranges), "range long, block long, grams binary")
    repeated = packs.groupBy("range").applyInArrow(_again, "block long, grams binary")
    return repeated.select(F.col("block").alias("home"), "grams")


def wanted_grams(packs: list[bytes]) -> np.ndarray:
    """Sorted grams of a block's packs."""
    parts = [np.frombuffer(p, np.uint64) for p in packs]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def candidates(texts: Texts, scheme: Scheme) -> DataFrame:
    """Stored rows: occurrences (content null) and, once for each block, distinct contexts with their bytes.

    ``fp`` is the anchor gram, (c1, c2) the context's 128-bit hash, ``first`` and
    ``count`` its windows in the document (d1, d2), ``times`` how often it follows itself
    there, ``anchor`` where the gram starts inside the context, in symbols.
    """
    found = (
        texts.rows.groupBy("block")
        .cogroup(repeated_grams(texts, scheme).groupBy("home"))
        .applyInArrow(_cutter(scheme), CANDIDATES)
    )
    return durable(found, "contexts")


def units(members: DataFrame, unit_bytes: int) -> DataFrame:
    """Deal members (fp, c1, c2, content, ...) out in units of about ``unit_bytes`` that are compared inside.

    Small grams are packed together by hash. A gram whose contexts exceed a unit is cut
    in ceil(bytes / unit_bytes) parts, and each pair of parts is a unit: ``unit`` names
    it, ``side`` is 0 or 1 (always 0 where a part meets itself). Whatever two contexts
    of a gram, one unit holds both.
    """
    size = members.groupBy("fp").agg(F.sum(F.length("content").cast("long")).alias("bytes"))
    size = durable(size.withColumn("parts", F.ceil(F.col("bytes") / unit_bytes).cast("long")), "gram-sizes")
    total = size.where("parts = 1").agg(F.sum("bytes")).first()[0] or 0
    bins = max(1, math.ceil(total / unit_bytes))
    dealt = members.join(size.select("fp", "parts"), "fp").withColumn("own", F.pmod(F.xxhash64("c1", "c2"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    unit = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("fp"), F.lit(bins))).otherwise(F.xxhash64("fp", low, high))
    dealt = dealt.withColumn("unit", unit).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    return spread(dealt.drop("own", "other"), "unit").sortWithinPartitions("unit")


def shared_extents(items: list[tuple[list, list]]) -> list[tuple[int, int]]:
    """For (left, right) sequences around one anchor: how far each agrees with any other, to the left and to the right.

    ``left`` is given from the anchor outwards. A window that reaches further than this
    on either side is not repeated.
    """
    out = []
    for side in (0, 1):
        order = sorted(range(len(items)), key=lambda k: items[k][side])
        reach = [0] * len(items)
        for a, b in zip(order, order[1:], strict=False):
            n = common(items[a][side], items[b][side])
            reach[a], reach[b] = max(reach[a], n), max(reach[b], n)
        out.append(reach)
    return list(zip(*out, strict=True))


def common(a, b) -> int:
    """Length of the longest common beginning of two sequences."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low
