"""Removal of repeated byte strings with suffix arrays.

Contexts of repeated anchor grams (see ``repeats``) are the text; a shard is a unit of
contexts that may share windows. Each shard gets a suffix array by Larsson-Sadakane
refinement: suffixes are ranked by their first bytes, and only groups that are still
tied are sorted again by the rank of the suffix that lies as far ahead as is settled
already, which doubles the settled length. Kasai's recursion gives the common prefixes
of neighbours. Contexts of a gram too frequent for one shard lie in several; two such
shards are merged by binary search of one shard's suffixes in the other's array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm import repeats
from flowsieve.llm.common import durable, runs
from flowsieve.session import small_side

STOP = 0xFF  # ends a context; no UTF-8 text holds this byte


class Shard:
    """Texts laid end to end with their suffix array; suffixes end with their text."""

    def __init__(self, texts: list[bytes], depth: int) -> None:
        self.depth = depth
        gap = bytes([STOP]) * 8
        self.starts = np.cumsum([0] + [len(t) + 8 for t in texts])[:-1].astype(np.int64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(gap.join(texts) + gap * (depth // 8 + 3), np.uint8)
        word = self.data.astype(np.uint64)
        for step in (1, 2, 4):
            ahead = np.concatenate([word[step:], np.full(step, word[-1])])
            word = (word << np.uint64(8 * step)) | ahead
        self.word = word  # the eight bytes from each position, first byte on top
        real = np.ones(int(self.starts[-1] + self.sizes[-1]) if len(texts) else 0, bool)
        for e, s in zip((self.starts + self.sizes)[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            real[e:s] = False
        self.order = self._sorted(np.flatnonzero(real))
        self.place = np.zeros(len(self.data), np.int64)
        self.place[self.order] = np.arange(len(self.order))

    def _sorted(self, at: np.ndarray) -> np.ndarray:
        key = self.word[at]
        by = np.argsort(key)
        order, key = at[by], key[by]
        ends = key & np.uint64(0xFF) == np.uint64(STOP)  # these reach their text's end within eight bytes
        tail = np.flatnonzero(ends)
        order[tail] = order[tail][np.lexsort((order[tail], key[tail]))]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | ends[1:]
        index = np.arange(len(order))
        # text ends come after every byte and differ from each other, in text order
        rank = len(order) + np.arange(len(self.data) + 1)
        most = len(order) + len(rank)
        rank[order] = np.maximum.accumulate(np.where(new, index, 0))
        settled = 8
        while True:  # contexts are short, so a few doublings settle all ties
            tied = np.flatnonzero(~(new & np.append(new[1:], True)))
            if not len(tied):
                return order
            here = order[tied]
            key = rank[here] * most + rank[np.minimum(here + settled, len(self.data))]
            by = np.argsort(key)
            order[tied], key = here[by], key[by]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            new[tied] = fresh
            rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0))
            settled *= 2

    def repeated(self) -> np.ndarray:
        """Starts of strings of ``depth`` bytes that also start elsewhere, by Kasai's recursion.

        All texts advance side by side: the common prefix of a suffix with its
        neighbour is at least that of the suffix before it, less one.
        """
        flagged = np.zeros(len(self.data), bool)
        windows = self.sizes - self.depth + 1
        active = np.flatnonzero(windows > 0)
        active = active[np.argsort(-windows[active])]
        length = np.zeros(len(active), np.int64)
        for offset in range(int(windows[active].max(initial=0))):
            active = active[: np.searchsorted(-windows[active], -offset, side="left")]
            length = np.maximum(length[: len(active)] - 1, 0)
            here = self.starts[active] + offset
            k = self.place[here]
            before = self.order[np.maximum(k - 1, 0)]
            length[k == 0] = 0
            length = self._extended(here, before, length, k > 0)
            hit = length >= self.depth
            flagged[here[hit]] = True
            flagged[before[hit]] = True
        return flagged

    def _extended(self, a: np.ndarray, b: np.ndarray, length: np.ndarray, open_: np.ndarray) -> np.ndarray:
        length = length.copy()
        todo = np.flatnonzero(open_ & (length < self.depth))
        while len(todo):
            odd = self.word[a[todo] + length[todo]] ^ self.word[b[todo] + length[todo]]
            length[todo] += _leading(odd)
            todo = todo[(odd == 0) & (length[todo] < self.depth)]
        return np.minimum(length, self.depth)

    def found_in(self, other: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of this shard's windows in another's array: (own flags, the other's flags)."""
        mine, theirs = np.zeros(len(self.data), bool), np.zeros(len(other.data), bool)
        asked = self.order[self._is_window(self.order)]
        listed = other.order[other._is_window(other.order)]
        if not len(asked) or not len(listed):
            return mine, theirs
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(listed))
        while (low < high).any():  # the first listed window that is not smaller
            middle = np.minimum((low + high) // 2, len(listed) - 1)
            less = self._compare(asked, other, listed[middle]) > 0
            go = low < high
            low, high = np.where(go & less, middle + 1, low), np.where(go & ~less, middle, high)
        at = np.minimum(low, len(listed) - 1)
        same = (low < len(listed)) & (self._compare(asked, other, listed[at]) == 0)
        mine[asked[same]] = True
        theirs[listed[at[same]]] = True
        # equal windows of the other shard stand next to each other
        k = np.unique(at[same])
        while len(k):
            k = k[k + 1 < len(listed)]
            k = k[other._compare(listed[k], other, listed[k + 1]) == 0] + 1
            k = k[~theirs[listed[k]]]
            theirs[listed[k]] = True
        return mine, theirs

    def _is_window(self, at: np.ndarray) -> np.ndarray:
        text = np.searchsorted(self.starts, at, side="right") - 1
        return at - self.starts[text] + self.depth <= self.sizes[text]

    def _compare(self, a: np.ndarray, other: Shard, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the first ``depth`` bytes at a are less, equal or more than the other's at b."""
        out = np.zeros(len(a), np.int64)
        todo = np.arange(len(a))
        for step in range(0, self.depth, 8):
            if not len(todo):
                break
            x, y = self.word[a[todo] + step], other.word[b[todo] + step]
            if self.depth - step < 8:
                cut = np.uint64(8 * (8 - self.depth + step))
                x, y = x >> cut, y >> cut
            out[todo] = (x > y).astype(np.int64) - (x < y)
            todo = todo[x == y]
        return out


def _leading(odd: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two words from their exclusive or."""
    out = np.zeros(len(odd), np.int64)
    for k in range(1, 9):
        out += odd >> np.uint64(64 - 8 * k) == 0
    return out


def _spans(flags: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Runs of flagged starts as byte spans."""
    padded = np.concatenate([[False], flags, [False]])
    change = np.flatnonzero(padded[1:] != padded[:-1])
    return [(a, b - 1 + width) for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True)]


def resolved(rows: list[tuple[int, int, bytes, int]], width: int) -> list[list[tuple[int, int]]]:
    """For contexts (gram, anchor, bytes, side) of one unit: byte spans covered by repeated windows.

    Each context is first trimmed to what it shares with any other of its gram; equal
    trimmed contexts are one text of the suffix array, and their windows are repeated.
    """
    groups: dict[int, list[int]] = {}
    for k, row in enumerate(rows):
        groups.setdefault(row[0], []).append(k)
    trimmed: dict[tuple[int, bytes], list[tuple[int, int]]] = {}  # (side, text): (context, offset)
    for gram in groups.values():
        if len(gram) < 2:
            continue
        around = [(rows[k][2][: rows[k][1]][::-1], rows[k][2][rows[k][1] :]) for k in gram]
        for k, (left, right) in zip(gram, repeats.shared_extents(around), strict=True):
            if left + right >= width:
                at = rows[k][1] - left
                trimmed.setdefault((rows[k][3], rows[k][2][at : rows[k][1] + right]), []).append((k, at))
    flags: dict[tuple[int, bytes], np.ndarray] = {}
    shards: dict[int, tuple[list[bytes], Shard]] = {}
    for side in sorted({s for s, _ in trimmed}):
        texts = [t for s, t in trimmed if s == side]
        shards[side] = texts, Shard(texts, width)
    found = {side: shard.repeated() for side, (_, shard) in shards.items()}
    if len(shards) == 2:
        mine, theirs = shards[1][1].found_in(shards[0][1])
        found[1] |= mine
        found[0] |= theirs
    for side, (texts, shard) in shards.items():
        for k, t in enumerate(texts):
            own = found[side][shard.starts[k] : shard.starts[k] + len(t) - width + 1]
            flags[side, t] = np.ones_like(own) if len(trimmed[side, t]) > 1 else own
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    for key, where in trimmed.items():
        spans = _spans(flags[key], width)
        for k, at in where:
            out[k] = [(a + at, b + at) for a, b in spans]
    return out


def _resolver(width: int):
    schema = pa.schema([("fp", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "unit"):
            unit = table.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                some = table.slice(lo, hi - lo)
                keys = [some.column(c).to_pylist() for c in ("fp", "c1", "c2")]
                rows = list(zip(keys[0], *[some.column(c).to_pylist() for c in ("anchor", "content", "side")], strict=True))
                rows_out = [
                    (keys[0][k], keys[1][k], keys[2][k], a, b) for k, spans in enumerate(resolved(rows, width)) for a, b in spans
                ]
                if rows_out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, f.type) for v, f in zip(zip(*rows_out, strict=True), schema, strict=True)], schema=schema
                    )

    return run


REMOVED = "id long, n_bytes long, spans array<struct<begin:int,end:int>>, kept binary"


def _remover(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """Texts of a block without the bytes that their spans cover."""
    by_doc: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d1, d2, a, b in zip(*[spans.column(c).to_pylist() for c in ("s1", "s2", "begin", "end")], strict=True):
        by_doc.setdefault((d1, d2), []).append((a, b))
    ids, sizes, cut, kept = docs.column("id").to_pylist(), [], [], []
    keys = zip(docs.column("d1").to_pylist(), docs.column("d2").to_pylist(), strict=True)
    for key, raw in zip(keys, repeats.raw_texts(docs), strict=True):
        merged: list[list[int]] = []
        for a, b in sorted(by_doc.get(key, ())):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        rest, at = [], 0
        for a, b in merged:
            rest.append(raw[at:a])
            at = b
        rest.append(raw[at:])
        sizes.append(len(raw))
        cut.append([{"begin": a, "end": b} for a, b in merged])
        kept.append(b"".join(rest))
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])
    return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip((ids, sizes, cut, kept), schema, strict=True)], schema=schema)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    scheme: repeats.Scheme = repeats.BYTES,
    unit_bytes: int = repeats.UNIT_BYTES,
) -> DataFrame:
    """Remove every byte covered by a string of ``scheme.width`` bytes that starts anywhere else, too.

    Strings never cross texts; overlaps and repeats within one text count; all copies
    go, judged on the input. Null text counts as empty. Every row gives one row,
    repeated rows (which are copies of each other) and null ids included; an empty
    table gives an empty result. Columns: id_col, n_bytes, spans (removed byte ranges),
    kept (the remaining bytes, which may break a character).
    """
    width = scheme.width
    texts = repeats.prepared(docs, id_col, text_col)
    found = repeats.candidates(texts, scheme)
    seen = found.where("content is null")
    contexts = seen.groupBy("fp", "c1", "c2").agg(F.sum("times").alias("times"), F.max("count").alias("count"))
    contexts = durable(contexts, "context-counts")
    grams = contexts.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1").select("fp")
    grams = small_side(grams, "mixed-grams")
    # the bytes meet by context, not by gram, so those of a frequent gram lie in all tasks
    mixed = contexts.select("fp", "c1", "c2").join(grams, "fp", "left_semi")
    members = found.where("content is not null").join(mixed, ["fp", "c1", "c2"], "left_semi")
    members = members.groupBy("fp", "c1", "c2").agg(F.max("content").alias("content"), F.max("anchor").alias("anchor"))
    judged = repeats.units(durable(members, "members"), unit_bytes).select("unit", "side", "fp", "c1", "c2", "anchor", "content")
    partly = judged.mapInArrow(_resolver(width), "fp long, c1 long, c2 long, begin int, end int")
    whole = contexts.where("times > 1").select("fp", "c1", "c2", F.lit(0).alias("begin"), (F.col("count") + width - 1).alias("end"))
    spans = whole.union(partly)
    # a context that follows itself is repeated as a whole, and its copies overlap
    further = (F.col("times") - 1) * F.col("count")
    placed = seen.select(
        "fp", "c1", "c2", "block", F.col("d1").alias("s1"), F.col("d2").alias("s2"), "first", further.alias("further")
    ).join(spans, ["fp", "c1", "c2"])
    end = (F.col("first") + F.col("further") + F.col("end")).cast("int")
    placed = placed.select(
        F.col("block").alias("home"), "s1", "s2", (F.col("first") + F.col("begin")).alias("begin"), end.alias("end")
    ).distinct()
    kept = texts.rows.groupBy("block").cogroup(placed.groupBy("home")).applyInArrow(_remover, REMOVED)
    return kept.withColumnRenamed("id", id_col)
