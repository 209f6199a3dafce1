"""Benchmark passages in documents, by pieces and bit-parallel edit distance.

A passage of m characters may differ from its item in k = floor(rate * m) edits. Cut
in k + 1 pieces, at least one piece stands in the document unchanged, since k edits
cannot touch them all. One Aho-Corasick automaton finds the exact hits of all pieces
in a single run over a text; around each hit Myers' bit-parallel recursion finds the
smallest edit distance between the whole item and any stretch of the text.

Items are compared in slices of bounded size, so what is broadcast never exceeds the
slice however large the benchmark is; documents are read once for each slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import batch_of, durable, narrow

RATE = 0.08  # edits allowed for each character of an item
SLICE_CHARS = 1 << 20  # characters of items compared in one run over the documents

Item = tuple[int, str]


def normalised(text: str) -> str:
    """Lower case, white space runs as one blank: what is compared."""
    return " ".join(text.lower().split())


def piece_borders(length: int, budget: int) -> list[int]:
    """Borders of budget + 1 pieces of nearly equal length; fewer where the text is shorter."""
    count = min(budget + 1, length)
    return [length * k // count for k in range(count + 1)]


def myers(pattern: str, masks: dict[str, int], text: str, budget: int) -> tuple[int, int] | None:
    """(smallest edit distance of ``pattern`` to a stretch of ``text``, first end of such a stretch), within budget."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (budget + 1, -1)
    for at, c in enumerate(text):
        equal = masks.get(c, 0)
        x = (((equal & plus) + plus) ^ plus) | equal
        down = equal | minus
        grow = minus | (~(x | plus) & full)
        shrink = plus & x
        if grow & top:
            score += 1
        elif shrink & top:
            score -= 1
        grow, shrink = grow << 1 & full, shrink << 1 & full
        plus = shrink | (~(down | grow) & full)
        minus = grow & down
        if score < best[0]:
            best = (score, at + 1)
            if not score:
                break
    return best if best[0] <= budget else None


class Matcher:
    """All pieces of a slice of items, with what is needed to verify their hits."""

    def __init__(self, items: list[Item], rate: float) -> None:
        import ahocorasick

        self.items: list[tuple[int, str, int, dict[str, int]]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            pattern = normalised(text)
            if not pattern:
                continue
            budget = math.floor(rate * len(pattern))
            masks: dict[str, int] = {}
            for k, c in enumerate(pattern):
                masks[c] = masks.get(c, 0) | 1 << k
            number = len(self.items)
            self.items.append((item_id, pattern, budget, masks))
            borders = piece_borders(len(pattern), budget)
            for a, b in zip(borders, borders[1:], strict=False):
                pieces.setdefault(pattern[a:b], []).append((number, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int]]:
        """(item id, smallest edit distance) of the items that ``text`` holds."""
        if not self.items:
            return []
        whole = normalised(text)
        begins: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(whole):
            for number, offset in where:
                begins.setdefault(number, []).append(end + 1 - size - offset)
        found = []
        for number, starts in begins.items():
            item_id, pattern, budget, masks = self.items[number]
            best = None
            reach = len(pattern) + budget
            low, high = 0, -1
            # windows of neighbouring hits are one window, so each stretch is verified once
            for start in [*sorted(set(starts)), None]:
                if start is not None and high >= 0 and start - budget <= high:
                    high = start + reach
                    continue
                if high >= 0:
                    window = whole[low:high]
                    hit = (0, 0) if pattern in window else myers(pattern, masks, window, budget)
                    if hit and (best is None or hit[0] < best):
                        best = hit[0]
                if start is not None:
                    low, high = max(0, start - budget), max(0, start + reach)
            if best is not None:
                found.append((item_id, best))
        return sorted(found, key=lambda x: (x[0] is None, x))


HIT = pa.struct([("item_id", pa.int64()), ("distance", pa.int32())])


def _finder(items: list[Item], rate: float):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("hits", pa.list_(HIT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in batches:
            rows = []
            for k1, k2, text in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "text")], strict=True):
                found = matcher.matches(text)
                if found:
                    rows.append((k1, k2, [{"item_id": i, "distance": d} for i, d in found]))
            if rows:
                yield batch_of(schema, dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = RATE,
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """One row for every row of ``docs`` with the benchmark items that its whole text holds.

    An item is held if some stretch of the text is within floor(rate * length) edits of
    it, both in lower case with white space runs as one blank. Null and empty texts hold
    nothing, null and empty items are held by nothing; items with one id are one item.
    Repeated rows keep a row each; empty tables give nothing held or an empty result.
    Columns: id_col, contaminated, hits (array of item_id and distance, by item_id).
    """
    items = narrow(benchmark, id=item_id_col, text=item_text_col).drop("uid").distinct()
    items = durable(items.where(F.trim("text") != ""), "items")
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    slices = max(1, math.ceil(chars / slice_chars))
    keyed = narrow(docs, id=id_col, text=text_col).withColumn("k1", F.xxhash64("id", "text")).withColumn("k2", F.xxhash64("text", F.lit(4), "id"))
    hits = None
    for k in range(slices):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k)
        some = [(r.id, r.text) for r in own.collect()]  # about slice_chars characters
        found = keyed.select("k1", "k2", "text").mapInArrow(_finder(some, rate), "k1 long, k2 long, hits array<struct<item_id:long,distance:int>>")
        found = durable(found, "item-hits") if slices > 1 else found
        hits = found if hits is None else hits.union(found)
    held = hits.select("k1", "k2", F.inline("hits")).groupBy("k1", "k2", "item_id").agg(F.min("distance").alias("distance"))
    held = held.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("item_id", "distance"))).alias("hits"))
    none = F.array().cast("array<struct<item_id:long,distance:int>>")
    listed = keyed.select("id", "k1", "k2").join(held, ["k1", "k2"], "left").withColumn("hits", F.coalesce("hits", none))
    return listed.select(F.col("id").alias(id_col), (F.size("hits") > 0).alias("contaminated"), "hits")
