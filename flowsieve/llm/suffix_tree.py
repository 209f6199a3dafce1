"""Removal of word sequences that an earlier document holds, with prefix-partitioned suffix trees.

The suffixes are the windows of contexts of repeated anchor grams (see ``repeats``),
each as deep as a window. They are partitioned by prefixes of variable length, so that
the suffixes of every prefix fit in memory. The first prefix is the anchor gram itself,
which all equal windows share at the same distance; grams are packed into units of
bounded size. The windows of a gram too frequent for that are divided by their own
first words, and a prefix that still holds too many is lengthened, word by word in
steps, up to the whole window.

Each prefix gets a suffix tree of its own. Internal nodes as deep as a window are the
maximal repeats; the smallest document order among a node's leaves says which came
first. Windows that are too many even under their whole length have nothing left to
branch on: their node is an aggregate.

Blocks of documents send each distinct context once and get back, for the contexts
they hold, which windows an earlier document has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm import repeats
from flowsieve.llm.common import durable, packed, runs, spread, unpacked

LARGEST_ID = (1 << 63) - 1  # order of a null id: after every number
SUFFIXES = 20_000  # most suffixes of one tree

CONTEXTS = "fp long, c long, block long, least long, most long, windows int, anchor int, content binary"
KNOWN = "fp long, c long, block long, `from` int, windows int, m long"


def _content_key(content: bytes) -> int:
    """Signed 64-bit hash of a context; with its gram's it names the context."""
    key = xxhash.xxh3_64_intdigest(content)
    return key - (1 << 64) if key >> 63 else key


def _contexts(scheme: repeats.Scheme):
    """Distinct contexts of a block's repeated grams, with the smallest and largest order that hold them."""
    schema = pa.schema(
        [("fp", pa.int64()), ("c", pa.int64()), ("block", pa.int64()), ("least", pa.int64()), ("most", pa.int64()),
         ("windows", pa.int32()), ("anchor", pa.int32()), ("content", pa.binary())]
    )

    def run(blobs: pa.Table, repeated: pa.Table) -> pa.Table:
        wanted = repeats.wanted_grams(repeated.column("grams").to_pylist())
        seen: dict[tuple[int, bytes], list] = {}
        docs = unpacked(blobs.column("blob"))
        if len(wanted) and docs is not None:
            ids = docs.column("id").to_pylist()
            for own, raw in zip(ids, repeats.raw_texts(docs), strict=True):
                rank = LARGEST_ID if own is None else own
                flat, found, starts, ends = scheme.cut(raw)
                at = np.flatnonzero(repeats.among(found.gram, wanted))
                first, count = found.first[at], found.count[at]
                begins, stops = starts[first].tolist(), ends[first + count + scheme.width - 2].tolist()
                anchors = (found.anchor[at] - first).tolist()
                grams = found.gram[at].view(np.int64).tolist()
                for fp, a, b, n, anchor in zip(grams, begins, stops, count.tolist(), anchors, strict=True):
                    key = fp, flat[a:b]
                    old = seen.get(key)
                    if old is None:
                        seen[key] = [rank, rank, n, anchor]
                    elif rank < old[0]:
                        old[0] = rank
                    elif rank > old[1]:
                        old[1] = rank
        block = blobs.column("block")[0].as_py() if blobs.num_rows else 0
        rows = [(fp, _content_key(content), block, *facts, content) for (fp, content), facts in seen.items()]
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _trees(width: int):
    """Units of whole grams: what an earlier document holds of each context, for each block that has it."""
    schema = pa.schema(
        [("fp", pa.int64()), ("c", pa.int64()), ("block", pa.int64()), ("from", pa.int32()), ("windows", pa.int32()), ("m", pa.int64())]
    )

    def known(contexts: list[tuple[int, int, bytes, int]]) -> list[list[tuple[int, int, int]]]:
        """(from, windows, smallest order of another context) for contexts (windows, anchor, content, least) of one gram."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in contexts]
        if len(contexts) < 2:
            return out
        words = [content.split(b" ") for _, _, content, _ in contexts]
        around = [(w[:anchor][::-1], w[anchor:]) for w, (_, anchor, _, _) in zip(words, contexts, strict=True)]
        leaves = []
        for k, (left, right) in enumerate(repeats.shared_extents(around)):
            anchor = contexts[k][1]
            for at in range(anchor - left, anchor + right - width + 1):
                leaves.append((words[k][at : at + width], k, at))
        leaves.sort()
        for a, b in Subtree([suffix for suffix, _, _ in leaves]).deep(width):
            some = leaves[a : b + 1]
            m = min(contexts[k][3] for _, k, _ in some)
            for _, k, at in some:
                if contexts[k][3] > m:
                    out[k].append((at, 1, m))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("fp", "c", "block", "least", "most", "windows", "anchor", "content")
        for unit in _units(batches):
            grams: dict[int, dict[int, list]] = {}
            for fp, c, block, least, most, windows, anchor, content in zip(*[unit.column(n).to_pylist() for n in names], strict=True):
                entry = grams.setdefault(fp, {}).setdefault(c, [windows, anchor, content, least, []])
                entry[3] = min(entry[3], least)
                entry[4].append((block, most))
            rows = []
            for fp, by_content in grams.items():
                found = known([tuple(e[:4]) for e in by_content.values()])
                for (c, (windows, _, _, least, blocks)), other in zip(by_content.items(), found, strict=True):
                    for block, most in blocks:
                        if least < most:
                            rows.append((fp, c, block, 0, windows, least))
                        rows += [(fp, c, block, at, n, m) for at, n, m in other if m < most]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The contexts of one unit after the other."""
    for table in runs(batches, "unit"):
        unit = table.column("unit").to_numpy()
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield unpacked(table.column("blob").slice(lo, hi - lo))


class Subtree:
    """Suffix tree over sorted suffixes: internal nodes with their depth in words and their leaves."""

    def __init__(self, suffixes: list[list]) -> None:
        self.nodes: list[tuple[int, int, int]] = []  # depth, first leaf, last leaf
        open_: list[tuple[int, int]] = []  # depth, first leaf
        for k in range(1, len(suffixes) + 1):
            depth = -1 if k == len(suffixes) else repeats.common(suffixes[k - 1], suffixes[k])
            first = k - 1
            while open_ and open_[-1][0] > depth:
                own, first = open_.pop()
                self.nodes.append((own, first, k - 1))
            if depth >= 0 and (not open_ or open_[-1][0] < depth):
                open_.append((depth, first))

    def deep(self, depth: int) -> list[tuple[int, int]]:
        """Leaves (first, last) of the nodes that are at least ``depth`` words deep and whose parents are not."""
        found = sorted((a, -b) for own, a, b in self.nodes if own >= depth)
        out: list[tuple[int, int]] = []
        for a, b in found:
            if not out or a > out[-1][1]:
                out.append((a, -b))
        return out


def _grower(width: int):
    schema = pa.schema([("fp", pa.int64()), ("c", pa.int64()), ("from", pa.int32()), ("m", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "level", "prefix"):
            level, prefix = table.column("level").to_numpy(), table.column("prefix").to_numpy()
            least, suffixes = table.column("least").to_numpy(), table.column("suffix").to_pylist()
            cuts = [0, *(np.flatnonzero((level[1:] != level[:-1]) | (prefix[1:] != prefix[:-1])) + 1).tolist(), len(level)]
            chosen: list[int] = []
            first: list[int] = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2:
                    continue
                for a, b in Subtree([x.split(" ") for x in suffixes[lo:hi]]).deep(width):
                    own = least[lo + a : lo + b + 1]
                    m = int(own.min())
                    for k in np.flatnonzero(own > m).tolist():
                        chosen.append(lo + a + k)
                        first.append(m)
            if chosen:
                some = table.take(pa.array(chosen)).combine_chunks()
                columns = [some.column(c).combine_chunks() for c in ("fp", "c", "from")]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(first, pa.int64())], schema=schema)

    return run


def first_holders(texts: DataFrame, width: int, suffixes_of_tree: int = SUFFIXES) -> DataFrame:
    """(fp, c, from, m): windows of contexts (fp, c, least, text) that another context holds with a smaller order m.

    Windows are partitioned by their first words, as many as it takes to get at most
    ``suffixes_of_tree`` of them under a prefix.
    """
    words = F.split(F.col("text"), " ", -1)
    begins = F.sequence(F.lit(0), F.size("words") - width)
    suffixes = texts.withColumn("words", words).select("fp", "c", "least", "words", F.explode(begins).alias("from"))
    window = F.slice("words", F.col("from") + 1, width)
    suffixes = suffixes.select("fp", "c", "least", "from", window.alias("window"))
    levels = sorted({min(k, width) for k in (1, 2, 4, 8, width)})

    def prefix(level: int) -> Column:
        return F.xxhash64(F.slice("window", 1, level))

    every = F.inline(F.array(*[F.struct(F.lit(k).alias("level"), prefix(k).alias("prefix")) for k in levels]))
    heavy = suffixes.select(every).groupBy("level", "prefix").count().where(F.col("count") > suffixes_of_tree)
    heavy = durable(heavy.select("level", "prefix"), "heavy-prefixes")
    dealt = suffixes.select("fp", "c", "least", "from", F.array_join("window", " ").alias("suffix"), *[prefix(k).alias(f"p{k}") for k in levels])
    for k in levels:
        some = heavy.where(F.col("level") == k).select(F.col("prefix").alias(f"p{k}"), F.lit(True).alias(f"h{k}"))
        dealt = dealt.join(some, f"p{k}", "left")
    level = F.coalesce(*[F.when(F.col(f"h{k}").isNull(), k) for k in levels], F.lit(0))
    chosen = F.coalesce(*[F.when(F.col("level") == k, F.col(f"p{k}")) for k in levels], F.lit(0))
    dealt = dealt.withColumn("level", level).withColumn("prefix", chosen)
    dealt = durable(dealt.select("level", "prefix", "suffix", "fp", "c", "from", "least"), "suffixes")
    grown = spread(dealt.where("level > 0"), "level", "prefix").sortWithinPartitions("level", "prefix", "suffix")
    grown = grown.mapInArrow(_grower(width), "fp long, c long, from int, m long")
    endless = dealt.where("level = 0")
    single = endless.groupBy("suffix").agg(F.min("least").alias("m"))
    return grown.union(endless.join(single, "suffix").where("m < least").select("fp", "c", "from", "m"))


REMOVED = "id long, n_words long, spans array<struct<begin:int,end:int>>, kept string"


def _remover(scheme: repeats.Scheme):
    """Texts of a block without the words that windows of earlier documents cover."""
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("spans", span), ("kept", pa.string())])

    def run(blobs: pa.Table, known: pa.Table) -> pa.Table:
        docs = unpacked(blobs.column("blob"))
        if docs is None:
            return schema.empty_table()
        by_context: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for fp, c, at, n, m in zip(*[known.column(x).to_pylist() for x in ("fp", "c", "from", "windows", "m")], strict=True):
            by_context.setdefault((fp, c), []).append((at, n, m))
        wanted = np.unique(np.array([fp for fp, _ in by_context], np.int64).view(np.uint64))
        ids, sizes, cut, kept = docs.column("id").to_pylist(), [], [], []
        for own, raw in zip(ids, repeats.raw_texts(docs), strict=True):
            rank = LARGEST_ID if own is None else own
            words, covered = raw.split(), []
            if len(wanted) and len(words) >= scheme.width:
                flat, found, starts, ends = scheme.cut(raw)
                at = np.flatnonzero(repeats.among(found.gram, wanted))
                first, count = found.first[at], found.count[at]
                stops = ends[first + count + scheme.width - 2]
                # what is covered in a context that follows itself is covered in each copy, and these overlap
                further = ((found.times[at] - 1) * count).tolist()
                columns = (found.gram[at].view(np.int64).tolist(), first.tolist(), starts[first].tolist(), stops.tolist(), further)
                for fp, f, a, b, more in zip(*columns, strict=True):
                    for k, n, m in by_context.get((fp, _content_key(flat[a:b])), ()):
                        if m < rank:
                            covered.append((f + k, f + k + n + more + scheme.width - 1))
            merged: list[list[int]] = []
            for a, b in sorted(covered):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            rest, at = [], 0
            for a, b in merged:
                rest += words[at:a]
                at = b
            rest += words[at:]
            sizes.append(len(words))
            cut.append([{"begin": a, "end": b} for a, b in merged])
            kept.append(b" ".join(rest).decode())
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip((ids, sizes, cut, kept), schema, strict=True)], schema=schema)

    return run


def remove_seen_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    scheme: repeats.Scheme = repeats.WORDS,
    unit_bytes: int = repeats.UNIT_BYTES,
    suffixes_of_tree: int = SUFFIXES,
) -> DataFrame:
    """Remove every word covered by a window whose words also start in a document with a smaller id.

    Words are separated by ASCII white space and unchanged; a window is ``scheme.width``
    words of one document; all is judged on the input. Null text has no words. A null
    id comes after every number, so its copies go. Rows that repeat an id keep what
    they share. Every row gives one row, an empty table an empty result. Columns:
    id_col, n_words, spans (removed word ranges), kept (words joined by one space).
    """
    width = scheme.width
    texts = repeats.prepared(docs, id_col, text_col)
    blobs = packed(texts.rows.select("block", "id", "text"), "block")
    found = blobs.groupBy("block").cogroup(repeats.repeated_grams(texts, scheme).groupBy("home"))
    contexts = durable(found.applyInArrow(_contexts(scheme), CONTEXTS), "contexts")

    sizes = contexts.groupBy("fp").agg(F.sum(F.length("content").cast("long")).alias("bytes"))
    sizes = durable(sizes, "gram-sizes")
    large = durable(sizes.where(F.col("bytes") > unit_bytes).select("fp"), "frequent-grams")
    total = sizes.agg(F.sum(F.when(F.col("bytes") <= unit_bytes, F.col("bytes")))).first()[0] or 0
    units = max(1, math.ceil(total / unit_bytes))

    # grams that fit in memory, many to a unit
    dealt = contexts.join(large, "fp", "left_anti").withColumn("unit", F.pmod(F.xxhash64("fp"), F.lit(units)))
    dealt = dealt.select("unit", "fp", "c", "block", "least", "most", "windows", "anchor", "content")
    dealt = spread(packed(dealt, "unit"), "unit").sortWithinPartitions("unit")
    near = dealt.mapInArrow(_trees(width), KNOWN)

    # the others, by their windows' first words
    frequent = durable(contexts.join(large, "fp", "left_semi"), "frequent-contexts")
    merged = frequent.groupBy("fp", "c").agg(
        F.min("least").alias("least"), F.max("windows").alias("windows"), F.max("content").cast("string").alias("text")
    )
    merged = durable(merged, "frequent-texts")
    earlier = first_holders(merged.select("fp", "c", "least", "text"), width, suffixes_of_tree)
    far = earlier.select("fp", "c", "from", F.lit(1).alias("windows"), "m").union(
        merged.select("fp", "c", F.lit(0).alias("from"), "windows", F.col("least").alias("m"))
    )
    far = frequent.select("fp", "c", "block", "most").join(far, ["fp", "c"]).where("m < most")

    known = near.union(far.select("fp", "c", "block", "from", "windows", "m")).withColumnRenamed("block", "home")
    kept = blobs.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(_remover(scheme), REMOVED)
    return kept.withColumnRenamed("id", id_col)
