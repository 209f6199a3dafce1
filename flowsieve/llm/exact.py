"""Exact dedup over content-defined chunk recipes.

Every text becomes a list of chunks whose borders follow its content. A chunk's bytes
travel once, to the home of its hash, where equal hashes are compared byte by byte and
get a verified identifier. From then on a text is its ordered list of identifiers:
two texts are equal when the lists are equal, and only lists are shuffled.

A chunk that a task has met before is compared there and does not travel again, so a
text or passage that a third of all rows share is shipped at most once by each task
and flush, and no task gathers its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import LOWER, batch_of, durable, narrow, runs, spread, text_bytes

WINDOW = 32  # bytes the rolling hash looks back
MEAN_BITS = 11  # a border follows about every 2 KB
LEAST, MOST = 256, 16_384  # chunk sizes
HELD_BYTES = 48 << 20  # chunk bytes a task remembers for comparing

# kind 0: a document with its recipe; kind 1: a chunk with its bytes
SHIPPED = "kind tinyint, h binary, task long, variant int, content binary, uid long, id long, sha string, recipe binary"
VERIFIED = "kind tinyint, h binary, task long, variant int, ordinal int, uid long, id long, sha string, recipe binary"


def _gear() -> np.ndarray:
    """One odd-looking number per byte value, from a fixed seed."""
    return np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Gear hash of the last ``WINDOW`` bytes at every byte, by doubling the window."""
    h, width = gear[data], 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    return h


def chunk_ends(data: np.ndarray, gear: np.ndarray) -> list[int]:
    """Where the chunks of one text end; a border depends only on the bytes before it."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    found = np.flatnonzero(rolling_hash(data, gear) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    ends, start = [], 0
    for end in found.tolist():
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST:
            ends.append(end)
            start = end
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def _chunker(hash_bytes: int):
    schema = pa.schema(
        [
            ("kind", pa.int8()), ("h", pa.binary()), ("task", pa.int64()), ("variant", pa.int32()),
            ("content", pa.binary()), ("uid", pa.int64()), ("id", pa.int64()), ("sha", pa.string()),
            ("recipe", pa.binary()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gear, task = _gear(), TaskContext.get().partitionId() << 24
        seen: dict[bytes, list[bytes]] = {}
        held = 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            lowered = LOWER[data]
            rows: list[tuple] = []
            ids, uids = batch.column("id").to_pylist(), batch.column("uid").to_pylist()
            for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                text, raw = lowered[lo:hi], lowered[lo:hi].tobytes()
                recipe, start = [], 0
                for end in chunk_ends(text, gear):
                    content = raw[start:end]
                    start = end
                    h = xxhash.xxh3_128_digest(content)[:hash_bytes]
                    known = seen.setdefault(h, [])
                    if content not in known:
                        known.append(content)
                        held += len(content)
                        rows.append((1, h, task, len(known) - 1, content, 0, None, None, None))
                    variant = known.index(content)
                    recipe.append(h + variant.to_bytes(4, "big"))
                sha = hashlib.sha256(raw).hexdigest()
                rows.append((0, None, task, 0, None, uids[k], ids[k], sha, b"".join(recipe)))
                if held > HELD_BYTES:  # forget; what comes later is told apart by its own number
                    seen, held, task = {}, 0, task + 1
            yield batch_of(schema, dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    return cut


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the distinct contents of each hash; only hashes with more than one are reported."""
    schema = pa.schema(
        [
            ("kind", pa.int8()), ("h", pa.binary()), ("task", pa.int64()), ("variant", pa.int32()),
            ("ordinal", pa.int32()), ("uid", pa.int64()), ("id", pa.int64()), ("sha", pa.string()),
            ("recipe", pa.binary()),
        ]
    )
    batches, rest = iter(batches), ()
    for batch in batches:  # documents come first and pass through
        n = int((batch.column("kind").to_numpy() == 0).sum())
        if n:
            docs = pa.Table.from_batches([batch.slice(0, n)]).drop_columns(["content"])
            docs = docs.append_column("ordinal", pa.nulls(n, pa.int32())).select(schema.names)
            yield from docs.cast(schema).to_batches()
        if n < batch.num_rows:
            rest = chain([batch.slice(n)], batches)
            break
    for chunks in runs(rest, "h"):
        rows, begin = [], 0
        hashes, contents = chunks.column("h").to_pylist(), chunks.column("content")
        for end in range(1, len(hashes) + 1):
            if end < len(hashes) and hashes[end] == hashes[begin]:
                continue
            if end - begin > 1:
                number: dict[bytes, int] = {}
                own = [number.setdefault(c.as_py(), len(number)) for c in contents[begin:end]]
                if len(number) > 1:
                    rows += [
                        (1, hashes[begin], chunks.column("task")[i].as_py(), chunks.column("variant")[i].as_py(), o, 0, None, None, None)
                        for i, o in zip(range(begin, end), own, strict=True)
                    ]
            begin = end
        if rows:
            yield batch_of(schema, dict(zip(schema.names, zip(*rows, strict=True), strict=True)))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 16) -> DataFrame:
    """(uid, id, sha, recipe) for each row: the text as an ordered list of verified chunk identifiers.

    ``recipe`` is binary; equal recipes mean equal lower-cased texts. ``hash_bytes`` is
    the width of a chunk hash; tests shorten it to make hashes clash.
    """
    base = narrow(docs, id=id_col, text=text_col)
    shipped = base.mapInArrow(_chunker(hash_bytes), SHIPPED)
    home = F.coalesce(F.col("h"), F.col("uid").cast("string").cast("binary"))
    laid = spread(shipped.withColumn("home", home), "home").sortWithinPartitions("kind", "h").drop("home")
    checked = durable(laid.mapInArrow(_verify, VERIFIED), "chunk-recipes")
    texts = checked.where("kind = 0").select("uid", "id", "sha", "task", "recipe")
    clashes = checked.where("kind = 1").select("h", "task", "variant", "ordinal")
    step = hash_bytes + 4
    if clashes.isEmpty():
        # every hash stands for one content, so task-local variants are all 0 already
        return texts.drop("task")
    n = (F.length("recipe") / step).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            i.alias("pos"),
            F.substring(F.col("recipe"), i * step + 1, F.lit(hash_bytes)).alias("h"),
            F.conv(F.hex(F.substring(F.col("recipe"), i * step + hash_bytes + 1, F.lit(4))), 16, 10).cast("int").alias("variant"),
        ),
    )
    listed = texts.withColumn("part", F.explode_outer(F.when(n > 0, parts)))
    listed = listed.select("uid", "id", "sha", "task", "part.*").join(clashes, ["h", "task", "variant"], "left")
    chunk_id = F.concat("h", F.unhex(F.lpad(F.hex(F.coalesce("ordinal", F.lit(0))), 8, "0")))
    rebuilt = listed.groupBy("uid", "id", "sha").agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", chunk_id.alias("c"))))).alias("l")
    )
    joined = F.aggregate(F.col("l"), F.lit(b""), lambda done, x: F.concat(done, x["c"]))
    return rebuilt.select("uid", "id", "sha", joined.alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 16) -> DataFrame:
    """One row for every row of ``docs``: its group of equal texts and the row that stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and
    all empty texts are one group. The row with the largest id stays; a null id is
    smaller than any number, and of several rows with that id one stays. An empty table
    gives an empty result. Columns: id_col, uid, keep_id, group_size, kept, text_sha256.
    """
    texts = recipes(docs, id_col, text_col, hash_bytes)
    last = F.max(F.struct("id", "uid")).alias("last")
    groups = texts.groupBy("recipe").agg(last, F.count("*").alias("group_size"))
    return texts.join(groups, "recipe").select(
        F.col("id").alias(id_col),
        "uid",
        F.col("last.id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("last.uid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
