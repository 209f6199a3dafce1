"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.session import durable

# Rows that travel to a Python worker at once. Texts may be long, so batches are short.
BATCH_ROWS = 1000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; all are runtime settings of Spark."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def narrow(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, plus a row number ``uid``.

    Extra columns, whatever they are called, never meet the operator's own. Text is
    cast to string and null text becomes empty. ``uid`` tells repeated rows apart; it
    is stable only once the frame that holds it has been stored.
    """
    picked = [F.col(f"`{source}`").alias(name) for name, source in columns.items()]
    out = docs.select(*picked)
    if "text" in columns:
        out = out.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    if "id" in columns:
        out = out.withColumn("id", F.col("id").cast("long"))
    return out.withColumn("uid", F.monotonically_increasing_id())


def bucket_of(id_column: Column, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Lay rows out by hash of the keys; Spark picks the number of partitions at run time."""
    return df.repartition(*[F.col(k) for k in keys])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and its n + 1 offsets."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def batch_of(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    """A record batch in the order of ``schema``."""
    arrays = []
    for field in schema:
        value = columns[field.name]
        arrays.append(value if isinstance(value, pa.Array) else pa.array(value, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def packed(df: DataFrame, key: str, hold_bytes: int = 16 << 20) -> DataFrame:
    """(key, blob): the other columns of neighbouring rows with one key as a compressed Arrow stream.

    Text travels through a shuffle at about half the size of single rows. A task packs
    what it has read whenever that reaches ``hold_bytes``; ``unpacked`` reads blobs again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= hold_bytes:
                yield _blobs(held, key)
                held = []
        if held:
            yield _blobs(held, key)

    return df.mapInArrow(run, f"`{key}` long, blob binary")


def _blobs(batches: list[pa.RecordBatch], key: str) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    keys = table.column(key).to_numpy()
    order = np.argsort(keys, kind="stable")
    table, keys = table.drop_columns([key]).take(pa.array(order)).combine_chunks(), keys[order]
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    begins, ends = np.concatenate([[0], edges]).astype(np.int64), np.append(edges, len(keys))
    blobs = []
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table.slice(a, b - a))
        blobs.append(sink.getvalue().to_pybytes())
    some = begins if len(keys) else begins[:0]
    schema = pa.schema([(key, pa.int64()), ("blob", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(keys[some], pa.int64()), pa.array(blobs[: len(some)], pa.binary())], schema=schema)


def unpacked(blobs: pa.ChunkedArray) -> pa.Table | None:
    """The rows of some blobs, or None without any."""
    tables = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs]
    return pa.concat_tables(tables).combine_chunks() if tables else None


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no run of equal keys is cut in two.

    Each table holds whole runs only; a run longer than a batch arrives in one table.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = _last_start(batch, keys)
        if cut == 0 and held and _same(held[-1], held[-1].num_rows - 1, batch, 0, keys):
            held.append(batch)
            continue
        if cut == 0:
            if held:
                yield pa.Table.from_batches(held)
            held = [batch]
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int, keys: tuple[str, ...]) -> bool:
    return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in keys)


def _last_start(batch: pa.RecordBatch, keys: tuple[str, ...]) -> int:
    """Where the last run of equal keys begins."""
    low, high = 0, batch.num_rows - 1
    while low < high:  # sorted input: the last run is a suffix
        mid = (low + high) // 2
        if _same(batch, mid, batch, batch.num_rows - 1, keys):
            high = mid
        else:
            low = mid + 1
    return low


__all__ = ["BATCH_ROWS", "LOWER", "batch_of", "bucket_of", "durable", "narrow", "packed", "runs", "spread", "text_bytes", "tune", "unpacked"]
