"""Append-only alert event log: every event carries the alert as it was saved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a saved alert holds besides its id and the times of its events.
SAVED = {
    "event_timestamp": "string",
    "source": "string",
    "severity": "string",
    "risk": "int",
    "predicted_class": "string",
    "classifier_class": "string",
    "is_zeroday": "boolean",
    "hybrid_score": "double",
    "ae_score": "double",
    "max_prob": "double",
    "alert_json": "string",
    "llm_json": "string",
}
EVENT = {
    "alert_id": "string",
    "created_at": "timestamp",
    "seq": "bigint",
    "event_type": "string",
    "status": "string",
    "analyst_note": "string",
    "payload_json": "string",
    **SAVED,
}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in EVENT.items())


def rows(events: DataFrame) -> DataFrame:
    """Events in the columns of the log; absent ones are null."""
    return events.select(
        *[(F.col(name) if name in events.columns else F.lit(None)).cast(kind).alias(name) for name, kind in EVENT.items()]
    )


# One layout for everything that writes to a log: by day, writer and batch of the writer.
LAYOUT = {"date": "date", "stream": "string", "batch_id": "string"}
DIRECT = "batch"  # the writer that is no stream


def _placed(events: DataFrame, stream: str, batch_id: str):
    placed = rows(events).withColumns({"date": F.to_date("created_at"), "stream": F.lit(stream), "batch_id": F.lit(batch_id)})
    return placed.write.partitionBy(*LAYOUT)


def append_events(events: DataFrame, path: str) -> None:
    """Append events; nothing is ever rewritten."""
    _placed(events, DIRECT, "0").mode("append").parquet(path)


def write_batch(events: DataFrame, path: str, stream: str, batch_id: int) -> None:
    """The events of one micro-batch; written again, they replace what the batch wrote and nothing else."""
    writer = _placed(events, stream, str(batch_id)).option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events of a log, whoever wrote them."""
    return spark.read.schema(SCHEMA + "".join(f", {name} {kind}" for name, kind in LAYOUT.items())).parquet(path)
