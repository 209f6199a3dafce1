"""Tables and reports out: production flows, scores, JSON reports, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve import vocab


def write_production_flows(flows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One table partitioned by split: each set is read back by partition pruning."""
    flows.select(*[f.name for f in vocab.PRODUCTION_SCHEMA.fields]).write.partitionBy("split").mode(mode).parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.schema(vocab.PRODUCTION_SCHEMA).parquet(path).where(F.col("split") == split)


def write_scores(scores: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """The score table as parquet, or CSV with a header."""
    writer = scores.write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.parquet(path)


def report_json(**sections: DataFrame) -> DataFrame:
    """Small summary tables as one JSON document, a list of rows per section.

    Sections are summaries of a bounded number of rows; each becomes one array.
    """
    parts = None
    for name, table in sections.items():
        rows = F.to_json(F.collect_list(F.struct(*table.columns)), {"ignoreNullFields": "false"})
        part = table.agg(F.concat(F.lit(f', "{name}": '), rows).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    body = F.array_join(F.array_sort(F.collect_list("part")), "")
    return parts.agg(F.concat(F.lit('{"version": 1'), body, F.lit("}")).alias("value"))


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.select("value").write.mode(mode).text(path)


def save_profile(
    thresholds: DataFrame, path: str, name: str, target_fpr: float, mode_name: str = "vote", min_votes: int = 2,
    environment: str = "default", created_at: Column | None = None,
) -> None:
    """Append a calibrated threshold profile; one row per threshold.

    ``thresholds`` has (score, threshold, reference_rows). Profiles of several
    environments share the table, keyed by name and environment.
    """
    stamp = F.current_timestamp() if created_at is None else created_at
    thresholds.select(
        F.lit(name).alias("profile"), F.lit(environment).alias("environment"), stamp.alias("created_at"),
        F.lit(float(target_fpr)).alias("target_fpr"), F.col("reference_rows").cast("long").alias("reference_rows"),
        F.lit(mode_name).alias("decision_mode"), F.lit(int(min_votes)).alias("min_votes"),
        F.col("score"), F.col("threshold").cast("double").alias("threshold"),
    ).write.mode("append").parquet(path)


def load_profile(spark: SparkSession, path: str, name: str, environment: str = "default") -> DataFrame:
    """The newest saved version of a profile."""
    saved = spark.read.parquet(path).where((F.col("profile") == name) & (F.col("environment") == environment))
    newest = saved.groupBy("score").agg(F.max_by(F.struct("*"), F.col("created_at")).alias("row"))
    return newest.select("row.*")
