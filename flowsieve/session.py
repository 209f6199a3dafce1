"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every operator relies on. Spark owns join strategy and partition sizes
# through adaptive execution; only semantics are pinned here.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rank limits also apply before the shuffle for samples of this size
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # vendor events may repeat a field name once names are cleaned
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # the JVM never compiles generated methods above 8000 bytes; wide projections
    # run faster as several smaller ones
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# Can only be given when a session is built: noting the caller of every column
# function costs more than building the plan.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "flowsieve", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **BUILD_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder; on a cluster a
    machine-local folder is invisible to the other executors, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="flowsieve-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a cached or locally checkpointed frame this survives the loss of any
    executor, is computed exactly once, and is pruned by column when read.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/flowsieve/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, label: str) -> DataFrame:
    """A join side that is expected to be small, broadcast only if it really is.

    The side is stored first, so the planner knows its bytes and compares them with
    ``spark.sql.autoBroadcastJoinThreshold``; a larger side is shuffled, with skewed
    keys split at run time.
    """
    return durable(df, label)
