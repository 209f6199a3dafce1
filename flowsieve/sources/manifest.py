"""Hash manifest of artifact files, and its verification."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.sources.first_lines import list_files, open_stream

CHUNK = 1 << 20
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"


def build_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, sha256) of the files below ``folder``, empty ones included.

    Files are streamed in 1 MB pieces inside tasks, so neither their number nor
    their size has to fit anywhere; only hashes are shuffled.
    """
    files = list_files(spark, folder, pattern).select("path", F.col("length").alias("size_bytes")).repartition("path")

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            hashes = []
            for path in pdf["path"]:
                h = hashlib.sha256()
                with open_stream(path) as stream:
                    while piece := stream.read(CHUNK):
                        h.update(piece)
                hashes.append(h.hexdigest())
            yield pdf.assign(sha256=hashes)

    hashed = files.mapInPandas(digest, "path string, size_bytes long, sha256 string")
    # the folder may be written with or without a scheme; it is stripped once, from the front
    bare = F.regexp_replace("path", SCHEME, "/")
    inner = re.sub(SCHEME, "/", folder.rstrip("/")) + "/"
    relative = F.substr(bare, F.when(F.startswith(bare, F.lit(inner)), F.lit(len(inner) + 1)).otherwise(F.lit(1)))
    return hashed.select(relative.alias("path"), F.lit(True).alias("exists"), "size_bytes", "sha256")


def verify_manifest(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(severity, finding, path): missing or changed is an error, unexpected a warning.

    ``expected`` has path, exists, size_bytes and sha256.
    """
    left = expected.select(
        F.col("path").alias("e_path"), F.coalesce("exists", F.lit(True)).alias("e_exists"),
        F.col("size_bytes").alias("e_size"), F.col("sha256").alias("e_sha"),
    )
    joined = left.join(actual, F.col("e_path") == F.col("path"), "left")
    here = F.col("path").isNotNull()

    def finding(severity: str, message: str):
        return F.struct(
            F.lit(severity).alias("severity"), F.concat(F.lit(message + ": "), F.col("e_path")).alias("finding")
        )

    found = F.array(
        F.when(~F.col("e_exists") & here, finding("warning", "Artifact exists but manifest expected missing")),
        F.when(F.col("e_exists") & ~here, finding("error", "Artifact missing")),
        F.when(F.col("e_exists") & here & (F.coalesce("e_size", F.lit(-1)) != F.col("size_bytes")), finding("error", "Artifact size changed")),
        F.when(F.col("e_exists") & here & (~F.col("e_sha").eqNullSafe(F.col("sha256"))), finding("error", "Artifact sha256 changed")),
    )
    return joined.select(F.col("e_path").alias("path"), F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select(
        "f.severity", "f.finding", "path"
    )
