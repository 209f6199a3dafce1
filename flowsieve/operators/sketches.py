"""Score distributions as mergeable quantile sketches.

A sketch of a few kilobytes stands for any number of scores. Stored by file and hour,
sketches answer for every file, day or period by merging, so that reports, drift and
what-if rates need no second look at the rows. Ranks are approximate: an answer's rank
is off by less than ``RANK_ERROR`` of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.core import missing_if_infinite, ref

K = 1024  # size of a sketch
RANK_ERROR = 0.005  # stated for this size, merged or not


def sketch_scores(scores: DataFrame, columns: Sequence[str], by: Mapping[str, Column]) -> DataFrame:
    """(score, by, rows, sketch, low, high) of several score columns; missing and infinite scores are left out."""
    entries = F.array(*[F.struct(F.lit(c).alias("score"), missing_if_infinite(ref(c)).cast("double").alias("value")) for c in columns])
    long = scores.select(*[c.alias(n) for n, c in by.items()], F.inline(entries)).where(F.col("value").isNotNull())
    return long.groupBy("score", *by).agg(
        F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_double("value", K).alias("sketch"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same with fewer ``by`` columns: parts of one score as one sketch."""
    return sketches.groupBy("score", *by).agg(
        F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch", K).alias("sketch"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )


def sketch_quantiles(sketches: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """Adds a column for each named probability; the lowest and highest score are exact."""
    found = {}
    for name, p in probs.items():
        found[name] = F.col("low") if p <= 0 else F.col("high") if p >= 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))
    return sketches.withColumns(found)


def share_above(thresholds: Mapping[str, float]) -> Column:
    """What share of a sketch's scores the threshold of its score would flag; null without one."""
    out = F.lit(None).cast("double")
    for score, limit in thresholds.items():
        at = F.lit(float(limit))
        inside = F.lit(1.0) - F.kll_sketch_get_rank_double("sketch", at)
        share = F.when(at < F.col("low"), 1.0).when(at >= F.col("high"), 0.0).otherwise(inside)
        out = F.when(F.col("score") == score, share).otherwise(out)
    return out
