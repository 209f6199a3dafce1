"""Drift of score distributions and zero-day rate against a reference report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATISTICS = ("mean", "p50", "p90", "p95", "p99")
# Fixed wording per level.
ACTIONS = {
    "HIGH": "Review normalization quality, inspect top alerts, and recalibrate thresholds on representative benign rows.",
    "MEDIUM": "Inspect score distribution changes and consider local threshold calibration before operational demos.",
    "LOW": "Continue monitoring; recalibrate when traffic source or feature schema changes.",
}


def statistics_long(distribution: DataFrame) -> DataFrame:
    return distribution.unpivot(["score"], list(STATISTICS), "statistic", "value")


def score_drift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(score, statistic, reference, current, delta, ratio) of two distribution tables."""
    left = statistics_long(reference).withColumnRenamed("value", "reference")
    right = statistics_long(current).withColumnRenamed("value", "current")
    return left.join(right, ["score", "statistic"]).select(
        "score", "statistic", "reference", "current",
        (F.col("current") - F.col("reference")).alias("delta"),
        F.when(F.abs("reference") >= 1e-12, F.try_divide("current", "reference")).alias("ratio"),
    )


def drift_report(
    drift: DataFrame | None,
    reference_rate: DataFrame | None,
    current_rate: DataFrame,
    coverage: float | None,
    rate_delta: float = 0.10,
    p95_ratio: float = 1.5,
) -> DataFrame:
    """One row: level, warnings and the recommended action.

    Inputs are summaries (one rate row each, at most a few score rows), brought
    together by a union, so the list below is short whatever the batch size. Without a
    reference (``drift`` and ``reference_rate`` are None) that is a warning of its own.
    A change of rate and low coverage weigh more than a score that moved.
    """
    if reference_rate is None or drift is None:
        spark = current_rate.sparkSession
        drift = spark.createDataFrame([], "score string, statistic string, current double, ratio double")
        reference_rate = spark.createDataFrame([], "zero_day_rate double")
        missing = F.lit("No reference report was available; only absolute current distributions were reported.")
    else:
        missing = F.lit(None).cast("string")
    over = (F.col("statistic") == "p95") & (F.col("ratio") > p95_ratio)
    message = F.concat(
        F.col("score"), F.lit(": "), F.format_string("%.6f", "current"), F.lit(" current p95 is "),
        F.format_string("%.2f", "ratio"), F.lit("x the reference p95 for score distribution."),
    )
    nothing = F.lit(None)
    facts = (
        reference_rate.select(F.col("zero_day_rate").alias("ref"), nothing.cast("double").alias("cur"), nothing.cast("string").alias("message"))
        .unionByName(current_rate.select(nothing.cast("double").alias("ref"), F.col("zero_day_rate").alias("cur"), nothing.cast("string").alias("message")))
        .unionByName(drift.where(over).select(nothing.cast("double").alias("ref"), nothing.cast("double").alias("cur"), message.alias("message")))
        .agg(F.max("ref").alias("ref"), F.max("cur").alias("cur"), F.array_sort(F.collect_list("message")).alias("score_warnings"))
    )
    change = F.col("cur") - F.col("ref")

    def percent(c):
        return F.concat(F.format_string("%.1f", c * 100.0), F.lit("%"))

    changed = F.when(
        F.abs(change) >= rate_delta,
        F.concat(
            F.lit("Zero-day candidate rate changed by "), F.when(change >= 0, F.lit("+")).otherwise(F.lit("")),
            percent(change), F.lit(" (reference "), percent(F.col("ref")), F.lit(", current "),
            percent(F.col("cur")), F.lit(")."),
        ),
    )
    if coverage is None:
        covered = F.lit("Feature coverage is unavailable.")
    elif coverage < 0.60:
        covered = F.lit(f"Feature coverage is low ({coverage:.1%}); scores are weak triage signals.")
    elif coverage < 0.80:
        covered = F.lit(f"Feature coverage is moderate ({coverage:.1%}); review mapped columns.")
    else:
        covered = F.lit(None).cast("string")
    available = F.col("ref").isNotNull()
    low_coverage = coverage is not None and coverage < 0.60
    heavy = F.array(F.when(F.lit(low_coverage), covered), changed)

    def present(some):
        return F.filter(some, lambda w: w.isNotNull())

    raised = F.concat(present(F.array(covered, changed, missing)), F.col("score_warnings"))
    serious = F.size(present(heavy)) > 0
    level = (
        F.when(F.size(raised) == 0, F.lit("LOW"))
        .when(serious & (F.size(raised) >= 2), F.lit("HIGH"))
        .otherwise(F.lit("MEDIUM"))
    )
    quiet = F.array(F.lit("No major drift signals were detected against the available reference."))
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return facts.select(
        F.col("ref").alias("reference_rate"), F.col("cur").alias("current_rate"), available.alias("reference_available"),
        raised.alias("raised"), level.alias("level"),
    ).select(
        "reference_available", "reference_rate", "current_rate", "level",
        F.when(F.size("raised") > 0, F.col("raised")).otherwise(quiet).alias("warnings"),
        F.element_at(action, F.col("level")).alias("recommended_action"),
    )
