"""Threshold calibration, profiles, overlays, what-if and adaptive thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions import labels
from flowsieve.functions.core import missing_if_infinite, ref
from flowsieve.functions.scoring import Decision
from flowsieve.operators.ordered import IN_TASK_ROWS, exact_quantiles, prefix_sums
from flowsieve.session import durable, small_side

SCORES = ("hybrid", "ae_re", "softmax", "fv_cluster")
QUANTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def score_distribution(
    scores: DataFrame, columns: Sequence[str], in_task_rows: int = IN_TASK_ROWS
) -> DataFrame:
    """(score, min, p50, p90, p95, p99, max, mean), one row per score column."""
    clean = scores.select(*[missing_if_infinite(ref(c)).alias(c) for c in columns])
    quantiles = exact_quantiles(clean, columns, list(QUANTILES.values()), in_task_rows)
    sums = clean.agg(
        *[f(c).alias(f"{c}|{name}") for c in columns for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    ).first()
    rows = [
        (c, sums[f"{c}|min"], *quantiles[c], sums[f"{c}|max"], sums[f"{c}|mean"]) for c in columns
    ]
    schema = "score string, min double, p50 double, p90 double, p95 double, p99 double, max double, mean double"
    return scores.sparkSession.createDataFrame(rows, schema)


def reference_rows(scores: DataFrame, label_col: str | None) -> DataFrame:
    """The benign rows, or all rows when there are no labels or no benign row."""
    if label_col is None:
        return scores
    benign = scores.where(labels.truth_verdict(ref(label_col)) == "Normal")
    return scores if benign.isEmpty() else benign


def calibrate(
    scores: DataFrame,
    columns: Sequence[str] = SCORES,
    target_fpr: float = 0.01,
    label_col: str | None = None,
    in_task_rows: int = IN_TASK_ROWS,
) -> DataFrame:
    """(score, threshold, actual_fpr, reference_rows): exact quantile at 1 - target FPR."""
    present = [c for c in columns if c in scores.columns]
    reference = reference_rows(scores, label_col)
    found = exact_quantiles(reference, present, [1.0 - target_fpr], in_task_rows)
    limits = {c: found[c][0] for c in present}
    if all(v is None for v in limits.values()):
        raise ValueError("No reference rows available for threshold calibration")
    facts = reference.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg((ref(c) > F.lit(limits[c])).cast("double")).alias(c) for c in present],
    ).first()
    rows = [(c, limits[c], facts[c], facts["n"]) for c in present]
    return scores.sparkSession.createDataFrame(
        rows, "score string, threshold double, actual_fpr double, reference_rows long"
    )


def decision_from(table: DataFrame, mode: str = "vote", min_votes: int = 2) -> Decision:
    """The calibrated decision; the table has one row per score."""
    limits = {r["score"]: r["threshold"] for r in table.select("score", "threshold").collect()}
    return Decision(
        hybrid=limits.get("hybrid"), ae_re=limits.get("ae_re"), softmax=limits.get("softmax"),
        mode=mode, min_votes=min_votes,
    )


def overlay(saved: DataFrame, local: DataFrame) -> DataFrame:
    """Threshold keys of a local profile replace saved ones; both sides' extras stay."""
    right = local.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    return saved.join(right, F.col("key") == F.col("_key"), "full_outer").select(
        F.coalesce("key", "_key").alias("key"), F.coalesce("_value", "value").alias("value")
    )


def what_if(
    scores: DataFrame,
    profiles: Mapping[str, Decision],
    label_col: str,
    ae: str = "ae_re",
    max_prob: str = "max_prob",
    hybrid: str = "hybrid",
) -> DataFrame:
    """Zero-day count and rate, benign FPR and OOD rate under every profile, one pass."""
    flags = F.array(
        *[
            F.struct(
                F.lit(name).alias("profile"),
                F.lit(d.rule).alias("decision_rule"),
                d.flag(ref(ae), ref(max_prob), ref(hybrid)).alias("flag"),
            )
            for name, d in profiles.items()
        ]
    )
    flat = scores.select(
        labels.truth_verdict(ref(label_col)).alias("truth"),
        labels.held_out_set(labels.canonical_category(ref(label_col))).alias("held_out"),
        F.explode(flags).alias("p"),
    ).select("truth", "held_out", "p.*")
    flag = F.col("flag").cast("double")
    return flat.groupBy("profile", "decision_rule").agg(
        F.count_if("flag").alias("zero_day_count"),
        F.avg(flag).alias("zero_day_rate"),
        F.avg(F.when(F.col("truth") == "Normal", flag)).alias("normal_fpr"),
        F.avg(F.when(F.col("held_out"), flag)).alias("ood_detection_rate"),
    )


def adaptive_thresholds(
    scores: DataFrame,
    entity: str,
    order: Sequence[str],
    score: str,
    benign: Column,
    seed: Sequence[float] = (),
    window: int = 1000,
    target_fpr: float = 0.05,
    chunk: int = 20_000,
) -> DataFrame:
    """Every row judged by the quantile of its entity's last benign scores.

    Adds ``threshold`` (before the row; null = no history yet, nothing exceeds it)
    and ``exceeds``. Benign rows are numbered per entity with distributed prefix
    sums and cut into chunks that overlap by one window, so neither a hot entity
    nor a long history lands in one task. ``seed`` scores fill the buffer first.
    """
    flagged = scores.select(
        F.col(entity).alias("entity"), *order, F.col(score).cast("double").alias("score"),
        benign.cast("int").alias("benign"),
    )
    # only finite benign scores are history, so only they are numbered
    flagged = flagged.withColumn("kept", F.when(_is_finite(F.col("score")) & (F.col("benign") == 1), 1).otherwise(0))
    layout = ["_part", "_pos"]
    numbered = durable(prefix_sums(flagged, order, ["kept"], ["entity"], layout), "numbered-scores")
    history = _sliding_thresholds(numbered.where("kept = 1"), list(seed)[-window:], window, target_fpr, chunk)
    start = None
    if seed:
        tail = pd.Series(list(seed)[-window:], dtype="float64")
        start = float(tail.quantile(1.0 - target_fpr))
    # every benign row gets its own entry of the history; the rows between two of them look
    # back in the layout, so however many they are, none of them is joined
    own = history.select(F.col("entity").alias("_e"), F.col("position").alias("_p"), "quantile")
    same = F.col("entity").eqNullSafe(F.col("_e")) & (F.col("cum_kept") == F.col("_p"))
    benign_rows = numbered.where("kept = 1").join(own, same).drop("_e", "_p")
    laid = durable(benign_rows.unionByName(numbered.where("kept = 0").withColumn("quantile", F.lit(None).cast("double"))), "score-history")
    last = laid.groupBy("_part", "entity").agg(F.max_by("quantile", F.when(F.col("kept") == 1, F.col("_pos"))).alias("last"))
    earlier = Window.partitionBy("entity").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(
        F.col("_part").alias("_q"), F.col("entity").alias("_e"), F.last("last", ignorenulls=True).over(earlier).alias("carried")
    )
    before = Window.partitionBy("_part", "entity").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = laid.withColumn("before", F.last("quantile", ignorenulls=True).over(before))
    joined = seen.join(small_side(carried, "carried"), (F.col("_part") == F.col("_q")) & F.col("entity").eqNullSafe(F.col("_e")))
    threshold = F.coalesce("before", "carried", F.lit(start).cast("double"))
    return joined.select(
        F.col("entity").alias(entity), *order, "score", "benign", threshold.alias("threshold"),
        F.coalesce(F.col("score") > threshold, F.lit(False)).alias("exceeds"),
    )


def _is_finite(c: Column) -> Column:
    return missing_if_infinite(c).isNotNull()


def _sliding_thresholds(
    benign: DataFrame, seed: list[float], window: int, target_fpr: float, chunk: int
) -> DataFrame:
    """(entity, position, quantile) after each benign row; position counts from 1."""
    own = F.floor((F.col("cum_kept") - 1) / chunk)
    following = F.floor((F.col("cum_kept") - 1 + (window - 1)) / chunk)
    spread = benign.select(
        "entity", F.col("cum_kept").alias("position"), "score",
        F.explode(F.sequence(own, following)).alias("chunk"),
    )

    def slide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        first = int(key[1]) * chunk + 1
        values = rows["score"].to_numpy()
        positions = rows["position"].to_numpy()
        if seed and positions[0] == 1:
            values = list(seed) + list(values)
        quantile = (
            pd.Series(values, dtype="float64")
            .rolling(window, min_periods=1)
            .quantile(1.0 - target_fpr)
            .to_numpy()[-len(positions):]
        )
        out = pd.DataFrame({"entity": rows["entity"].to_numpy(), "position": positions, "quantile": quantile})
        return out[(out["position"] >= first) & (out["position"] < first + chunk)]

    return spread.groupBy("entity", "chunk").applyInPandas(
        slide, "entity string, position long, quantile double"
    )
