"""Metrics over the score table: distributions, recall, curves, rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions import labels
from flowsieve.functions.core import missing_if_infinite, ref
from flowsieve.functions.scoring import VERDICTS
from flowsieve.operators.ordered import IN_TASK_ROWS, exact_quantiles, prefix_sums
from flowsieve.session import durable, small_side

ATTACK_VERDICTS = ("Known-Attack", "Zero-Day Candidate")


def share(condition: Column, among: Column | None = None) -> Column:
    value = condition.cast("double")
    return F.avg(value if among is None else F.when(among, value))


def with_fixed_values(counts: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Counts over a closed vocabulary: absent values appear as 0, others drop."""
    vocabulary = counts.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return vocabulary.join(counts, column, "left").select(
        column, F.coalesce("rows", F.lit(0)).cast("long").alias("rows")
    )


def verdict_counts(scores: DataFrame, column: str = "predicted_class") -> DataFrame:
    counts = scores.groupBy(F.col(column).alias("verdict")).agg(F.count(F.lit(1)).alias("rows"))
    return with_fixed_values(counts, "verdict", VERDICTS)


def zero_day_summary(scores: DataFrame) -> DataFrame:
    flag = F.col("is_zeroday")
    return scores.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(flag).alias("zero_day_count"),
        share(flag).alias("zero_day_rate"),
    )


def score_extent(scores: DataFrame, columns: Sequence[str], in_task_rows: int = IN_TASK_ROWS) -> DataFrame:
    """(score, min, median, max)."""
    medians = exact_quantiles(scores, columns, [0.5], in_task_rows)
    ends = scores.agg(
        *[f(missing_if_infinite(ref(c))).alias(f"{c}|{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    rows = [(c, ends[f"{c}|lo"], medians[c][0], ends[f"{c}|hi"]) for c in columns]
    return scores.sparkSession.createDataFrame(rows, "score string, min double, median double, max double")


def labelled_evaluation(scores: DataFrame, label_col: str) -> DataFrame:
    """Detection accuracy, known-class accuracy and OOD rate in one pass."""
    truth = labels.truth_verdict(ref(label_col))
    category = labels.canonical_category(ref(label_col))
    predicted = F.when(F.col("predicted_class").isin(*ATTACK_VERDICTS), F.lit("Known-Attack")).otherwise(F.lit("Normal"))
    return scores.agg(
        F.count_if(truth != "").alias("rows_with_labels"),
        share(predicted == truth, truth != "").alias("detection_accuracy"),
        share(F.col("classifier_class") == category, labels.known_set(category)).alias("classifier_accuracy_known"),
        share(F.col("is_zeroday"), labels.held_out_set(category)).alias("ood_detection_rate"),
    )


def recall_per_class(scores: DataFrame, label_col: str) -> DataFrame:
    """(label, pool, recall, support): classifier recall or OOD recall per family."""
    category = labels.canonical_category(ref(label_col))
    rows = scores.select(category.alias("label"), "classifier_class", "is_zeroday").where(
        labels.known_set(F.col("label")) | labels.held_out_set(F.col("label"))
    )
    known = labels.known_set(F.col("label"))
    hit = F.when(known, F.col("classifier_class") == F.col("label")).otherwise(F.col("is_zeroday"))
    return rows.groupBy("label").agg(
        F.when(F.max(known), F.lit("known")).otherwise(F.lit("held_out")).alias("pool"),
        share(hit).alias("recall"),
        F.count(F.lit(1)).alias("support"),
    )


def fpr_and_detection(scores: DataFrame, label_col: str) -> DataFrame:
    truth = labels.truth_verdict(ref(label_col))
    normal, attack = truth == "Normal", truth == "Known-Attack"
    return scores.agg(
        share(F.col("is_zeroday"), normal).alias("normal_false_positive_rate"),
        F.count_if(normal & F.col("is_zeroday")).alias("normal_false_positive_count"),
        F.count_if(normal).alias("normal_count"),
        share(F.col("predicted_class").isin(*ATTACK_VERDICTS), attack).alias("attack_detection_rate"),
        F.count_if(attack).alias("attack_count"),
    )


def strict_accuracy(scores: DataFrame, label_col: str) -> DataFrame:
    """Verdict equal to truth as text, over rows whose truth is known."""
    truth = labels.truth_verdict(ref(label_col))
    counted = scores.where(truth != "").agg(
        F.count(F.lit(1)).alias("comparable"), share(F.col("predicted_class") == truth).alias("accuracy")
    )
    return counted


def known_class_detection(scores: DataFrame, label_col: str) -> DataFrame:
    """Per class, the share the classifier does not call Normal."""
    return scores.groupBy(labels.canonical_category(ref(label_col)).alias("label")).agg(
        share(F.col("classifier_class") != "Normal").alias("detection_rate"), F.count(F.lit(1)).alias("support")
    )


def confusion_matrix(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """(true, pred, count, row_pct); row totals are sums over the small matrix."""
    cells = df.groupBy(F.col(true_col).alias("true"), F.col(pred_col).alias("pred")).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = F.sum("count").over(Window.partitionBy("true"))
    return cells.withColumn("row_pct", F.lit(100.0) * F.col("count") / total)


def top_confusions(matrix: DataFrame, k: int = 2) -> DataFrame:
    return (
        matrix.where((F.col("true") != F.col("pred")) & (F.col("count") > 0))
        .orderBy(F.desc("count"), F.desc("row_pct"), "true", "pred")
        .limit(k)
    )


def classifier_report(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from a confusion matrix."""
    hit = F.sum(F.when(F.col("true") == F.col("pred"), F.col("count")).otherwise(0))
    by_true = matrix.groupBy(F.col("true").alias("label")).agg(F.sum("count").alias("support"), hit.alias("hits"))
    by_pred = matrix.groupBy(F.col("pred").alias("label")).agg(F.sum("count").alias("predicted"))
    joined = by_true.join(by_pred, "label", "left")
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(0.0))
    recall = F.try_divide(F.col("hits"), F.col("support"))
    return joined.select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
        "support",
    )


def long_scores(df: DataFrame, methods: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, method, score)."""
    return df.unpivot([ref(k) for k in keep], [ref(m) for m in methods], "method", "score")


def reference_rows(df: DataFrame, in_reference: Column, label_col: str | None) -> DataFrame:
    """The benign rows of the reference part, or all of it when none is benign."""
    part = df.where(in_reference)
    if label_col is None:
        return part
    benign = part.where(labels.truth_verdict(ref(label_col)) == "Normal")
    return part if benign.isEmpty() else benign


def method_thresholds(
    reference: DataFrame, methods: Sequence[str], target_fpr: float, flags: Sequence[str] = (), in_task_rows: int = IN_TASK_ROWS
) -> dict[str, float]:
    """Exact quantile per score on the reference rows; 0/1 decision columns use 0.5."""
    scored = [m for m in methods if m not in flags]
    found = exact_quantiles(reference, scored, [1.0 - target_fpr], in_task_rows)
    return {m: 0.5 if m in flags else found[m][0] for m in methods}


def method_metrics(
    df: DataFrame,
    methods: Sequence[str],
    thresholds: Mapping[str, float],
    label_col: str,
    evaluated: Column,
) -> DataFrame:
    """Alert rate, FPR, detection rate, accuracy and OOD rate per score column, one pass."""
    truth = labels.truth_verdict(ref(label_col))
    base = df.where(evaluated).select(
        truth.alias("truth"),
        labels.held_out_set(labels.canonical_category(ref(label_col))).alias("held_out"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("method"),
                        F.lit(float(thresholds[m])).alias("threshold"),
                        (ref(m) > F.lit(float(thresholds[m]))).alias("alert"),
                    )
                    for m in methods
                ]
            )
        ).alias("m"),
    ).select("truth", "held_out", "m.*")
    predicted = F.when(F.col("alert"), F.lit("Known-Attack")).otherwise(F.lit("Normal"))
    return base.groupBy("method", "threshold").agg(
        share(F.col("alert")).alias("alert_rate"),
        share(F.col("alert"), F.col("truth") == "Normal").alias("normal_fpr"),
        share(F.col("alert"), F.col("truth") == "Known-Attack").alias("attack_detection_rate"),
        share(predicted == F.col("truth"), F.col("truth") != "").alias("detection_accuracy"),
        share(F.col("alert"), F.col("held_out")).alias("ood_detection_rate"),
    )


def score_curve(long: DataFrame) -> DataFrame:
    """ROC and precision-recall steps per method, highest score first.

    ``long`` holds (method, score, target 0/1). Equal scores become one step before
    anything is ordered; the running counts are distributed prefix sums.
    """
    steps = durable(
        long.withColumn("score", missing_if_infinite(F.col("score"))).where(F.col("score").isNotNull()).groupBy("method", "score").agg(
            F.sum("target").cast("long").alias("pos"), F.sum(F.lit(1) - F.col("target")).cast("long").alias("neg")
        ),
        "curve-steps",
    )
    ordered = prefix_sums(steps.withColumn("falling", -F.col("score")), ["falling"], ["pos", "neg"], ["method"])
    totals = steps.groupBy(F.col("method").alias("_m")).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return ordered.join(small_side(totals, "curve-totals"), F.col("method") == F.col("_m")).select(
        "method", "score", "pos", "neg", "cum_pos", "cum_neg", "p", "n",
        F.try_divide(F.col("cum_pos"), F.col("p")).alias("tpr"),
        F.try_divide(F.col("cum_neg"), F.col("n")).alias("fpr"),
    )


def curve_areas(curve: DataFrame) -> DataFrame:
    """(method, auc, average_precision); AUC counts ties half, 0.5 if one class is absent."""
    trapezoid = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    step = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return curve.groupBy("method").agg(
        F.coalesce(F.try_divide(F.sum(trapezoid), F.max(F.col("p").cast("double") * F.col("n"))), F.lit(0.5)).alias("auc"),
        F.coalesce(F.try_divide(F.sum(step), F.max("p").cast("double")), F.lit(0.0)).alias("average_precision"),
    )


def tpr_at_fpr(curve: DataFrame, targets: Sequence[float] = (0.01, 0.05)) -> DataFrame:
    """First point of the full curve whose FPR reaches each target."""
    cols = []
    for t in targets:
        reached = F.col("fpr") >= F.lit(float(t))
        cols.append(F.min_by(F.when(reached, F.col("tpr")), F.when(reached, F.struct("fpr", "tpr"))).alias(f"tpr_{round(t * 100)}"))
    return curve.groupBy("method").agg(*cols)


def best_method_recall(
    long: DataFrame, areas: DataFrame, thresholds: Mapping[str, float], family_col: str
) -> DataFrame:
    """OOD recall per family with the highest-AUC method at its threshold.

    A method without a threshold uses the 95 % quantile of the known rows.
    """
    best = areas.agg(F.max_by("method", F.struct("auc", "method")).alias("best")).first()["best"]
    if best not in thresholds:
        known = long.where((F.col("method") == best) & (F.col("target") == 0)).select("score")
        thresholds = {best: exact_quantiles(known, ["score"], [0.95])["score"][0]}
    return (
        long.where((F.col("method") == best) & (F.col("target") == 1))
        .groupBy(F.col(family_col).alias("family"))
        .agg(
            F.lit(best).alias("method"),
            share(F.col("score") > F.lit(float(thresholds[best]))).alias("recall"),
            F.count(F.lit(1)).alias("support"),
        )
    )


def rank_methods(metrics: DataFrame) -> DataFrame:
    """Best first: AUROC, then OOD rate, then low FPR; missing values rank last.

    ``metrics`` has one row per method; columns beyond the ranked ones pass through.
    """
    order = Window.orderBy(
        F.coalesce("auroc", F.lit(-1.0)).desc(),
        F.coalesce("ood_detection_rate", F.lit(-1.0)).desc(),
        F.coalesce("normal_fpr", F.lit(1.0)),
        "method",
    )
    # one row per method: a handful of rows by construction
    return metrics.withColumn("rank", F.row_number().over(order))
