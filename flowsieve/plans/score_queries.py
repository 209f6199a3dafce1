"""Scores, decisions, calibration, evaluation, curves, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import labels, scoring
from flowsieve.functions import vectors as V
from flowsieve.functions.scoring import Decision, HybridWeights
from flowsieve.operators import drift as drift_op
from flowsieve.operators import evaluate, models, production, sampling, sketches, thresholds
from flowsieve.plans.base import class_text, judged, query, r6, scores, table, with_views
from flowsieve.session import durable

WEIGHTS = HybridWeights(ae_re=2.63, softmax=14.73, intercept=-3.36)
VOTES = Decision(hybrid=0.99, ae_re=0.2, softmax=0.5, mode="vote", min_votes=2)
HELD = "attack_cat IN ('Fuzzers', 'Analysis', 'Backdoors', 'Shellcode', 'Worms')"
KNOWN = "attack_cat IN ('Normal', 'DoS', 'Exploits', 'Reconnaissance', 'Generic')"
TRUTH = class_text("attack_cat")
ATTACK = "predicted_class IN ('Known-Attack', 'Zero-Day Candidate')"


@query(
    "hybrid_score",
    with_views(f"SELECT source_row, {r6('hybrid')} AS hybrid, {r6('0.5E0 * ae_re + 0.5E0 * (1E0 - max_prob)')} AS legacy FROM scores_v"),
)
def hybrid_score(spark: SparkSession, folder: str) -> DataFrame:
    ae, top = F.col("ae_re"), F.col("max_prob")
    return scores(spark, folder).select(
        "source_row", scoring.hybrid_score(ae, top, WEIGHTS).alias("hybrid"), scoring.hybrid_score(ae, top).alias("legacy")
    )


def _decided(spark: SparkSession, folder: str, decision: Decision) -> DataFrame:
    flag = decision.flag(F.col("ae_re"), F.col("max_prob"), F.col("hybrid"))
    return scores(spark, folder).select(
        "source_row", flag.alias("is_zeroday"), F.lit(decision.rule).alias("zero_day_rule"),
        scoring.verdict(flag, F.col("classifier_class")).alias("predicted_class"),
    )


def _decision_sql(condition: str, rule: str) -> str:
    return with_views(
        f"""SELECT source_row, {condition} AS is_zeroday, '{rule}' AS zero_day_rule, CASE WHEN {condition}
 THEN 'Zero-Day Candidate' WHEN classifier_class = 'Normal' THEN 'Normal' ELSE 'Known-Attack' END AS predicted_class FROM scores_v"""
    )


@query(
    "zero_day_vote",
    _decision_sql(
        "(CAST(hybrid > 0.99E0 AS INT) + CAST(ae_re > 0.2E0 AS INT) + CAST(1E0 - max_prob > 0.5E0 AS INT) >= 2)",
        "vote_2_of_3",
    ),
)
def zero_day_vote(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder, VOTES)


@query("zero_day_hybrid", _decision_sql("(hybrid > 0.985E0)", "hybrid_calibrated"))
def zero_day_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder, Decision(hybrid=0.985))


@query("zero_day_fallback", _decision_sql("(ae_re > 0.5E0 AND max_prob < 0.6E0)", "ae_plus_confidence_fallback"))
def zero_day_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder, Decision())


_WEIGHT = "CASE sev WHEN 'CRITICAL' THEN 35 WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 15 WHEN 'LOW' THEN 5 ELSE 10 END"


def risk_sql(sev: str, hybrid: str = "hybrid_score", ae: str = "ae_score") -> str:
    weight = _WEIGHT.replace("sev", sev, 1)
    return (
        f"CAST(least(100E0, round_even({weight} + {hybrid} * 45E0 + least({ae}, 1E0) * 15E0"
        " + CASE WHEN is_zeroday THEN 15E0 ELSE 0E0 END, 0)) AS BIGINT)"
    )


@query(
    "risk_score",
    with_views(
        f"SELECT source_row, sev, {risk_sql('sev')} AS risk, CASE WHEN {risk_sql('sev')} >= 85 THEN 'CRITICAL' WHEN"
        f" {risk_sql('sev')} >= 70 THEN 'HIGH' WHEN {risk_sql('sev')} >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level"
        " FROM (SELECT *, CASE source_row % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM'"
        " WHEN 3 THEN 'LOW' ELSE 'N/A' END AS sev FROM judged_v)"
    ),
)
def risk_score(spark: SparkSession, folder: str) -> DataFrame:
    sev = F.get(F.lit(["critical", "HIGH", "MEDIUM", "LOW", "N/A"]), (F.col("source_row") % 5).cast("int"))
    df = judged(spark, folder).withColumn("sev", F.upper(sev))
    risk = scoring.risk_score(F.col("hybrid_score"), F.col("ae_score"), F.col("is_zeroday"), F.col("sev"))
    return df.select("source_row", "sev", risk.alias("risk"), scoring.risk_severity(risk).alias("level"))


# Class probabilities derived from each event: five logits and their softmax.
LOGIT_SQL = [
    "CAST((event_id * 7919) % 1000 AS DOUBLE) / 250E0",
    "value / 100E0",
    "CAST((user_id * 31) % 97 AS DOUBLE) / 40E0",
    "CAST(event_id % 13 AS DOUBLE) / 5E0",
    "1E0 - value / 200E0",
]
CLASSES = ["Normal", "DoS", "Exploits", "Reconnaissance"]


def logits(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").selectExpr("event_id AS source_row", f"array({', '.join(LOGIT_SQL)}) AS z")
    top = F.array_max("z")
    powers = F.transform("z", lambda v: F.exp(v - top))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    return df.withColumn("e", powers).select("source_row", "z", F.transform("e", lambda v: v / total).alias("probs"))


_LOGITS = ("logits_v", "SELECT event_id AS source_row, [" + ", ".join(LOGIT_SQL) + "] AS z FROM events")
_PROBS = (
    "probs_v",
    """SELECT source_row, z, list_transform(z, lambda v: exp(v - list_max(z)) / list_sum(list_transform(z, lambda w: exp(w - list_max(z)))))
 AS probs FROM logits_v""",
)


@query(
    "softmax_guard",
    with_views(
        f"""SELECT source_row, {r6('1E0 - list_max(probs)')} AS softmax, coalesce(['Normal', 'DoS', 'Exploits', 'Reconnaissance'][
 CAST(list_position(probs, list_max(probs)) AS INT)], 'Unknown') AS classifier_class FROM probs_v""",
        _LOGITS, _PROBS,
    ),
)
def softmax_guard(spark: SparkSession, folder: str) -> DataFrame:
    return logits(spark, folder).select(
        "source_row", scoring.softmax_score(F.col("probs")).alias("softmax"),
        scoring.top_class(F.col("probs"), CLASSES).alias("classifier_class"),
    )


@query(
    "energy_score",
    with_views(
        f"""SELECT source_row, {r6("-2E0 * ln(list_sum(list_transform(z, lambda v: exp(v / 2E0))))")} AS energy FROM logits_v""",
        _LOGITS,
    ),
)
def energy_score(spark: SparkSession, folder: str) -> DataFrame:
    return logits(spark, folder).select("source_row", scoring.energy_score(F.col("z"), 2.0).alias("energy"))


@query(
    "ood_ensemble",
    with_views(
        f"""SELECT source_row, {r6("(CAST(ae_re > 0.2E0 AS DOUBLE) + CAST(hybrid > 0.99E0 AS DOUBLE) + CAST(softmax > 0.5E0 AS DOUBLE)) / 3E0")}
 AS ood_ensemble FROM scores_v"""
    ),
)
def ood_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    flags = [F.col("ae_re") > 0.2, F.col("hybrid") > 0.99, F.col("softmax") > 0.5]
    return scores(spark, folder).select("source_row", scoring.ensemble_share(flags).alias("ood_ensemble"))


@query(
    "predictive_entropy",
    with_views(
        f"""SELECT user_id, {r6('sum(-m * ln(greatest(m, 1E-12)))')} AS entropy, {r6('arg_max(s, (m, -k))')} AS std_max_class,
 sum(-m * ln(greatest(m, 1E-12))) > 1.2E0 AS low_confidence FROM (SELECT user_id, k, avg(probs[k]) AS m,
 coalesce(stddev_pop(probs[k]), 0) AS s FROM probs_v JOIN events ON event_id = source_row, range(1, 6) r(k) GROUP BY ALL) GROUP BY user_id""",
        _LOGITS, _PROBS,
    ),
)
def predictive_entropy(spark: SparkSession, folder: str) -> DataFrame:
    owner = table(spark, folder, "events").select(F.col("event_id").alias("source_row"), "user_id")
    samples = logits(spark, folder).join(owner, "source_row")
    return models.ensemble_uncertainty(samples, ["user_id"], low_confidence=1.2)


HEAD = [[0.5, -0.2, 0.1], [-0.4, 0.3, 0.2], [0.1, 0.1, -0.6], [0.2, -0.5, 0.4], [-0.3, 0.2, 0.1]]


@query(
    "gradient_norm",
    with_views(
        "SELECT source_row, "
        + r6(
            "sqrt("
            + " + ".join(
                "pow(list_dot_product(list_transform(probs, lambda p, i: p - CASE WHEN i = list_position(probs,"
                f" list_max(probs)) THEN 1E0 ELSE 0E0 END), [{', '.join(f'{row[c]}::DOUBLE' for row in HEAD)}]), 2)"
                for c in range(3)
            )
            + ")"
        )
        + " AS gradbp_l2 FROM probs_v",
        _LOGITS, _PROBS,
    ),
)
def gradient_norm(spark: SparkSession, folder: str) -> DataFrame:
    return logits(spark, folder).select("source_row", V.gradient_norm(F.col("probs"), HEAD).alias("gradbp_l2"))


ATTRIBUTED = ["ae_re", "softmax", "hybrid", "max_prob"]
COEFFICIENTS = [2.5, -1.0, 0.75, 4.0]


def attributions(spark: SparkSession, folder: str) -> DataFrame:
    df = scores(spark, folder)
    means = models.feature_means(df.where("attack_cat = 'Normal'"), ATTRIBUTED)
    values = F.array(*ATTRIBUTED)
    parts = V.linear_attribution(values, V.literal(means), V.literal(COEFFICIENTS))
    return df.select("source_row", "classifier_class", "ae_re", values.alias("vals"), parts.alias("parts"))


_PARTS = (
    "parts_v",
    "SELECT source_row, "
    + ", ".join(
        f"{w}E0 * ({f} - (SELECT avg({f}) FROM scores_v WHERE attack_cat = 'Normal')) AS p_{f}"
        for f, w in zip(ATTRIBUTED, COEFFICIENTS, strict=True)
    )
    + " FROM scores_v",
)


@query(
    "linear_attribution",
    with_views("SELECT source_row, " + ", ".join(r6(f"p_{f}") + f" AS {f}" for f in ATTRIBUTED) + " FROM parts_v", _PARTS),
)
def linear_attribution(spark: SparkSession, folder: str) -> DataFrame:
    parts = attributions(spark, folder)
    return parts.select("source_row", *[F.get("parts", F.lit(i)).alias(f) for i, f in enumerate(ATTRIBUTED)])


@query(
    "top_features",
    with_views(
        """SELECT source_row, rank, feature, round(p + 1E-10, 6) + 0E0 AS contribution FROM (
 SELECT source_row, feature, p, row_number() OVER (PARTITION BY source_row ORDER BY abs(p) DESC, pos) AS rank FROM ("""
        + " UNION ALL ".join(
            f"SELECT source_row, '{f}' AS feature, {i} AS pos, p_{f} AS p FROM parts_v" for i, f in enumerate(ATTRIBUTED)
        )
        + ")) WHERE rank <= 2",
        _PARTS,
    ),
)
def top_features(spark: SparkSession, folder: str) -> DataFrame:
    top = V.top_features(F.lit(ATTRIBUTED), F.col("parts"), F.col("vals"), 2)
    return attributions(spark, folder).select("source_row", F.posexplode(top).alias("rank", "t")).select(
        "source_row", (F.col("rank") + 1).alias("rank"), "t.feature", "t.contribution"
    )


@query(
    "verdict_counts",
    with_views(
        """SELECT v.verdict, coalesce(c.n, 0) AS rows FROM (VALUES ('Normal'), ('Known-Attack'), ('Zero-Day Candidate')) v(verdict)
 LEFT JOIN (SELECT predicted_class, count(*) AS n FROM judged_v GROUP BY 1) c ON c.predicted_class = v.verdict"""
    ),
)
def verdict_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.verdict_counts(judged(spark, folder))


@query(
    "zero_day_rate",
    with_views(
        f"SELECT count(*) AS rows, count(*) FILTER (WHERE is_zeroday) AS zero_day_count,"
        f" {r6('avg(CAST(is_zeroday AS DOUBLE))')} AS zero_day_rate FROM judged_v"
    ),
)
def zero_day_rate(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.zero_day_summary(judged(spark, folder))


def _distribution_sql(columns: list[str], source: str = "scores_v") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS score, {r6(f'min({c})')} AS min, {r6(f'quantile_cont({c}, 0.5)')} AS p50,"
        f" {r6(f'quantile_cont({c}, 0.9)')} AS p90, {r6(f'quantile_cont({c}, 0.95)')} AS p95,"
        f" {r6(f'quantile_cont({c}, 0.99)')} AS p99, {r6(f'max({c})')} AS max, {r6(f'avg({c})')} AS mean FROM {source}"
        for c in columns
    )


DISTRIBUTED = ["hybrid", "ae_re", "softmax", "max_prob"]


@query("score_distribution", with_views(_distribution_sql(DISTRIBUTED)))
def score_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return thresholds.score_distribution(scores(spark, folder), DISTRIBUTED)


@query(
    "sketch_distribution",
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS score, count(*) AS rows, {r6(f'min({c})')} AS low, {r6(f'max({c})')} AS high, count(DISTINCT (source_file,
 date_trunc('hour', event_ts))) AS parts, true AS merged_near, true AS direct_near, true AS share_near FROM scores_v"""
            for c in DISTRIBUTED
        )
    ),
)
def sketch_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches stored by file and hour and merged, against one pass and against the exact ranks."""
    df = scores(spark, folder).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    by = {"source_file": F.col("source_file"), "hour": F.date_trunc("hour", "event_ts")}
    parts = durable(sketches.sketch_scores(df, DISTRIBUTED, by), "sketches")
    whole = sketches.sketch_scores(df, DISTRIBUTED, {}).select("score", F.col("sketch").alias("direct"))
    merged = sketches.merge_sketches(sketches.merge_sketches(parts, ["source_file"])).join(whole, "score")
    merged = merged.join(parts.groupBy("score").agg(F.count(F.lit(1)).alias("parts")), "score")
    probs = [0.1, 0.5, 0.9, 0.95, 0.99]
    named = {f"q{k}": p for k, p in enumerate(probs)}
    asked = sketches.sketch_quantiles(merged, named)
    direct = [F.kll_sketch_get_quantile_double("direct", F.lit(p)).alias(f"d{k}") for k, p in enumerate(probs)]
    asked = durable(asked.select("score", "rows", "low", "high", "parts", "sketch", *named, *direct), "asked")
    limits = {r["score"]: r["q3"] for r in asked.select("score", "q3").collect()}  # one row for each score
    asked = asked.withColumn("share", sketches.share_above(limits)).drop("sketch")
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in DISTRIBUTED])
    long = df.select(F.inline(entries)).join(F.broadcast(asked), F.col("name") == F.col("score"))

    def off(value: Column, p: Column | float) -> Column:
        """How far the rank of a value is from p; a value that many rows share covers a range of ranks."""
        below, upto = F.avg((F.col("value") < value).cast("double")), F.avg((F.col("value") <= value).cast("double"))
        return F.greatest(below - p, p - upto, F.lit(0.0))

    facts = long.groupBy("score", "rows", "low", "high", "parts").agg(
        F.greatest(*[off(F.col(f"q{k}"), F.lit(p)) for k, p in enumerate(probs)]).alias("merged"),
        F.greatest(*[off(F.col(f"d{k}"), F.lit(p)) for k, p in enumerate(probs)]).alias("one"),
        F.abs(F.avg((F.col("value") > F.col("q3")).cast("double")) - F.max("share")).alias("share"),
    )
    near = [(F.col(c) <= sketches.RANK_ERROR + 1.0 / F.col("rows")).alias(f"{n}_near") for c, n in (("merged", "merged"), ("one", "direct"), ("share", "share"))]
    return facts.select("score", "rows", "low", "high", "parts", *near)


@query(
    "score_extent",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{c}' AS score, {r6(f'min({c})')} AS min, {r6(f'median({c})')} AS median, {r6(f'max({c})')} AS max FROM scores_v"
            for c in ("ae_re", "hybrid")
        )
    ),
)
def score_extent(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.score_extent(scores(spark, folder), ["ae_re", "hybrid"])


@query(
    "line_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS score, {r6(f'min({c})')} AS min, {r6(f'quantile_cont({c}, 0.5)')} AS p50,"
        f" {r6(f'quantile_cont({c}, 0.9)')} AS p90, {r6(f'quantile_cont({c}, 0.95)')} AS p95,"
        f" {r6(f'quantile_cont({c}, 0.99)')} AS p99, {r6(f'max({c})')} AS max,"
        f" round(avg({c}), 4) + 0E0 AS mean FROM lineitem"
        for c in ("l_extendedprice", "l_quantity", "l_discount")
    ),
)
def line_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """The distribution report over the largest table."""
    df = table(spark, folder, "lineitem")
    columns = ["l_extendedprice", "l_quantity", "l_discount"]
    out = thresholds.score_distribution(df, columns)
    return out.withColumn("mean", F.round("mean", 4))


_CAL = ["hybrid", "ae_re", "softmax"]


@query(
    "calibrate_thresholds",
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS score, {r6(f"(SELECT quantile_cont({c}, 0.99) FROM scores_v WHERE attack_cat = 'Normal')")} AS threshold,
 {r6(f"avg(CASE WHEN {c} > (SELECT quantile_cont({c}, 0.99) FROM scores_v WHERE attack_cat = 'Normal') THEN 1E0 ELSE 0E0 END)")} AS actual_fpr,
 count(*) AS reference_rows FROM scores_v WHERE attack_cat = 'Normal'"""
            for c in _CAL
        )
    ),
)
def calibrate_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return thresholds.calibrate(scores(spark, folder), target_fpr=0.01, label_col="attack_cat")


@query(
    "labeled_evaluation",
    with_views(
        f"""SELECT count(*) AS rows_with_labels,
 {r6(f"avg(CASE WHEN (CASE WHEN {ATTACK} THEN 'Known-Attack' ELSE 'Normal' END) = {TRUTH} THEN 1E0 ELSE 0E0 END)")} AS detection_accuracy,
 {r6(f"avg(CASE WHEN classifier_class = attack_cat THEN 1E0 ELSE 0E0 END) FILTER (WHERE {KNOWN})")} AS classifier_accuracy_known,
 {r6(f"avg(CAST(is_zeroday AS DOUBLE)) FILTER (WHERE {HELD})")} AS ood_detection_rate FROM judged_v"""
    ),
)
def labeled_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.labelled_evaluation(judged(spark, folder), "attack_cat")


@query(
    "recall_per_class",
    with_views(
        f"""SELECT attack_cat AS label, CASE WHEN {KNOWN} THEN 'known' ELSE 'held_out' END AS pool,
 {r6(f"avg(CASE WHEN CASE WHEN {KNOWN} THEN classifier_class = attack_cat ELSE is_zeroday END THEN 1E0 ELSE 0E0 END)")} AS recall,
 count(*) AS support FROM judged_v GROUP BY attack_cat"""
    ),
)
def recall_per_class(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.recall_per_class(judged(spark, folder), "attack_cat")


@query(
    "fpr_and_detection",
    with_views(
        f"""SELECT {r6("avg(CAST(is_zeroday AS DOUBLE)) FILTER (WHERE attack_cat = 'Normal')")} AS normal_false_positive_rate,
 count(*) FILTER (WHERE attack_cat = 'Normal' AND is_zeroday) AS normal_false_positive_count,
 count(*) FILTER (WHERE attack_cat = 'Normal') AS normal_count,
 {r6(f"avg(CASE WHEN {ATTACK} THEN 1E0 ELSE 0E0 END) FILTER (WHERE attack_cat <> 'Normal')")} AS attack_detection_rate,
 count(*) FILTER (WHERE attack_cat <> 'Normal') AS attack_count FROM judged_v"""
    ),
)
def fpr_and_detection(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.fpr_and_detection(judged(spark, folder), "attack_cat")


@query(
    "strict_accuracy",
    with_views(
        f"SELECT count(*) AS comparable, {r6(f'avg(CASE WHEN predicted_class = {TRUTH} THEN 1E0 ELSE 0E0 END)')} AS accuracy FROM judged_v"
    ),
)
def strict_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.strict_accuracy(judged(spark, folder), "attack_cat")


@query(
    "known_class_detection",
    with_views(
        f"""SELECT attack_cat AS label, {r6("avg(CASE WHEN classifier_class <> 'Normal' THEN 1E0 ELSE 0E0 END)")} AS detection_rate,
 count(*) AS support FROM judged_v GROUP BY 1"""
    ),
)
def known_class_detection(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.known_class_detection(judged(spark, folder), "attack_cat")


_MATRIX = (
    "matrix_v",
    'SELECT attack_cat AS "true", classifier_class AS pred, count(*) AS "count" FROM scores_v GROUP BY 1, 2',
)
_CELLS = f"""SELECT "true", pred, "count", {r6('100E0 * "count" / sum("count") OVER (PARTITION BY "true")')} AS row_pct FROM matrix_v"""


def _matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion_matrix(scores(spark, folder), "attack_cat", "classifier_class")


@query("confusion_matrix", with_views(_CELLS, _MATRIX))
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return _matrix(spark, folder)


@query(
    "top_confusions",
    with_views(f"""SELECT * FROM ({_CELLS}) WHERE "true" <> pred ORDER BY "count" DESC, row_pct DESC, "true", pred LIMIT 3""", _MATRIX),
)
def top_confusions(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.top_confusions(_matrix(spark, folder), 3)


@query(
    "classifier_report",
    with_views(
        f"""SELECT label, {r6('coalesce(hits / predicted, 0E0)')} AS precision, {r6('hits / support')} AS recall,
 {r6('CASE WHEN hits = 0 THEN 0E0 ELSE 2E0 * (hits / predicted) * (hits / support) / (hits / predicted + hits / support) END')} AS f1,
 CAST(support AS BIGINT) AS support FROM (SELECT t.label, t.support, coalesce(t.hits, 0) AS hits, p.predicted FROM
 (SELECT "true" AS label, sum("count") AS support, sum("count") FILTER (WHERE "true" = pred) AS hits FROM matrix_v GROUP BY 1) t
 LEFT JOIN (SELECT pred AS label, sum("count") AS predicted FROM matrix_v GROUP BY 1) p USING (label))""",
        _MATRIX,
    ),
)
def classifier_report(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.classifier_report(_matrix(spark, folder))


PROFILES = {
    "saved": VOTES,
    "hybrid_only": Decision(hybrid=0.95),
    "three_votes": Decision(hybrid=0.9, ae_re=0.1, softmax=0.4, mode="vote", min_votes=3),
    "fallback": Decision(fallback_ae=0.3),
}
_WHATIF = {
    "saved": ("vote_2_of_3", "CAST(hybrid > 0.99E0 AS INT) + CAST(ae_re > 0.2E0 AS INT) + CAST(1E0 - max_prob > 0.5E0 AS INT) >= 2"),
    "hybrid_only": ("hybrid_calibrated", "hybrid > 0.95E0"),
    "three_votes": ("vote_3_of_3", "hybrid > 0.9E0 AND ae_re > 0.1E0 AND 1E0 - max_prob > 0.4E0"),
    "fallback": ("ae_plus_confidence_fallback", "ae_re > 0.3E0 AND max_prob < 0.6E0"),
}


@query(
    "whatif_thresholds",
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS profile, '{rule}' AS decision_rule, count(*) FILTER (WHERE {cond}) AS zero_day_count,
 {r6(f'avg(CASE WHEN {cond} THEN 1E0 ELSE 0E0 END)')} AS zero_day_rate,
 {r6(f"avg(CASE WHEN {cond} THEN 1E0 ELSE 0E0 END) FILTER (WHERE attack_cat = 'Normal')")} AS normal_fpr,
 {r6(f"avg(CASE WHEN {cond} THEN 1E0 ELSE 0E0 END) FILTER (WHERE {HELD})")} AS ood_detection_rate FROM scores_v"""
            for name, (rule, cond) in _WHATIF.items()
        )
    ),
)
def whatif_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return thresholds.what_if(scores(spark, folder), PROFILES, "attack_cat")


METHODS = ["hybrid", "ae_re", "softmax"]
_REF = (
    "ref_v",
    """SELECT *, row_number() OVER (ORDER BY source_row) <= greatest(1, least(count(*) OVER () - 1,
 round_even(count(*) OVER () * 0.7E0, 0))) AS in_reference FROM scores_v""",
)


def _method_sql(m: str) -> str:
    limit = f"(SELECT quantile_cont({m}, 0.95) FROM ref_v WHERE in_reference AND attack_cat = 'Normal')"
    hit = f"CASE WHEN {m} > {limit} THEN 1E0 ELSE 0E0 END"
    return f"""SELECT '{m}' AS method, {r6(limit)} AS threshold, {r6(f'avg({hit})')} AS alert_rate,
 {r6(f"avg({hit}) FILTER (WHERE attack_cat = 'Normal')")} AS normal_fpr,
 {r6(f"avg({hit}) FILTER (WHERE attack_cat <> 'Normal')")} AS attack_detection_rate,
 {r6(f"avg(CASE WHEN ({m} > {limit}) = (attack_cat <> 'Normal') THEN 1E0 ELSE 0E0 END)")} AS detection_accuracy,
 {r6(f"avg({hit}) FILTER (WHERE {HELD})")} AS ood_detection_rate FROM ref_v WHERE NOT in_reference"""


_METRICS = " UNION ALL ".join(_method_sql(m) for m in METHODS)


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    marked = production.prefix_reference(scores(spark, folder), 0.7, "source_row")
    reference = evaluate.reference_rows(marked, F.col("in_reference"), "attack_cat")
    limits = evaluate.method_thresholds(reference, METHODS, 0.05)
    return evaluate.method_metrics(marked, METHODS, limits, "attack_cat", ~F.col("in_reference"))


@query("method_metrics", with_views(_METRICS, _REF))
def method_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder)


def binary_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Known and held-out rows together, target 1 for held out."""
    df = scores(spark, folder)
    known = df.where(labels.known_set(F.col("attack_cat"))).withColumn("target", F.lit(0))
    held_out = df.where(labels.held_out_set(F.col("attack_cat"))).withColumn("target", F.lit(1))
    return known.unionByName(held_out)


def long_scores(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.long_scores(binary_scores(spark, folder), METHODS, ["target", "attack_cat"])


_STEPS = (
    "steps_v",
    """SELECT method, score, pos, neg, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg,
 sum(pos) OVER (PARTITION BY method) AS p, sum(neg) OVER (PARTITION BY method) AS n FROM (
 SELECT method, score, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target = 0) AS neg FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{m}' AS method, {m} AS score, CASE WHEN {HELD} THEN 1 ELSE 0 END AS target FROM scores_v" for m in METHODS
    )
    + ") GROUP BY 1, 2) WINDOW w AS (PARTITION BY method ORDER BY score DESC)",
)
_AUC = r6("sum(neg * (cum_pos - pos / 2E0)) / (max(p) * max(n))")


@query("known_ood_union", with_views(f"SELECT attack_cat, CASE WHEN {HELD} THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS target, count(*) AS rows FROM scores_v GROUP BY 1"))
def known_ood_union(spark: SparkSession, folder: str) -> DataFrame:
    return binary_scores(spark, folder).groupBy("attack_cat", "target").agg(F.count(F.lit(1)).alias("rows"))


@query("roc_auc", with_views(f"SELECT method, {_AUC} AS auc FROM steps_v GROUP BY method", _STEPS))
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.curve_areas(evaluate.score_curve(long_scores(spark, folder))).select("method", "auc")


@query(
    "average_precision",
    with_views(f"SELECT method, {r6('sum(pos * cum_pos / (cum_pos + cum_neg)) / max(p)')} AS average_precision FROM steps_v GROUP BY method", _STEPS),
)
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.curve_areas(evaluate.score_curve(long_scores(spark, folder))).select("method", "average_precision")


@query("roc_points", with_views(f"SELECT method, {r6('score')} AS score, {r6('cum_pos / p')} AS tpr, {r6('cum_neg / n')} AS fpr FROM steps_v", _STEPS))
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.score_curve(long_scores(spark, folder)).select("method", "score", "tpr", "fpr")


@query(
    "tpr_at_fpr",
    with_views(
        f"""SELECT method, {r6("arg_min(cum_pos / p, score * -1) FILTER (WHERE cum_neg / n >= 0.01E0)")} AS tpr_1,
 {r6("arg_min(cum_pos / p, score * -1) FILTER (WHERE cum_neg / n >= 0.05E0)")} AS tpr_5 FROM steps_v GROUP BY method""",
        _STEPS,
    ),
)
def tpr_at_fpr(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.tpr_at_fpr(evaluate.score_curve(long_scores(spark, folder)))


_LIMITS = {"hybrid": 0.99, "ae_re": 0.2, "softmax": 0.5}


@query(
    "best_method_recall",
    with_views(
        f"""SELECT attack_cat AS family, b.method, {r6('''avg(CASE WHEN CASE b.method WHEN 'hybrid' THEN hybrid > 0.99E0 WHEN 'ae_re'
 THEN ae_re > 0.2E0 ELSE softmax > 0.5E0 END THEN 1E0 ELSE 0E0 END)''')} AS recall, count(*) AS support
 FROM scores_v, (SELECT arg_max(method, (auc, method)) AS method FROM (SELECT method, sum(neg * (cum_pos - pos / 2E0)) / (max(p) * max(n)) AS auc
 FROM steps_v GROUP BY method)) b WHERE {HELD} GROUP BY ALL""",
        _STEPS,
    ),
)
def best_method_recall(spark: SparkSession, folder: str) -> DataFrame:
    long = long_scores(spark, folder)
    areas = evaluate.curve_areas(evaluate.score_curve(long))
    return evaluate.best_method_recall(long, areas, _LIMITS, "attack_cat")


@query(
    "rank_methods",
    with_views(
        f"""SELECT m.method, a.auc AS auroc, a.ap AS auprc, m.alert_rate, m.ood_detection_rate, m.normal_fpr, row_number() OVER (ORDER BY coalesce(a.auc, -1) DESC,
 coalesce(m.ood_detection_rate, -1) DESC, coalesce(m.normal_fpr, 1), m.method) AS rank FROM ({_METRICS}) m
 JOIN (SELECT method, {_AUC} AS auc, {r6('sum(pos * cum_pos / (cum_pos + cum_neg)) / max(p)')} AS ap FROM steps_v GROUP BY method) a USING (method)""",
        _REF, _STEPS,
    ),
)
def rank_methods(spark: SparkSession, folder: str) -> DataFrame:
    areas = evaluate.curve_areas(evaluate.score_curve(long_scores(spark, folder))).select(
        "method", F.col("auc").alias("auroc"), F.col("average_precision").alias("auprc")
    )
    metrics = _metrics(spark, folder).select("method", "alert_rate", "ood_detection_rate", "normal_fpr")
    return evaluate.rank_methods(metrics.join(areas, "method"))


@query(
    "adaptive_threshold",
    with_views(
        f"""SELECT source_row, CASE WHEN h = 0 THEN NULL ELSE {r6('t')} END AS threshold, h > 0 AND ae_re > t AS exceeds FROM (
 SELECT source_row, ae_re, count(*) FILTER (WHERE attack_cat = 'Normal') OVER w AS h,
 (SELECT quantile_cont(x, 0.95) FROM (SELECT unnest(list_slice(hist, -25, -1)) AS x)) AS t FROM (
 SELECT source_row, src_ip, event_ts, ae_re, attack_cat, coalesce(list(ae_re) FILTER (WHERE attack_cat = 'Normal') OVER
 (PARTITION BY src_ip ORDER BY event_ts, source_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS hist FROM scores_v)
 WINDOW w AS (PARTITION BY src_ip ORDER BY event_ts, source_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
    ),
)
def adaptive_threshold(spark: SparkSession, folder: str) -> DataFrame:
    out = thresholds.adaptive_thresholds(
        scores(spark, folder), "src_ip", ["event_ts", "source_row"], "ae_re",
        F.col("attack_cat") == "Normal", window=25, target_fpr=0.05, chunk=100,
    )
    return out.select("source_row", "threshold", "exceeds")


@query(
    "threshold_overlay",
    with_views(
        f"""SELECT coalesce(a.key, b.key) AS key, coalesce(b.value, a.value) AS value FROM (SELECT classifier_class AS key,
 {r6('avg(ae_re)')} AS value FROM scores_v GROUP BY 1) a FULL JOIN (SELECT attack_cat AS key, {r6('max(ae_re)')} AS value
 FROM scores_v WHERE attack_cat <> 'DoS' GROUP BY 1) b ON a.key = b.key"""
    ),
)
def threshold_overlay(spark: SparkSession, folder: str) -> DataFrame:
    df = scores(spark, folder)
    saved = df.groupBy(F.col("classifier_class").alias("key")).agg(F.avg("ae_re").alias("value"))
    local = df.where("attack_cat <> 'DoS'").groupBy(F.col("attack_cat").alias("key")).agg(F.max("ae_re").alias("value"))
    return thresholds.overlay(saved, local)


_HALF = "CAST(event_ts AS DATE) < DATE '2024-01-16'"


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Reference: the first half of the period; current: the second, errors scaled up."""
    df = judged(spark, folder)
    early = F.to_date("event_ts") < F.lit("2024-01-16").cast("date")
    return df.where(early), df.where(~early).withColumn("ae_re", F.col("ae_re") * 1.7)


_DRIFT_V = (
    ("early_v", f"SELECT * FROM judged_v WHERE {_HALF}"),
    ("late_v", f"SELECT * REPLACE (ae_re * 1.7E0 AS ae_re) FROM judged_v WHERE NOT ({_HALF})"),
)
_STATS = ["mean", "p50", "p90", "p95", "p99"]


def _stat(c: str, s: str) -> str:
    return f"avg({c})" if s == "mean" else f"quantile_cont({c}, 0.{s[1:]})"


_DRIFT = " UNION ALL ".join(
    f"""SELECT '{c}' AS score, '{s}' AS statistic, a.v AS reference, b.v AS current, b.v - a.v AS delta,
 CASE WHEN abs(a.v) >= 1E-12 THEN b.v / a.v END AS ratio FROM (SELECT {_stat(c, s)} AS v FROM early_v) a, (SELECT {_stat(c, s)} AS v FROM late_v) b"""
    for c in ("ae_re", "hybrid", "softmax")
    for s in _STATS
)


@query(
    "score_drift",
    with_views(
        f"SELECT score, statistic, {r6('reference')} AS reference, {r6('current')} AS current, {r6('delta')} AS delta, {r6('ratio')} AS ratio FROM ({_DRIFT})",
        *_DRIFT_V,
    ),
)
def score_drift(spark: SparkSession, folder: str) -> DataFrame:
    early, late = _halves(spark, folder)
    columns = ["ae_re", "hybrid", "softmax"]
    return drift_op.score_drift(thresholds.score_distribution(early, columns), thresholds.score_distribution(late, columns))


_RATES = "(SELECT avg(CAST(is_zeroday AS DOUBLE)) AS ref FROM early_v) r, (SELECT avg(CAST(is_zeroday AS DOUBLE)) AS cur FROM late_v) c"


@query(
    "drift_report",
    with_views(
        f"""SELECT true AS reference_available, {r6('ref')} AS reference_rate, {r6('cur')} AS current_rate, CASE WHEN warnings IS NULL THEN 'MEDIUM'
 ELSE 'HIGH' END AS level, concat_ws('|', 'Feature coverage is moderate (72.0%); review mapped columns.',
 CASE WHEN abs(cur - ref) >= 0.0001E0 THEN concat('Zero-day candidate rate changed by ', CASE WHEN cur >= ref THEN '+' ELSE '' END,
 printf('%.1f', (cur - ref) * 100), '% (reference ', printf('%.1f', ref * 100), '%, current ', printf('%.1f', cur * 100), '%).') END,
 warnings) AS warnings, CASE WHEN warnings IS NULL THEN 'Inspect score distribution changes and consider local threshold calibration before operational demos.'
 ELSE 'Review normalization quality, inspect top alerts, and recalibrate thresholds on representative benign rows.' END AS recommended_action
 FROM {_RATES}, (SELECT string_agg(concat(score, ': ', printf('%.6f', current), ' current p95 is ', printf('%.2f', ratio),
 'x the reference p95 for score distribution.'), '|' ORDER BY score) AS warnings FROM ({_DRIFT}) WHERE statistic = 'p95' AND ratio > 1.5E0)""",
        *_DRIFT_V,
    ),
)
def drift_report(spark: SparkSession, folder: str) -> DataFrame:
    early, late = _halves(spark, folder)
    columns = ["ae_re", "hybrid", "softmax"]
    moved = drift_op.score_drift(thresholds.score_distribution(early, columns), thresholds.score_distribution(late, columns))
    return drift_op.drift_report(
        moved, evaluate.zero_day_summary(early), evaluate.zero_day_summary(late), coverage=0.72, rate_delta=0.0001
    )


@query(
    "drift_report_alone",
    with_views(
        f"""SELECT false AS reference_available, CAST(NULL AS DOUBLE) AS reference_rate, {r6('cur')} AS current_rate, 'HIGH' AS level,
 'Feature coverage is low (41.0%); scores are weak triage signals.|No reference report was available; only absolute current distributions were reported.' AS warnings,
 'Review normalization quality, inspect top alerts, and recalibrate thresholds on representative benign rows.' AS recommended_action
 FROM {_RATES}""",
        *_DRIFT_V,
    ),
)
def drift_report_alone(spark: SparkSession, folder: str) -> DataFrame:
    """No reference report and poor coverage."""
    _, late = _halves(spark, folder)
    return drift_op.drift_report(None, None, evaluate.zero_day_summary(late), coverage=0.41)


@query(
    "decision_space",
    with_views(
        f"""SELECT population, source_row, {r6('1E0 - max_prob')} AS attack_probability, {r6('ae_re')} AS reconstruction_error FROM (
 SELECT *, row_number() OVER (PARTITION BY population ORDER BY md5(concat('42:', CAST(source_row AS STRING))), source_row) AS rn FROM (
 SELECT *, CASE WHEN attack_cat = 'Normal' THEN 'Benign' WHEN {HELD} THEN 'Zero-Day Attack' ELSE 'Known Attack' END AS population
 FROM scores_v)) WHERE rn <= 500"""
    ),
)
def decision_space(spark: SparkSession, folder: str) -> DataFrame:
    population = (
        F.when(F.col("attack_cat") == "Normal", F.lit("Benign"))
        .when(labels.held_out_set(F.col("attack_cat")), F.lit("Zero-Day Attack"))
        .otherwise(F.lit("Known Attack"))
    )
    df = scores(spark, folder).select("source_row", population.alias("population"), "max_prob", "ae_re")
    return sampling.stable_sample(df, 500, "source_row", ["population"]).select(
        "population", "source_row", (F.lit(1.0) - F.col("max_prob")).alias("attack_probability"),
        F.col("ae_re").alias("reconstruction_error"),
    )


@query(
    "unpivot_scores",
    with_views(" UNION ALL ".join(f"SELECT source_row, '{m}' AS method, {r6(m)} AS score FROM scores_v" for m in METHODS)),
)
def unpivot_scores(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.long_scores(scores(spark, folder), METHODS, ["source_row"])
