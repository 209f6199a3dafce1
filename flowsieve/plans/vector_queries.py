"""Vector distances, outlier baselines and fitted models."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.functions import vectors as V
from flowsieve.functions.scoring import Decision
from flowsieve.operators import evaluate, forest, graph, models, neighbors, prepare, production, sampling, thresholds
from flowsieve.plans.base import judged, query, r6, table, with_views
from flowsieve.plans.prepare_queries import feature_input
from flowsieve.session import durable, small_side, work_dir
from flowsieve.sources import state

KNOWN_LABELS = "label < 5"
_UNIT = (
    "unit_v",
    """SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_sum(list_transform(
 CAST(embedding AS DOUBLE[]), lambda y: y * y))), 1E-12)) AS u FROM embeddings""",
)
_MEANS = (
    "means_v",
    """SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(u) AS x,
 generate_subscripts(u, 1) AS i FROM unit_v) GROUP BY ALL) GROUP BY label""",
)
_PROTO = (
    "proto_v",
    "SELECT label, list_transform(m, lambda x: x / greatest(sqrt(list_sum(list_transform(m, lambda y: y * y))), 1E-12)) AS p FROM means_v",
)


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


@query(
    "centroid_distance",
    with_views(
        f"SELECT vec_id, {r6('min(list_distance(u, p))')} AS fv_cluster FROM unit_v, (SELECT * FROM proto_v WHERE {KNOWN_LABELS}) GROUP BY vec_id",
        _UNIT, _MEANS, _PROTO,
    ),
)
def centroid_distance(spark: SparkSession, folder: str) -> DataFrame:
    df = embeddings(spark, folder)
    # one prototype per class: a fitted state of a few rows
    fitted = neighbors.prototypes(df.where(KNOWN_LABELS), "embedding", "label").orderBy("class").collect()
    distance = neighbors.centroid_distance(F.col("embedding"), [r["prototype"] for r in fitted])
    return df.select("vec_id", distance.alias("fv_cluster"))


@query(
    "prototype_similarity",
    with_views(
        f"SELECT CAST(a.label AS BIGINT) AS class_a, CAST(b.label AS BIGINT) AS class_b, {r6('list_dot_product(a.p, b.p)')} AS similarity FROM proto_v a JOIN proto_v b ON b.label = a.label + 1",
        _UNIT, _MEANS, _PROTO,
    ),
)
def prototype_similarity(spark: SparkSession, folder: str) -> DataFrame:
    pairs = [(k, k + 1) for k in range(9)]
    return neighbors.prototype_similarity(embeddings(spark, folder), "embedding", "label", pairs).select(
        F.col("class_a").cast("long"), F.col("class_b").cast("long"), "similarity"
    )


@query(
    "knn_distance",
    with_views(
        f"""SELECT vec_id, {r6('avg(d)')} AS knn_distance FROM (SELECT q.vec_id, 1 - list_dot_product(q.u, r.u) AS d, row_number() OVER (
 PARTITION BY q.vec_id ORDER BY round(1 - list_dot_product(q.u, r.u), 12), r.vec_id) AS rn FROM unit_v q,
 (SELECT * FROM unit_v WHERE {KNOWN_LABELS}) r) WHERE rn <= 20 GROUP BY vec_id""",
        _UNIT,
    ),
)
def knn_distance(spark: SparkSession, folder: str) -> DataFrame:
    df = embeddings(spark, folder)
    return neighbors.knn_distance(df, df.where(KNOWN_LABELS), "vec_id", "embedding", k=20)


@query("knn_approx", "SELECT vec_id, CAST(20 AS BIGINT) AS neighbours, true AS most_found, true AS recalled FROM embeddings")
def knn_approx(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbour graph against the exact neighbours: recall of each row, and 0.9 or more on average."""
    df = embeddings(spark, folder)
    found = graph.neighbor_graph(df, "vec_id", "embedding", k=20, directions=2, block=32, settled=0.01).pairs
    exact = neighbors.nearest_rows(df, "vec_id", "embedding", k=20).select("query_id", "ref_id", F.lit(1).alias("true"))
    per_row = found.join(exact, ["query_id", "ref_id"], "left").groupBy(F.col("query_id").alias("vec_id")).agg(
        F.count(F.lit(1)).alias("neighbours"), (F.count("true") / 20.0).alias("recall")
    )
    per_row = durable(per_row, "recalls")
    mean = per_row.agg(F.avg("recall").alias("mean"))
    return per_row.crossJoin(F.broadcast(mean)).select(
        "vec_id", "neighbours", (F.col("recall") >= 0.5).alias("most_found"), (F.col("mean") >= 0.9).alias("recalled")
    )


_PAIRS = (
    "pairs_v",
    """SELECT q.vec_id AS q, r.vec_id AS r, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS d
 FROM embeddings q, (SELECT * FROM embeddings WHERE label < 5) r""",
)
_NEAR = (
    "near_v",
    """SELECT q, r, d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 12), r) AS rn FROM pairs_v
 WHERE q <> r AND q IN (SELECT vec_id FROM embeddings WHERE label < 5)) WHERE rn <= 10""",
)
_KD = ("kd_v", "SELECT q AS r, max(d) AS kd FROM near_v GROUP BY q")
_DENS = ("dens_v", "SELECT q, 1 / (avg(greatest(d, kd)) + 1E-10) AS lrd FROM near_v JOIN kd_v USING (r) GROUP BY q")
_SCORED = ("scored_v", "SELECT q, r, d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 12), r) AS rn FROM pairs_v) WHERE rn <= 10")


@query(
    "lof",
    with_views(
        f"""SELECT s.q AS vec_id, {r6('avg(n.lrd) * (avg(greatest(s.d, kd)) + 1E-10)')} AS lof,
 {r6('avg(n.lrd) * (avg(greatest(s.d, kd)) + 1E-10) - 1.5E0')} AS local_outlier_factor
 FROM scored_v s JOIN kd_v USING (r) JOIN dens_v n ON n.q = s.r GROUP BY s.q""",
        _PAIRS, _NEAR, _KD, _DENS, _SCORED,
    ),
)
def lof(spark: SparkSession, folder: str) -> DataFrame:
    df = embeddings(spark, folder)
    return neighbors.local_outlier_factor(df, df.where(KNOWN_LABELS), "vec_id", "embedding", k=10)


@query(
    "build_centroids",
    with_views(
        """SELECT CAST(label AS BIGINT) AS class, least(25, count(*)) AS clusters, true AS numbered, true AS inside_ball, true AS mean_kept,
 true AS stationary FROM unit_v GROUP BY label""",
        _UNIT,
    ),
)
def build_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of each class: how many, and what must hold of k-means whatever its seeds.

    Centres are means of unit vectors, so none lies outside the unit ball; every centre
    has rows; and assigning the rows again gives the centres that were saved.
    """
    df = embeddings(spark, folder)
    fitted = durable(models.build_centroids(df, "embedding", "label", k=25), "centroids")
    listed = small_side(fitted.groupBy("class").agg(F.collect_list(F.struct("cluster", "centroid")).alias("centers")), "class-centers")
    units = df.select(F.col("label").alias("class"), "vec_id", "embedding", V.unit(F.col("embedding")).alias("u"))
    # at most 25 centres of its own class for each row, of which it goes on with the number of the nearest
    gap = F.transform("centers", lambda c: F.struct(V.squared_distance(F.col("u"), c["centroid"]).alias("gap"), c["cluster"].alias("cluster")))
    near = units.join(listed, "class").select("class", "vec_id", "embedding", F.array_min(gap).alias("own"))
    pairs = near.groupBy("class", "vec_id").agg(F.min_by(F.struct("own.cluster", "embedding"), "own").alias("near"))
    entries = pairs.select("class", "near.cluster", F.posexplode(V.unit(F.col("near.embedding"))).alias("dim", "x"))
    saved = fitted.select("class", "cluster", F.posexplode("centroid").alias("dim", "at"))
    means = entries.groupBy("class", "cluster", "dim").agg(F.avg("x").alias("x")).join(saved, ["class", "cluster", "dim"])
    means = means.withColumn("off", F.abs(F.col("x") - F.col("at")))
    used = means.groupBy("class").agg(F.countDistinct("cluster").alias("used"), F.max("off").alias("off"))
    facts = fitted.groupBy("class").agg(
        F.count(F.lit(1)).alias("clusters"),
        (F.max("cluster") == F.count(F.lit(1)) - 1).alias("numbered"),
        (F.max(V.norm(F.col("centroid"))) <= 1 + 1e-9).alias("inside_ball"),
    )
    return facts.join(used, "class").select(
        F.col("class").cast("long").alias("class"), "clusters", "numbered", "inside_ball", (F.col("used") == F.col("clusters")).alias("mean_kept"),
        (F.col("off") < 1e-6).alias("stationary"),
    )


def model_input(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(train, all, features): every numeric feature that varies, scaled; all is fitted on the train part."""
    df = prepare.engineer_features(feature_input(spark, folder))
    names = [n for n in prepare.numeric_features(df) if n != "source_row"]
    # fits read the feature table many times; it is computed once
    split = durable(sampling.hash_split(df.select("source_row", "attack_cat", *names), "source_row"), "features")
    train = split.where("split = 'train' AND attack_cat <> 'Fuzzers'")
    varies = prepare.feature_variance(train, names).where("keep").select("feature").collect()  # one row for each feature
    names = [n for n in names if n in {r["feature"] for r in varies}]
    fitted = prepare.robust_fit(train, names)
    return durable(prepare.robust_scale(train, fitted), "train"), durable(prepare.robust_scale(split, fitted), "scaled"), names


CLASSES = ["DoS", "Exploits", "Normal", "Reconnaissance"]


def _weight_rows(model) -> list[list[float]]:
    """(intercept, weights) of each class, centred so that they do not depend on the solver's zero point."""
    return [[float(b), *map(float, w)] for b, w in zip(model.interceptVector, model.coefficientMatrix.toArray(), strict=True)]


def _softmax(names: list[str], weights: list[list[float]]) -> Column:
    """Class probabilities from saved numbers, as plain arithmetic on whole batches."""
    saved = np.array(weights, dtype="float64")

    def shares(rows: np.ndarray) -> np.ndarray:
        logits = saved[:, 0] + rows @ saved[:, 1:].T
        powers = np.exp(logits - logits.max(axis=1, keepdims=True))
        return powers / powers.sum(axis=1, keepdims=True)

    return V.by_matrix(F.array(*[F.col(n) for n in names]), len(names), shares, "array<double>")


def _apart(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


@query(
    "model_scores",
    with_views(
        "SELECT source_row, attack_cat, true AS probabilities_agree, true AS error_agrees, true AS verdict_agrees, true AS known_class FROM flows_v"
    ),
)
def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Features, scaling, classifier, reconstruction, calibration, decision: the whole chain on every feature.

    Each row's scores are worked out again from saved numbers: probabilities from the
    classifier's weights, the error from the components, the verdict from the limits.
    """
    train, everything, names = model_input(spark, folder)
    classifier = models.fit_classifier(train, names, "attack_cat", CLASSES)
    pca = models.fit_reconstruction(train, names, k=8)
    center = models.feature_means(train, names)
    scored = models.class_probabilities(everything, classifier, names)
    values, directions = F.array(*[F.col(n) for n in names]), pca.pc.toArray()
    scored = scored.withColumn("ae_re", models.reconstruction_error(values, directions, center))

    # the distance to the projection itself, component by component
    def apart(rows: np.ndarray) -> np.ndarray:
        away = rows - np.array(center)
        return ((away - (away @ directions) @ directions.T) ** 2).sum(axis=1) / float(len(names))

    error = V.by_matrix(values, len(names), apart)
    scored = scored.withColumns({"again": _softmax(names, _weight_rows(classifier)), "error": error})
    keep = ["source_row", "attack_cat", "split", "probs", "again", "error"]
    scored = durable(scored.select("ae_re", *keep), "model-scores")
    validation = models.score_table(scored.where("split = 'validation'"), CLASSES, Decision(), None, keep[:3])
    weights = models.fit_hybrid(validation, F.col("attack_cat") == "Fuzzers")
    validation = models.score_table(scored.where("split = 'validation'"), CLASSES, Decision(), weights, keep[:3])
    limits = durable(thresholds.calibrate(validation, ["hybrid", "ae_re", "softmax"], 0.05, "attack_cat"), "limits")
    judged_ = models.score_table(scored, CLASSES, thresholds.decision_from(limits), weights, keep)
    limit = limits.agg(*[F.max(F.when(F.col("score") == s, F.col("threshold"))).alias(f"at_{s}") for s in ("hybrid", "ae_re", "softmax")])
    hybrid = 1.0 / (1.0 + F.exp(-(F.lit(weights.ae_re) * F.col("error") + F.lit(weights.softmax) * (1.0 - F.array_max("again")) + F.lit(weights.intercept))))
    # a score that lies on its limit up to rounding may fall on either side
    beyond = {"hybrid": hybrid, "ae_re": F.col("error"), "softmax": 1.0 - F.array_max("again")}
    sure = [F.abs(v - F.col(f"at_{s}")) > 1e-9 for s, v in beyond.items()]
    votes = sum(((v > F.col(f"at_{s}")).cast("int") for s, v in beyond.items()), F.lit(0))
    flag = F.col("zero_day_rule").startswith("vote") & ((votes >= 2) == F.col("is_zeroday")) | ~F.col("zero_day_rule").startswith("vote")
    doubtful = ~(sure[0] & sure[1] & sure[2])
    return judged_.crossJoin(F.broadcast(limit)).select(
        "source_row", "attack_cat", (_apart(F.col("probs"), F.col("again")) < 1e-9).alias("probabilities_agree"),
        (F.abs(F.col("ae_re") - F.col("error")) < 1e-9 * (1.0 + F.col("error"))).alias("error_agrees"),
        (flag | doubtful).alias("verdict_agrees"), F.col("classifier_class").isin(CLASSES).alias("known_class"),
    )


@query(
    "model_ensemble",
    with_views("SELECT source_row, CAST(5 AS BIGINT) AS members, true AS members_agree, true AS entropy_agrees, true AS shares FROM flows_v"),
)
def model_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """Uncertainty over bagged classifiers, and a perceptron; member probabilities worked out again from saved weights."""
    train, everything, names = model_input(spark, folder)
    members = models.fit_ensemble(train, names, "attack_cat", CLASSES, "source_row", members=5)
    perceptron = models.fit_perceptron(train, names, "attack_cat", CLASSES, "source_row", max_iter=30)
    samples = models.member_probabilities(everything, members, names, ["source_row"])
    uncertain = models.ensemble_uncertainty(samples, ["source_row"])
    weights = F.array(*[F.struct(F.lit(k).alias("member"), _softmax(names, _weight_rows(m)).alias("again")) for k, m in enumerate(members)])
    again = everything.select(F.col("source_row").alias("row"), F.inline(weights))
    both = samples.join(again.withColumnRenamed("member", "m"), (F.col("source_row") == F.col("row")) & (F.col("member") == F.col("m")))
    mean = F.array(*[F.avg(F.get("again", F.lit(k))) for k in range(len(CLASSES))])
    plain = both.groupBy(F.col("source_row").alias("row")).agg(
        F.count(F.lit(1)).alias("members"), F.max(_apart(F.col("probs"), F.col("again"))).alias("apart"), mean.alias("mean")
    )
    entropy = F.aggregate(F.transform("mean", lambda p: -p * F.log(F.greatest(p, F.lit(1e-12)))), F.lit(0.0), lambda s, x: s + x)
    classed = models.class_probabilities(everything.select("source_row", *names), perceptron, names)
    total = F.aggregate("probs", F.lit(0.0), lambda s, x: s + x)
    shares = classed.select(F.col("source_row").alias("own"), (F.abs(total - 1.0) < 1e-9).alias("shares"))
    joined = uncertain.join(plain, F.col("source_row") == F.col("row")).join(shares, F.col("source_row") == F.col("own"))
    return joined.select(
        "source_row", "members", (F.col("apart") < 1e-9).alias("members_agree"), (F.abs(F.col("entropy") - entropy) < 1e-9).alias("entropy_agrees"), "shares"
    )


@query(
    "state_roundtrip",
    with_views(
        """SELECT 'centroids' AS kind, CAST(2 AS BIGINT) AS versions, count(*) AS rows, true AS same FROM embeddings
 UNION ALL SELECT 'classifier', 2, count(*), true FROM flows_v UNION ALL SELECT 'forest', 2, count(*), true FROM flows_v
 UNION ALL SELECT 'reconstruction', 2, count(*), true FROM flows_v"""
    ),
)
def state_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of each kind of fitted state are saved; scores by the newest, loaded again, equal the direct ones."""
    path = f"{work_dir(spark)}/flowsieve/registry-{uuid.uuid4().hex}"
    train, everything, names = model_input(spark, folder)
    vectors = embeddings(spark, folder)
    fitted = {
        "centroids": durable(models.build_centroids(vectors, "embedding", "label", k=3, max_rounds=3), "centroids"),
        "classifier": models.fit_classifier(train, names, "attack_cat", CLASSES, max_iter=10),
        "forest": durable(forest.fit_forest(train, names, "source_row", trees=20), "forest"),
        "reconstruction": models.fit_reconstruction(train, names, k=4),
    }
    for kind, made in fitted.items():
        old = made.limit(1) if isinstance(made, DataFrame) else made
        for version in (old, made):
            state.save_state(spark, path, kind, version)
    back = {kind: state.load_state(spark, path, kind) for kind in fitted}

    def scores_of(some: dict) -> dict[str, DataFrame]:
        centers = [r["centroid"] for r in some["centroids"].orderBy("class", "cluster").collect()]  # at most k for each class
        code = models.reconstruction_error(F.array(*names), some["reconstruction"].pc.toArray(), [0.0] * len(names))
        probs = models.class_probabilities(everything, some["classifier"], names)
        return {
            "centroids": vectors.select(F.col("vec_id").alias("id"), neighbors.centroid_distance(F.col("embedding"), centers).alias("score")),
            "classifier": probs.select(F.col("source_row").alias("id"), F.array_max("probs").alias("score")),
            "forest": forest.score_forest(everything, some["forest"], names, 256, ["source_row"]).toDF("id", "score"),
            "reconstruction": everything.select(F.col("source_row").alias("id"), code.alias("score")),
        }

    direct, loaded = scores_of(fitted), scores_of(back)
    counted = state.state_versions(spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("versions"))
    parts = []
    for kind in fitted:
        both = direct[kind].join(loaded[kind].toDF("own", "again"), F.col("id") == F.col("own"))
        parts.append(both.agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("score") == F.col("again")).alias("same")).withColumn("kind", F.lit(kind)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(counted, "kind").select("kind", "versions", "rows", "same")


@query(
    "isolation_forest",
    with_views("SELECT source_row, true AS in_range, CAST(200 AS BIGINT) AS trees, true AS bounded, true AS apart FROM flows_v"),
)
def isolation_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Every row scored: scores lie in (-0.5, 0.5], no tree is deeper than its sub-sample allows, and rows that are far out in every feature come first."""
    train, everything, names = model_input(spark, folder)
    grown = durable(forest.fit_forest(train.where("attack_cat = 'Normal'"), names, "source_row", trees=200), "forest")
    scored = forest.score_forest(everything, grown, names, 256, ["source_row"])
    # ten planted rows, further out than any, must rank above all others but few
    planted = spark.range(10).select((-F.col("id") - 1).alias("source_row"), *[F.lit(10.0).alias(n) for n in names])
    least = forest.score_forest(planted, grown, names, 256, ["source_row"]).agg(F.min("isolation_forest").alias("least"))
    leaves = grown.where("feature < 0")
    shape = leaves.agg(
        F.countDistinct("tree").alias("trees"), (F.max("depth") <= 8 + forest.average_path(256)).alias("bounded")
    ).first()
    scored = durable(scored, "isolated")
    above = scored.crossJoin(F.broadcast(least)).agg(F.avg((F.col("isolation_forest") > F.col("least")).cast("double")).alias("share"))
    score = F.col("isolation_forest")
    in_range = ((score > -0.5) & (score <= 0.5)).alias("in_range")
    return scored.crossJoin(F.broadcast(above)).select(
        "source_row", in_range, F.lit(shape["trees"]).alias("trees"), F.lit(shape["bounded"]).alias("bounded"), (F.col("share") < 0.01).alias("apart")
    )


METHODS = ["ids_active", "ids_hybrid", "ids_ae_re", "isolation_forest", "local_outlier_factor"]


@query(
    "baseline_methods",
    "SELECT method, n > 0 AS rates_agree, true AS areas_agree, true AS ranked FROM (SELECT unnest(['"
    + "', '".join(METHODS)
    + "']) AS method), (SELECT count(*) AS n FROM events)",
)
def baseline_methods(spark: SparkSession, folder: str) -> DataFrame:
    """Forest and outlier factor beside the given scores: fitted on a prefix, judged on the rest.

    Rates are counted again from the stored scores and limits, the area under the curve
    as the share of (attack, normal) pairs in the right order, the ranking from both.
    """
    _, everything, names = model_input(spark, folder)
    given = judged(spark, folder).select(
        "source_row", F.col("is_zeroday").cast("double").alias("ids_active"),
        F.col("hybrid").alias("ids_hybrid"), F.col("ae_re").alias("ids_ae_re"),
    )
    marked = production.prefix_reference(everything.drop("split"), 0.7, "source_row")
    reference = evaluate.reference_rows(marked, F.col("in_reference"), "attack_cat")
    grown = forest.fit_forest(reference, names, "source_row", trees=200)
    isolated = forest.score_forest(marked, grown, names, 256, ["source_row", "attack_cat", "in_reference"])
    vectors = marked.select("source_row", F.array(*names).alias("v"))
    fitted = reference.select("source_row", F.array(*names).alias("v"))
    factor = neighbors.local_outlier_factor(vectors, fitted, "source_row", "v", k=35).drop("lof")
    table_ = durable(isolated.join(factor, "source_row").join(given, "source_row"), "baseline-scores")
    limits = evaluate.method_thresholds(
        evaluate.reference_rows(table_, F.col("in_reference"), "attack_cat"), METHODS, 0.01, flags=["ids_active"]
    )
    metrics = evaluate.method_metrics(table_, METHODS, limits, "attack_cat", ~F.col("in_reference"))
    rest = table_.where("not in_reference").withColumn("target", (F.col("attack_cat") != "Normal").cast("int"))
    areas = evaluate.curve_areas(evaluate.score_curve(evaluate.long_scores(rest, METHODS, ["target"])))
    joined = metrics.join(areas.withColumnRenamed("auc", "auroc").withColumnRenamed("average_precision", "auprc"), "method")
    ranked = durable(evaluate.rank_methods(joined), "baseline-ranking")
    return _recomputed(ranked, rest)


def _recomputed(ranked: DataFrame, rest: DataFrame) -> DataFrame:
    """What the ranking says of each method, against counting the stored scores plainly."""
    long = rest.select("target", F.inline(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("s")) for m in METHODS])))
    # normal scores below each attack score, ties as one half, by running counts over distinct scores
    tied = long.groupBy("m", "s").agg(F.sum("target").alias("attacks"), F.sum(1 - F.col("target")).alias("normals"))
    below = F.sum("normals").over(Window.partitionBy("m").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    pairs = tied.withColumn("below", F.coalesce(below, F.lit(0))).groupBy("m").agg(
        (F.sum(F.col("attacks") * (F.col("below") + F.col("normals") / 2.0)) / (F.sum("attacks") * F.sum("normals"))).alias("area")
    )
    # one row for each method
    falls = F.coalesce(F.lag("auroc").over(Window.orderBy("rank")) >= F.col("auroc"), F.lit(True))
    limits = ranked.select(F.col("method").alias("l"), "threshold", "normal_fpr", "attack_detection_rate", "auroc", falls.alias("ranked"))
    flagged = long.join(limits, F.col("m") == F.col("l")).withColumn("hit", (F.col("s") > F.col("threshold")).cast("double"))
    rates = flagged.groupBy("m").agg(
        F.avg(F.when(F.col("target") == 0, F.col("hit"))).alias("fpr"), F.avg(F.when(F.col("target") == 1, F.col("hit"))).alias("recall")
    )
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-9
    joined = limits.join(rates.withColumnRenamed("m", "m1"), F.col("l") == F.col("m1")).join(pairs.withColumnRenamed("m", "m2"), F.col("l") == F.col("m2"))
    return joined.select(
        F.col("l").alias("method"), (near("normal_fpr", "fpr") & near("attack_detection_rate", "recall")).alias("rates_agree"),
        near("auroc", "area").alias("areas_agree"), "ranked",
    )


@query(
    "fit_hybrid_meta",
    with_views(
        """SELECT count(*) AS rows, count(*) FILTER (WHERE attack_cat = 'Fuzzers') AS positives, true AS stationary FROM judged_v"""
    ),
)
def fit_hybrid_meta(spark: SparkSession, folder: str) -> DataFrame:
    """The fit is where the gradient of the penalised, balanced log loss vanishes."""
    rows = judged(spark, folder)
    w = models.fit_hybrid(rows, F.col("attack_cat") == "Fuzzers")
    positive, softmax = (F.col("attack_cat") == "Fuzzers").cast("double"), 1.0 - F.col("max_prob")
    p = 1.0 / (1.0 + F.exp(-(w.ae_re * F.col("ae_re") + w.softmax * softmax + w.intercept)))
    facts = rows.select(positive.alias("y"), (p - positive).alias("e"), F.col("ae_re").alias("x1"), softmax.alias("x2")).groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col("e") * (F.col(x) if x else 1.0)).alias(f"g{k}") for k, x in enumerate(("x1", "x2", None))]
    )
    penalty = (w.ae_re, w.softmax, 0.0)
    # both classes weigh one half; the penalty is the weight over the number of rows
    gradient = [F.abs(F.sum(F.col(f"g{k}")) / 2 + F.lit(penalty[k]) / F.sum("n")) for k in range(3)]
    return facts.agg(
        F.sum("n").alias("rows"), F.max(F.when(F.col("y") == 1.0, F.col("n"))).alias("positives"),
        (F.greatest(*gradient) < 1e-4).alias("stationary"),
    )
