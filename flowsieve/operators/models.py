"""Distributed models whose only contract is the score table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from flowsieve.functions import scoring
from flowsieve.functions import vectors as V
from flowsieve.functions.core import ref
from flowsieve.functions.scoring import Decision, HybridWeights
from flowsieve.operators.prepare import class_weights
from flowsieve.operators.sampling import poisson_draw
from flowsieve.session import durable, small_side

FITS_AT_ONCE = 3
CENTER_BYTES = 8 << 20


def feature_vector(features: Sequence[str]) -> Column:
    return array_to_vector(F.array(*[ref(f).cast("double") for f in features]))


def fit_classifier(
    train: DataFrame,
    features: Sequence[str],
    class_col: str,
    class_names: Sequence[str],
    multipliers: Mapping[str, float] | None = None,
    max_iter: int = 50,
    reg: float = 1e-4,
) -> LogisticRegressionModel:
    """Known-class classifier with balanced, optionally boosted class weights."""
    index = F.array_position(F.lit(list(class_names)), ref(class_col)) - 1
    weighted = class_weights(train, class_col, multipliers).select(
        feature_vector(features).alias("features"), index.cast("double").alias("label"), "weight"
    ).where("label >= 0")
    return LogisticRegression(
        weightCol="weight", family="multinomial", maxIter=max_iter, regParam=reg
    ).fit(weighted)


def class_probabilities(df: DataFrame, model: LogisticRegressionModel, features: Sequence[str]) -> DataFrame:
    """Add ``probs`` and ``logits`` arrays."""
    scored = model.transform(df.withColumn("features", feature_vector(features)))
    return scored.withColumns(
        {"probs": vector_to_array("probability"), "logits": vector_to_array("rawPrediction")}
    ).drop("features", "probability", "rawPrediction", "prediction")


def fit_reconstruction(train: DataFrame, features: Sequence[str], k: int) -> PCAModel:
    """Linear autoencoder: the top ``k`` principal directions."""
    vectors = train.select(feature_vector(features).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="code").fit(vectors)


def reconstruction_error(values: Column, directions: np.ndarray, center: Sequence[float]) -> Column:
    """Mean squared distance of x to its projection on the fitted directions."""
    axes, middle = np.asarray(directions, dtype="float64"), np.array([float(c) for c in center])

    def error(rows: np.ndarray) -> np.ndarray:
        away = rows - middle
        left = (away**2).sum(axis=1)
        # sums along a row, not a matrix product, whose last digits depend on a row's place in its batch
        for axis in axes.T:
            left = left - (away * axis).sum(axis=1) ** 2
        return np.maximum(left, 0.0) / float(len(middle))

    return V.by_matrix(values, len(middle), error)


def feature_means(df: DataFrame, features: Sequence[str]) -> list[float]:
    row = df.agg(*[F.avg(ref(f)).alias(f) for f in features]).first()
    return [float(row[f] or 0.0) for f in features]


def _of_class(centers: DataFrame) -> DataFrame:
    """(class, centers): the centres of each class in one row, by cluster number."""
    listed = F.array_sort(F.collect_list(F.struct("cluster", "centroid")))
    return centers.groupBy(F.col("class").alias("_class")).agg(F.transform(listed, lambda c: c["centroid"]).alias("centers"))


def _held(centers: DataFrame) -> dict[int, np.ndarray] | None:
    """The centres of each class as a matrix, by cluster number; none if they are too many to be sent to every task."""
    size = centers.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("d")).first()
    if size["n"] * (size["d"] or 0) * 8 > CENTER_BYTES:
        return None
    found: dict[int, list] = {}
    for row in centers.orderBy("class", "cluster").collect():
        found.setdefault(row["class"], []).append(row["centroid"])
    return {c: np.array(rows, dtype="float64") for c, rows in found.items()}


def _closest(rows: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first nearest centre, squared distance to it) of each row."""
    best, gap = np.zeros(len(rows), dtype="int32"), np.full(len(rows), np.inf)
    for at in range(0, len(rows), 1024):
        some, low, own = rows[at:at + 1024], gap[at:at + 1024], best[at:at + 1024]
        for k, center in enumerate(centers):
            away = some - center
            squared = np.einsum("ij,ij->i", away, away)
            nearer = squared < low
            own[nearer], low[nearer] = k, squared[nearer]
    return best, gap


def _by_class(pdf: pd.DataFrame, held: dict[int, np.ndarray]) -> Iterator[tuple]:
    """(class, places of its rows, the rows, cluster, squared distance) for each class of a batch."""
    classes = pdf["class"].to_numpy()
    for c in np.unique(classes).tolist():
        at = np.flatnonzero(classes == c)
        rows = np.stack(pdf["unit"].iloc[at].to_numpy())
        yield c, at, rows, *_closest(rows, held[c])


def _assigned(units: DataFrame, centers: DataFrame) -> DataFrame:
    """``units`` with the nearest centre of their class and the squared distance to it; ``centers`` is a stored table."""
    if (held := _held(centers)) is not None:

        def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                cluster, gap = np.zeros(len(pdf), dtype="int32"), np.zeros(len(pdf))
                for _, at, _, own, low in _by_class(pdf, held):
                    cluster[at], gap[at] = own, low
                yield pdf.assign(cluster=cluster, gap=gap)

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema.fields)
        return units.mapInPandas(nearest, f"{kinds}, cluster int, gap double")
    joined = units.join(_of_class(centers), F.col("class") == F.col("_class"))
    gaps = F.transform("centers", lambda c: V.squared_distance(F.col("unit"), c))
    nearest_gap = F.array_min("gaps")
    return joined.withColumn("gaps", gaps).select(
        *units.columns, (F.array_position("gaps", nearest_gap) - 1).cast("int").alias("cluster"), nearest_gap.alias("gap")
    )


def _cluster_means(units: DataFrame, held: dict[int, np.ndarray]) -> DataFrame:
    """(class, cluster, mean, gap, unit): the mean of the rows nearest to each centre, and the farthest of them with its distance."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each centre that a task meets rows of."""
        found: dict[tuple, list] = {}
        for pdf in frames:
            for c, _, rows, own, low in _by_class(pdf, held):
                for k in np.unique(own).tolist():
                    inside = np.flatnonzero(own == k)
                    gap = low[inside].max()
                    far = (float(gap), max(rows[inside[low[inside] == gap]].tolist()))
                    n, total, old = found.get((c, k), (0, 0.0, far))
                    found[c, k] = [n + len(inside), total + rows[inside].sum(axis=0), max(old, far)]
        if found:
            yield pd.DataFrame(
                [(c, k, n, total, *far) for (c, k), (n, total, far) in found.items()],
                columns=["class", "cluster", "n", "total", "gap", "unit"],
            )

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        mean = np.stack(rows["total"].to_numpy()).sum(axis=0) / rows["n"].sum()
        gap, unit = max((g, u.tolist()) for g, u in zip(rows["gap"], rows["unit"], strict=True))
        return pd.DataFrame({"class": rows["class"].iloc[:1], "cluster": rows["cluster"].iloc[:1], "mean": [mean], "gap": [gap], "unit": [unit]})

    kept = "class long, cluster int"
    parts = units.select("class", "unit").mapInPandas(sums, f"{kept}, n long, total array<double>, gap double, unit array<double>")
    return parts.groupBy("class", "cluster").applyInPandas(added, f"{kept}, mean array<double>, gap double, unit array<double>")


def _settled(units: DataFrame, held: dict[int, np.ndarray], max_rounds: int) -> dict[int, np.ndarray]:
    """The centres after k-means steps; a step is one job that returns no more than the centres and a row for each."""
    for _ in range(max_rounds):
        now, far, full = {c: m.copy() for c, m in held.items()}, {}, {c: np.zeros(len(m), dtype=bool) for c, m in held.items()}
        for r in _cluster_means(units, held).collect():
            now[r["class"]][r["cluster"]], full[r["class"]][r["cluster"]] = r["mean"], True
            far[r["class"]] = max(far.get(r["class"], (0.0, [])), (r["gap"], r["unit"]))
        for c, has_rows in full.items():
            # of several empty clusters the first moves, the others in later steps
            if not has_rows.all() and c in far and far[c][0] > 0:
                now[c][int(np.argmin(has_rows))] = far[c][1]
        shift = max((((now[c] - m) ** 2).sum(axis=1).max() for c, m in held.items()), default=0.0)
        held = now
        if shift < 1e-20:
            break
    return held


def _reduce_seeds(k: int, seed: int):
    """k of the weighted candidates of a class, each drawn in proportion to its weight and squared distance."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_order=[tuple(c) for c in rows["centroid"]]).sort_values("_order")
        points = np.stack(rows["centroid"].to_numpy())
        weight = rows["weight"].to_numpy(dtype="float64")
        draw = np.random.default_rng(seed)
        chosen = [int(weight.argmax())]
        gap = ((points - points[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < min(k, len(points)):
            left = gap > 0
            if not left.any():
                break
            share = np.where(left, np.maximum(weight, 1e-9) * gap, 0.0)
            chosen.append(int(draw.choice(len(points), p=share / share.sum())))
            gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        kept = rows.iloc[chosen].drop(columns=["weight", "_order", "cluster"])
        return kept.assign(cluster=np.arange(len(chosen), dtype="int32"))

    return reduce


def _seeds(units: DataFrame, k: int, seed: int, rounds: int) -> DataFrame:
    """(class, cluster, centroid): oversampled rows of each class, reduced to k.

    The k rows with the smallest hash come first; each round adds rows in proportion to
    their squared distance, about 2 k for each class.
    """
    order = Window.partitionBy("class").orderBy("draw", "unit")
    first = units.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = durable(_numbered(first.select("class", F.col("unit").alias("centroid")).distinct()), "seeds")
    for turn in range(rounds):
        near = _assigned(units, found)
        total = durable(near.groupBy("class").agg(F.sum("gap").alias("cost")), "seed-costs")
        total = total.select(F.col("class").alias("_c"), "cost")
        chance = F.pmod(F.xxhash64("unit", F.lit(seed + turn + 1)), F.lit(1 << 30)) / float(1 << 30)
        drawn = near.join(total, F.col("class").eqNullSafe(F.col("_c"))).where(chance * F.col("cost") < 2.0 * k * F.col("gap"))
        more = drawn.select("class", F.col("unit").alias("centroid"))
        found = durable(_numbered(found.select("class", "centroid").union(more).distinct()), "seeds")
    counted = _assigned(units, found).groupBy(F.col("class").alias("_c"), F.col("cluster").alias("_k")).agg(F.count(F.lit(1)).alias("weight"))
    same = F.col("class").eqNullSafe(F.col("_c")) & (F.col("cluster") == F.col("_k"))
    weighted = found.join(counted, same, "left").select("class", "cluster", "centroid", F.coalesce("weight", F.lit(0)).alias("weight"))
    return weighted.groupBy("class").applyInPandas(_reduce_seeds(k, seed), _center_schema(units))


def _numbered(centers: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("class").orderBy("centroid")) - 1
    return centers.withColumn("cluster", number.cast("int"))


def _center_schema(units: DataFrame) -> str:
    return f"class {units.schema['class'].dataType.simpleString()}, centroid array<double>, cluster int"


def build_centroids(
    df: DataFrame, vector_col: str, class_col: str, k: int = 25, seed: int = 42, max_rounds: int = 50, seed_rounds: int = 2
) -> DataFrame:
    """(class, cluster, centroid): k-means on the normalised vectors of every class at once, k at most n.

    One step is one job for all classes: centres of up to ``CENTER_BYTES`` go to every task,
    more of them meet the rows of their class as one row of a table; means are partial
    aggregates by (class, cluster), so neither a class nor the number of classes is
    bounded by a task or the driver. A centre that loses all rows moves to the row of its class that is
    farthest from its own. Steps end when no centre moves.
    """
    units = df.select(F.col(class_col).alias("name"), V.unit(F.col(vector_col)).alias("unit")).dropna(subset=["unit"])
    # classes go by number, whatever their type and also where they are null
    names = small_side(units.select("name").distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    numbered = units.join(names.withColumnRenamed("name", "_name"), F.col("name").eqNullSafe(F.col("_name")))
    units = durable(numbered.select("class", "unit", F.xxhash64("unit", F.lit(seed)).alias("draw")), "unit-vectors")
    centers = durable(_seeds(units, k, seed, seed_rounds), "centers")
    held = _held(centers)
    if held is not None:
        settled = _settled(units, held, max_rounds)
        rows = [(c, m.tolist(), n) for c, centroids in settled.items() for n, m in enumerate(centroids)]
        centers, max_rounds = df.sparkSession.createDataFrame(rows, _center_schema(units)), 0
    for _ in range(max_rounds):
        near = _assigned(units, centers)
        means = near.groupBy("class", "cluster").agg(
            vector_to_array(Summarizer.mean(array_to_vector("unit"))).alias("mean"),
            F.max(F.struct("gap", "unit")).alias("far"),
        )
        far = F.max("far").over(Window.partitionBy("_c"))
        old = centers.select(F.col("class").alias("_c"), F.col("cluster").alias("_k"), F.col("centroid").alias("old"))
        same = F.col("_c").eqNullSafe(F.col("class")) & (F.col("_k") == F.col("cluster"))
        moved = old.join(means, same, "left").withColumn("far", far)
        # of several empty clusters the first moves, the others in later steps
        empty = F.col("mean").isNull()
        rank = F.row_number().over(Window.partitionBy("_c").orderBy(F.col("mean").isNotNull(), "_k"))
        moved = moved.withColumn("rank", rank)
        now = F.when(~empty, F.col("mean")).when((F.col("rank") == 1) & (F.col("far.gap") > 0), F.col("far.unit")).otherwise(F.col("old"))
        moved = moved.select(F.col("_c").alias("class"), now.alias("centroid"), F.col("_k").alias("cluster"), "old")
        moved = durable(moved, "centers")
        shift = moved.agg(F.max(V.squared_distance(F.col("centroid"), F.col("old"))).alias("m")).first()["m"]
        centers = moved.drop("old")
        if not shift or shift < 1e-20:
            break
    named = centers.withColumnRenamed("class", "_number").join(names, F.col("_number") == F.col("class"))
    return named.select(F.col("name").alias("class"), "cluster", "centroid")


def fit_hybrid(scores: DataFrame, target: Column, ae: str = "ae_re", max_prob: str = "max_prob") -> HybridWeights:
    """Balanced logistic regression on (ae_re, 1 - max_prob) with unit L2 penalty."""
    labelled = scores.select(
        array_to_vector(F.array(ref(ae).cast("double"), F.lit(1.0) - ref(max_prob))).alias("features"),
        target.cast("double").alias("label"),
    )
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        raise ValueError("hybrid meta-learner requires known validation and zero-day samples")
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1.0, F.lit(total / (2.0 * counts[1.0]))).otherwise(
        F.lit(total / (2.0 * counts[0.0]))
    )
    model = LogisticRegression(
        weightCol="weight", regParam=1.0 / total, standardization=False, maxIter=1000, tol=1e-8
    ).fit(labelled.withColumn("weight", weight))
    ae_weight, softmax_weight = model.coefficients
    return HybridWeights(float(ae_weight), float(softmax_weight), float(model.intercept))


def score_table(
    df: DataFrame,
    class_names: Sequence[str],
    decision: Decision,
    weights: HybridWeights | None,
    keep: Sequence[str],
    ae: str = "ae_re",
    probs: str = "probs",
) -> DataFrame:
    """The score contract: verdict, class, scores, flag and rule per row."""
    max_prob = F.array_max(probs)
    base = df.select(
        *[ref(k) for k in keep],
        scoring.top_class(F.col(probs), list(class_names)).alias("classifier_class"),
        max_prob.alias("max_prob"),
        (F.lit(1.0) - max_prob).alias("softmax"),
        ref(ae).alias("ae_re"),
        ref(ae).alias("ae_score"),
        scoring.hybrid_score(ref(ae), max_prob, weights).alias("hybrid"),
    )
    flag = decision.flag(F.col("ae_re"), F.col("max_prob"), F.col("hybrid"))
    return base.withColumns(
        {
            "hybrid_score": F.col("hybrid"),
            "is_zeroday": flag,
            "zero_day_rule": F.lit(decision.rule),
            "predicted_class": scoring.verdict(flag, F.col("classifier_class")),
        }
    )


def member_draws(train: DataFrame, id_col: str, member: int, seed: int = 42) -> DataFrame:
    """The rows of one bootstrap member with ``draws``, how often each was drawn: Poisson with mean 1."""
    drawn = train.withColumn("draws", poisson_draw(id_col, f"member-{seed}-{member}", F.lit(1.0)))
    return drawn.where("draws > 0")


def fit_ensemble(
    train: DataFrame, features: Sequence[str], class_col: str, class_names: Sequence[str], id_col: str, members: int = 5, max_iter: int = 30
) -> list[LogisticRegressionModel]:
    """Bagged classifiers: each sees every row as often as it was drawn, as a weight, so no row is copied."""
    index = F.array_position(F.lit(list(class_names)), ref(class_col)) - 1
    base = class_weights(train, class_col).select(
        ref(id_col).alias("_id"), feature_vector(features).alias("features"), index.cast("double").alias("label"), "weight"
    ).where("label >= 0")
    base = durable(base, "ensemble-rows")

    def fit(member: int) -> LogisticRegressionModel:
        rows = member_draws(base, "_id", member).withColumn("weight", F.col("weight") * F.col("draws"))
        return LogisticRegression(weightCol="weight", family="multinomial", maxIter=max_iter, regParam=1e-4).fit(rows)

    # a fit is many short jobs, one after the other; a few members at once, since each holds its rows
    with ThreadPool(FITS_AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(train.sparkSession)(fit), range(members))


def member_probabilities(df: DataFrame, members: Sequence[LogisticRegressionModel], features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, member, probs): one row for each row and member; the rows are read once for all members."""
    scored = df.select(*[ref(k) for k in keep], feature_vector(features).alias("features"))
    for k, model in enumerate(members):
        own = model.copy()
        own.setProbabilityCol(f"_p{k}").setRawPredictionCol(f"_r{k}").setPredictionCol(f"_y{k}")
        scored = own.transform(scored).drop(f"_r{k}", f"_y{k}")
    probs = F.array(*[F.struct(F.lit(k).alias("member"), vector_to_array(f"_p{k}").alias("probs")) for k in range(len(members))])
    return scored.select(*[ref(k) for k in keep], F.inline(probs))


def fit_perceptron(
    train: DataFrame,
    features: Sequence[str],
    class_col: str,
    class_names: Sequence[str],
    id_col: str,
    hidden: Sequence[int] = (16,),
    max_iter: int = 60,
    seed: int = 42,
) -> MultilayerPerceptronClassificationModel:
    """Non-linear known-class classifier. It takes no weights, so rare classes are resampled to an equal share.

    A row is repeated a Poisson number of times whose mean is the class's share of an
    even mix; in all about as many rows as before.
    """
    known = train.where(ref(class_col).isin(list(class_names)))
    sizes = small_side(known.groupBy(ref(class_col).alias("_class")).agg(F.count(F.lit(1)).alias("_n")), "class-sizes")
    total = sizes.agg(F.sum("_n"), F.count(F.lit(1))).first()
    index = F.array_position(F.lit(list(class_names)), ref(class_col)) - 1
    mean = F.lit(total[0] / max(total[1], 1)) / F.col("_n")
    rows = known.join(sizes, ref(class_col) == F.col("_class")).withColumn("_draws", poisson_draw(id_col, f"even-{seed}", mean))
    rows = rows.select(
        feature_vector(features).alias("features"), index.cast("double").alias("label"), F.explode(F.array_repeat(F.lit(1), F.col("_draws"))).alias("_copy")
    )
    layers = [len(features), *hidden, len(class_names)]
    rows = durable(rows.drop("_copy"), "perceptron-rows")
    return MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed, blockSize=256).fit(rows)


def ensemble_uncertainty(samples: DataFrame, id_cols: Sequence[str], probs: str = "probs", low_confidence: float = 1.5) -> DataFrame:
    """Mean and deviation per class over ensemble members, entropy, confidence flag.

    ``samples`` has one row per (row, member). Members per row are few; the
    per-class means are partial aggregates.
    """
    entries = samples.select(*id_cols, F.posexplode(probs).alias("class", "p"))
    per_class = entries.groupBy(*id_cols, "class").agg(
        F.avg("p").alias("mean"), F.coalesce(F.stddev_pop("p"), F.lit(0.0)).alias("std")
    )
    floor = F.greatest(F.col("mean"), F.lit(1e-12))
    return per_class.groupBy(*id_cols).agg(
        F.sum(-F.col("mean") * F.log(floor)).alias("entropy"),
        F.max_by("std", F.struct(F.col("mean"), -F.col("class"))).alias("std_max_class"),
    ).withColumn("low_confidence", F.col("entropy") > low_confidence)
