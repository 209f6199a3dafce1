"""Fitted state as tables: scaler, class list, features, category maps, weights; a registry of versions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel
from pyspark.ml.feature import PCAModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.scoring import Decision, HybridWeights
from flowsieve.streaming.scorer import LinearScorer

SCHEMAS = {
    "features": "position int, name string, center double, scale double",
    "classes": "position int, name string, intercept double",
    "weights": "class int, feature int, weight double",
    "directions": "code int, feature int, weight double",
    "centers": "feature int, center double",
    "codes": "`column` string, value string, code int",
    "decision": "name string, value double, text string",
}


def save_scorer(spark: SparkSession, scorer: LinearScorer, path: str) -> None:
    """One small parquet table per kind of state."""
    rows = {
        "features": [(i, f, *map(float, scorer.scaler[f])) for i, f in enumerate(scorer.features)],
        "classes": [(i, c, float(b)) for i, (c, b) in enumerate(zip(scorer.classes, scorer.intercepts, strict=True))],
        "weights": [(i, j, float(w)) for i, row in enumerate(scorer.weights) for j, w in enumerate(row)],
        "directions": [(i, j, float(w)) for i, row in enumerate(scorer.directions) for j, w in enumerate(row)],
        "centers": [(j, float(c)) for j, c in enumerate(scorer.centers)],
        "codes": [(c, v, int(k)) for c, codes in scorer.codes.items() for v, k in codes.items()],
        "decision": _decision_rows(scorer),
    }
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows[name], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def _decision_rows(scorer: LinearScorer) -> list[tuple]:
    d, h = scorer.decision, scorer.hybrid
    named = {
        "hybrid": d.hybrid, "ae_re": d.ae_re, "softmax": d.softmax, "min_votes": d.min_votes,
        "fallback_ae": d.fallback_ae, "fallback_confidence": d.fallback_confidence,
        "hybrid_ae_re": h.ae_re if h else None, "hybrid_softmax": h.softmax if h else None,
        "hybrid_intercept": h.intercept if h else None,
    }
    rows = [(k, float(v), None) for k, v in named.items() if v is not None]
    return [*rows, ("mode", None, d.mode)]


def load_scorer(spark: SparkSession, path: str) -> LinearScorer:
    """Read a scorer back; every table holds fitted numbers, not rows of data."""
    t = {name: spark.read.schema(s).parquet(f"{path}/{name}") for name, s in SCHEMAS.items()}
    features = t["features"].orderBy("position").collect()
    classes = t["classes"].orderBy("position").collect()

    def matrix(name: str, row: str) -> list[list[float]]:
        grouped = t[name].groupBy(row).agg(F.array_sort(F.collect_list(F.struct("feature", "weight"))).alias("w"))
        return [[x["weight"] for x in r["w"]] for r in grouped.orderBy(row).collect()]

    codes: dict[str, dict[str, int]] = {}
    for r in t["codes"].collect():
        codes.setdefault(r["column"], {})[r["value"]] = r["code"]
    numbers = {r["name"]: r["value"] for r in t["decision"].collect() if r["name"] != "mode"}
    mode = t["decision"].where("name = 'mode'").first()["text"]
    hybrid = None
    if "hybrid_ae_re" in numbers:
        hybrid = HybridWeights(numbers["hybrid_ae_re"], numbers["hybrid_softmax"], numbers["hybrid_intercept"])
    return LinearScorer(
        features=[r["name"] for r in features],
        scaler={r["name"]: (r["center"], r["scale"]) for r in features},
        classes=[r["name"] for r in classes],
        intercepts=[r["intercept"] for r in classes],
        weights=matrix("weights", "class"),
        directions=matrix("directions", "code"),
        centers=[r["center"] for r in t["centers"].orderBy("feature").collect()],
        codes=codes,
        hybrid=hybrid,
        decision=Decision(
            hybrid=numbers.get("hybrid"), ae_re=numbers.get("ae_re"), softmax=numbers.get("softmax"), mode=mode or "",
            min_votes=int(numbers.get("min_votes", 2)), fallback_ae=numbers.get("fallback_ae", 0.5),
            fallback_confidence=numbers.get("fallback_confidence", 0.6),
        ),
    )


REGISTRY = "kind string, version int, format string, created_at timestamp"
TABLE = "table"
MODELS = {m.__name__: m for m in (LogisticRegressionModel, MultilayerPerceptronClassificationModel, PCAModel)}


def state_versions(spark: SparkSession, path: str) -> DataFrame:
    """(kind, version, format, created_at) of everything a registry holds; one row for each saved state."""
    try:
        return spark.read.schema(REGISTRY).parquet(f"{path}/registry")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REGISTRY)


def _latest(spark: SparkSession, path: str, kind: str, version: int | None = None):
    rows = state_versions(spark, path).where(F.col("kind") == kind)
    if version is not None:
        rows = rows.where(F.col("version") == version)
    return rows.orderBy(F.desc("version")).first()


def save_state(spark: SparkSession, path: str, kind: str, state, created_at: Column | None = None) -> int:
    """Save a table (centroids, a forest, ...) or a fitted model as the next version of its kind.

    The state is written first and listed after, so a reader never meets half of it; a
    version is never rewritten. Returns the version.
    """
    last = _latest(spark, path, kind)
    version = 1 + (last["version"] if last else 0)
    place = f"{path}/{kind}/v{version}"
    if isinstance(state, DataFrame):
        form = TABLE
        state.write.mode("overwrite").parquet(place)
    else:
        form = type(state).__name__
        if form not in MODELS:
            raise ValueError(f"no such kind of model: {form}")
        state.write().overwrite().save(place)
    row = spark.range(1).select(
        F.lit(kind).alias("kind"), F.lit(version).alias("version"), F.lit(form).alias("format"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{path}/registry")
    return version


def load_state(spark: SparkSession, path: str, kind: str, version: int | None = None):
    """The table or model of a version, the newest unless named."""
    row = _latest(spark, path, kind, version)
    if row is None:
        raise KeyError(f"no saved state: {kind}" + ("" if version is None else f" version {version}"))
    place = f"{path}/{kind}/v{row['version']}"
    return spark.read.parquet(place) if row["format"] == TABLE else MODELS[row["format"]].load(place)
