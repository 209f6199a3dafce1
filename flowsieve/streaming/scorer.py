"""A fitted scorer whose whole state is literals: batch and stream share it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions import flow as flow_fn
from flowsieve.functions import scoring
from flowsieve.functions import vectors as V
from flowsieve.functions.core import finite, lookup, ref
from flowsieve.functions.scoring import Decision, HybridWeights


@dataclass
class LinearScorer:
    """Linear class head, linear reconstruction, hybrid weights and decision."""

    features: Sequence[str]
    classes: Sequence[str]
    weights: Sequence[Sequence[float]]
    intercepts: Sequence[float]
    directions: Sequence[Sequence[float]]
    centers: Sequence[float]
    scaler: Mapping[str, tuple[float, float]]
    decision: Decision
    hybrid: HybridWeights | None = None
    codes: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    clip: float = 10.0
    extended: bool = False

    def encode(self, df: DataFrame) -> DataFrame:
        """Category codes as lookups; unseen values get the code of ``unk``, else -1."""
        out = {}
        for column, codes in self.codes.items():
            if column in df.columns:
                unseen = float(codes.get("unk", -1))
                out[f"{column}_num"] = lookup(ref(column), {k: float(v) for k, v in codes.items()}, unseen)
        return df.withColumns(out) if out else df

    def scaled(self, df: DataFrame) -> list[Column]:
        values = []
        for name in self.features:
            center, scale = self.scaler.get(name, (0.0, 1.0))
            raw = finite(ref(name)) if name in df.columns else F.lit(0.0)
            x = (raw - F.lit(float(center))) / F.lit(float(scale))
            values.append(F.greatest(F.least(x, F.lit(self.clip)), F.lit(-self.clip)))
        return values

    def score(self, flows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Normalised flows to the score contract, without leaving the JVM."""
        df = self.encode(flows)
        df = df.withColumns(flow_fn.engineered(df.columns, self.extended))
        df = df.select(*[ref(k) for k in keep], F.array(*self.scaled(df)).alias("x"))
        logits = F.array(
            *[V.dot(F.col("x"), V.literal(w)) + F.lit(float(b)) for w, b in zip(self.weights, self.intercepts, strict=True)]
        )
        df = df.withColumn("logits", logits).withColumn("_top", F.array_max("logits"))
        df = df.withColumn("_e", F.transform("logits", lambda z: F.exp(z - F.col("_top"))))
        total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
        df = df.withColumn("probs", F.transform("_e", lambda v: v / total)).drop("_top", "_e")
        df = df.withColumn("ae_re", self.reconstruction_error())
        max_prob = F.array_max("probs")
        df = df.withColumns(
            {
                "max_prob": max_prob,
                "softmax": F.lit(1.0) - max_prob,
                "classifier_class": scoring.top_class(F.col("probs"), list(self.classes)),
                "hybrid": scoring.hybrid_score(F.col("ae_re"), max_prob, self.hybrid),
            }
        )
        flag = self.decision.flag(F.col("ae_re"), F.col("max_prob"), F.col("hybrid"))
        return df.withColumns(
            {
                "ae_score": F.col("ae_re"),
                "hybrid_score": F.col("hybrid"),
                "is_zeroday": flag,
                "zero_day_rule": F.lit(self.decision.rule),
                "predicted_class": scoring.verdict(flag, F.col("classifier_class")),
            }
        )

    def reconstruction_error(self) -> Column:
        """Mean squared distance of x to its projection on the kept directions."""
        centered = F.zip_with("x", V.literal(self.centers), lambda x, m: x - m)
        total = F.aggregate(centered, F.lit(0.0), lambda a, v: a + v * v)
        for direction in self.directions:
            along = V.dot(centered, V.literal(direction))
            total = total - along * along
        return F.greatest(total, F.lit(0.0)) / F.lit(float(len(self.features)))
