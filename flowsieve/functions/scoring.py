"""Anomaly scores, the zero-day decision, verdict and risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import lookup

VERDICTS = ("Normal", "Known-Attack", "Zero-Day Candidate")
# Severity weights of the risk score and severity order.
SEVERITY_WEIGHT = {"CRITICAL": 35, "HIGH": 25, "MEDIUM": 15, "LOW": 5}
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}


@dataclass(frozen=True)
class HybridWeights:
    """Logistic weights over (reconstruction error, 1 - top probability)."""

    ae_re: float
    softmax: float
    intercept: float = 0.0


@dataclass(frozen=True)
class Decision:
    """Thresholds of the zero-day decision; an absent threshold does not vote."""

    hybrid: float | None = None
    ae_re: float | None = None
    softmax: float | None = None
    mode: str = ""
    min_votes: int = 2
    fallback_ae: float = 0.5
    fallback_confidence: float = 0.6

    def __post_init__(self) -> None:
        if self.mode == "vote" and self.min_votes <= 0:
            raise ValueError("vote threshold min_votes must be positive")

    def votes(self, ae: Column, max_prob: Column, hybrid: Column) -> list[Column]:
        signals = [
            (hybrid, self.hybrid),
            (ae, self.ae_re),
            (F.lit(1.0) - max_prob, self.softmax),
        ]
        return [score > F.lit(float(limit)) for score, limit in signals if limit is not None]

    def flag(self, ae: Column, max_prob: Column, hybrid: Column) -> Column:
        votes = self.votes(ae, max_prob, hybrid) if self.mode == "vote" else []
        if votes:
            total = sum((v.cast("int") for v in votes[1:]), votes[0].cast("int"))
            return total >= F.lit(self.min_votes)
        if self.hybrid is not None:
            return hybrid > F.lit(float(self.hybrid))
        return (ae > F.lit(self.fallback_ae)) & (max_prob < F.lit(self.fallback_confidence))

    @property
    def rule(self) -> str:
        voters = [v for v in (self.hybrid, self.ae_re, self.softmax) if v is not None]
        if self.mode == "vote" and voters:
            return f"vote_{self.min_votes}_of_{len(voters)}"
        return "hybrid_calibrated" if self.hybrid is not None else "ae_plus_confidence_fallback"


def sigmoid(z: Column) -> Column:
    bounded = F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-bounded))


def hybrid_score(ae: Column, max_prob: Column, weights: HybridWeights | None = None) -> Column:
    softmax = F.lit(1.0) - max_prob
    if weights is None:
        return F.lit(0.5) * ae + F.lit(0.5) * softmax
    return sigmoid(
        F.lit(weights.intercept) + F.lit(weights.ae_re) * ae + F.lit(weights.softmax) * softmax
    )


def verdict(is_zeroday: Column, classifier_class: Column) -> Column:
    return (
        F.when(F.coalesce(is_zeroday, F.lit(False)), F.lit("Zero-Day Candidate"))
        .when(F.lower(F.trim(classifier_class.cast("string"))) == "normal", F.lit("Normal"))
        .otherwise(F.lit("Known-Attack"))
    )


def risk_score(hybrid: Column, ae: Column, is_zeroday: Column, severity: Column) -> Column:
    """0-100; rounds half to even. Missing inputs count as zero."""
    weight = lookup(F.upper(severity), SEVERITY_WEIGHT, 10)
    hybrid = F.coalesce(hybrid, F.lit(0.0))
    ae = F.coalesce(ae, F.lit(0.0))
    raw = (
        weight
        + hybrid * F.lit(45.0)
        + F.least(ae, F.lit(1.0)) * F.lit(15.0)
        + F.when(F.coalesce(is_zeroday, F.lit(False)), F.lit(15.0)).otherwise(F.lit(0.0))
    )
    return F.least(F.lit(100.0), F.bround(raw)).cast("int")


def severity_rank(severity: Column) -> Column:
    return lookup(F.upper(severity), SEVERITY_RANK, 0)


def severity_of(rank: Column) -> Column:
    """The name of a severity rank, null for rank 0."""
    return lookup(rank, {r: name for name, r in SEVERITY_RANK.items()}, None)


def risk_severity(risk: Column) -> Column:
    return (
        F.when(risk >= 85, F.lit("CRITICAL"))
        .when(risk >= 70, F.lit("HIGH"))
        .when(risk >= 40, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def top_class(probs: Column, class_names: list[str]) -> Column:
    """Name of the most probable class, Unknown beyond the list of names."""
    position = F.array_position(probs, F.array_max(probs))
    names = F.array(*[F.lit(name) for name in class_names])
    return F.coalesce(F.try_element_at(names, position.cast("int")), F.lit("Unknown"))


def softmax_score(probs: Column) -> Column:
    return F.lit(1.0) - F.array_max(probs)


def energy_score(logits: Column, temperature: float = 1.0) -> Column:
    """-T * logsumexp(z / T), stabilised by the largest logit."""
    t = min(max(float(temperature), 0.5), 5.0)
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp((z - top) / F.lit(t)))
    return -(top + F.lit(t) * F.log(total))


def entropy(probs: Column) -> Column:
    floor = F.lit(1e-12)
    return F.aggregate(
        probs, F.lit(0.0), lambda acc, p: acc - p * F.log(F.greatest(p, floor))
    )


def ensemble_share(flags: list[Column]) -> Column:
    """Share of detectors over their threshold."""
    total = sum((f.cast("double") for f in flags[1:]), flags[0].cast("double"))
    return total / F.lit(float(len(flags)))
