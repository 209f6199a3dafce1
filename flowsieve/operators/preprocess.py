"""Raw log to aligned feature rows, with a replaceable normaliser."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions import flow as flow_fn
from flowsieve.functions.core import lookup, ref
from flowsieve.operators.normalize import HeaderPlan, normalize_flows
from flowsieve.operators.prepare import align_features

Normalizer = Callable[[DataFrame], tuple[DataFrame, Any]]


def flow_normalizer(expected: Sequence[str] | None = None, **options: Any) -> Normalizer:
    """The built-in normaliser as a pluggable step."""
    return lambda raw: normalize_flows(raw, expected=list(expected) if expected else None, **options)


def preprocess(
    raw: DataFrame,
    features: Sequence[str],
    codes: Mapping[str, Mapping[str, int]] | None = None,
    normalizer: Normalizer | None = None,
    keep: Sequence[str] = (),
    extended: bool = False,
) -> tuple[DataFrame, dict[str, Any] | None]:
    """(aligned features, report). A normaliser that fails becomes a report, not an error.

    Category codes must be the saved ones: codes fitted per batch would mean
    something else in every batch.
    """
    df, report = raw, None
    if normalizer is not None:
        try:
            df, plan = normalizer(raw)
            report = plan_report(plan) if isinstance(plan, HeaderPlan) else dict(plan)
        except Exception as error:  # noqa: BLE001 - any failure of foreign code is reported
            report = {"schema": "normalization_failed", "error": str(error)}
    needed = [c for c in ("proto", "service", "state") if f"{c}_num" in features and c in df.columns]
    missing = [c for c in needed if not (codes or {}).get(c)]
    if missing:
        raise ValueError("saved category codes are required for: " + ", ".join(missing))
    encoded = {}
    for c in needed:
        table = codes[c]
        encoded[f"{c}_num"] = lookup(ref(c), {k: float(v) for k, v in table.items()}, float(table.get("unk", -1)))
    df = df.withColumns(encoded) if encoded else df
    made = {k: v for k, v in flow_fn.engineered(df.columns, extended).items() if k in features}
    df = df.withColumns(made) if made else df
    return align_features(df, features, keep), report


def plan_report(plan: HeaderPlan) -> dict[str, Any]:
    """The header plan as the fields of a normalisation report."""
    return {
        "schema": plan.schema,
        "input_columns": plan.input_columns,
        "output_columns": len(plan.output),
        "mapped_columns": dict(plan.mapped),
        "derived_columns": sorted(plan.derived),
        "missing_core_features": list(plan.missing),
        "feature_coverage": plan.coverage,
    }


def scored_with_labels(scores: DataFrame, labels: DataFrame, on: str = "source_row") -> DataFrame:
    """Score rows next to their label by row id, for tables that lost the label on the way."""
    return scores.join(labels.select(F.col(on), *[c for c in labels.columns if c != on]), on)
