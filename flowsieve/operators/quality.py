"""Checks on tables and on the normalisation itself, findings as rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.core import ref


@dataclass(frozen=True)
class InputPolicy:
    """Optional limits on an input table (fixed default values)."""

    max_bytes: int = 200 * 1024 * 1024
    max_rows: int = 1_000_000
    max_columns: int = 250
    min_columns: int = 3
    large_rows: int = 50_000


def input_guard(
    df: DataFrame,
    header: Sequence[str] | None = None,
    size_bytes: int | None = None,
    policy: InputPolicy | None = None,
) -> DataFrame:
    """(severity, finding) rows. ``header`` is the raw header: readers rename repeats."""
    policy = policy or InputPolicy()
    names = [str(c) for c in (df.columns if header is None else header)]
    width = len(names)
    known: list[tuple[bool, str, str]] = []
    if size_bytes is not None:
        known.append((
            size_bytes > policy.max_bytes, "error",
            f"CSV file is too large: {size_bytes} bytes > {policy.max_bytes} bytes",
        ))
    known.append((width < policy.min_columns, "error", f"CSV has too few columns: {width} < {policy.min_columns}"))
    known.append((width > policy.max_columns, "error", f"CSV has too many columns: {width} > {policy.max_columns}"))
    repeated = sorted(n for n, k in Counter(names).items() if k > 1)
    known.append((bool(repeated), "error", "CSV contains duplicate column names: " + ", ".join(repeated)))
    unnamed = [n for n in names if not n.strip() or n.lower().startswith("unnamed:")]
    known.append((bool(unnamed), "warning", "CSV contains unnamed/index-like columns: " + ", ".join(unnamed)))

    rows = F.col("rows")
    checks = [F.when(F.lit(hit), _finding(severity, F.lit(message))) for hit, severity, message in known]
    checks += [
        F.when(rows <= 0, _finding("error", F.lit("CSV has no rows"))),
        F.when(
            rows > policy.max_rows,
            _finding("error", F.concat(
                F.lit("CSV has too many rows for dashboard batch inference: "), rows.cast("string"),
                F.lit(f" > {policy.max_rows}"),
            )),
        ),
        F.when(
            rows > policy.large_rows,
            _finding("warning", F.lit("Large CSV upload; dashboard analysis may take time on CPU.")),
        ),
    ]
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.explode(F.filter(F.array(*checks), lambda f: f.isNotNull())).alias("f")
    ).select("f.*")


def _finding(severity: str, message: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), message.alias("finding"))


def feature_contract(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(feature, status, finite_share): missing, duplicated or non-finite features.

    One pass over the table measures every present feature.
    """
    cleaned = [str(e).strip() for e in expected]
    repeated = {n for n, k in Counter(cleaned).items() if k > 1}
    names = list(dict.fromkeys(cleaned))
    present = [n for n in names if n in df.columns]
    shares = df.agg(*[F.avg(_is_finite(ref(n)).cast("double")).alias(n) for n in present])
    measured = shares.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("feature"),
                        (F.col(f"`{n}`") if n in present else F.lit(None).cast("double")).alias("finite_share"),
                        F.lit(_name_status(n, repeated, present)).alias("named"),
                    )
                    for n in names
                ]
            )
        ).alias("f")
    ).select("f.*")
    status = F.when(F.col("named") != "ok", F.col("named")).when(
        F.coalesce(F.col("finite_share"), F.lit(1.0)) < 1.0, F.lit("non_finite")
    ).otherwise(F.lit("ok"))
    return measured.select("feature", status.alias("status"), "finite_share")


def _name_status(name: str, repeated: set[str], present: list[str]) -> str:
    if not name:
        return "empty_name"
    if name in repeated:
        return "duplicate"
    return "ok" if name in present else "missing"


def _is_finite(c: Column) -> Column:
    value = c.cast("double")
    return F.coalesce(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), F.lit(False))


# Which missing features get a warning of their own.
DIRECTIONAL = ("dbytes", "dpkts", "sbytes", "spkts")
TIMING = ("ackdat", "dintpkt", "dur", "sintpkt", "synack", "tcprtt")


def normalization_quality(report: DataFrame) -> DataFrame:
    """Quality level, message and warnings per row of a normalisation report."""
    coverage, missing = F.col("feature_coverage"), F.col("missing_core_features")
    mapped = F.size(F.map_keys("mapped_columns"))
    directional = F.array_intersect(F.lit(list(DIRECTIONAL)), missing)
    timing = F.array_intersect(F.lit(list(TIMING)), missing)
    level = (
        F.when(coverage.isNull(), F.lit("UNKNOWN"))
        .when(coverage >= 0.80, F.lit("GOOD"))
        .when(coverage >= 0.60, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
    raised = F.array(
        F.when(coverage.isNull(), F.lit("Feature coverage is unavailable.")),
        F.when(level == "MEDIUM", F.lit("Feature coverage is moderate; treat scores as triage signals.")),
        F.when(level == "LOW", F.lit("Feature coverage is low; inference confidence is reduced.")),
        F.when(F.size(directional) > 0, F.concat(F.lit("Missing directional counters: "), F.array_join(directional, ", "))),
        F.when(F.size(timing) > 0, F.concat(F.lit("Missing timing/TCP fields: "), F.array_join(timing, ", "))),
        F.when(mapped < 5, F.lit("Few source columns were mapped; verify CSV schema manually.")),
    )
    raised = F.filter(raised, lambda w: w.isNotNull())
    fine = F.array(F.lit("CSV schema has enough core fields for prototype inference."))
    shown = F.when(coverage.isNull(), F.lit("unknown")).otherwise(
        F.concat(F.format_string("%.1f", coverage * 100.0), F.lit("%"))
    )
    return report.select(
        *report.columns,
        level.alias("level"),
        F.concat(
            F.lit("Normalization quality: "), level, F.lit(" (coverage "), shown,
            F.lit(", mapped columns "), mapped.cast("string"), F.lit(")."),
        ).alias("message"),
        F.when(F.size(raised) > 0, raised).otherwise(fine).alias("warnings"),
    )


# Label and family column candidates, first present wins.
LABEL_COLUMNS = ("label", "label_binary", "attack_cat", "attack_category", "class", "category")
FAMILY_COLUMNS = ("true_label", "attack_cat", "zero_day_family", "label")


def choose_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate in the header, ignoring case and blanks."""
    lowered = {c.strip().lower(): c for c in columns}
    return next((lowered[c] for c in candidates if c in lowered), None)
