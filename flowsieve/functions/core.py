"""Small Column helpers shared by the scalar functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "no value" in analyst-facing text fields (fixed values).
BLANK_TOKENS = ("", "nan", "none", "null", "-", "unknown")


def ref(name: str) -> Column:
    """Column by exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(c: Column, default: float = 0.0) -> Column:
    """Parse as double; unparsable, missing and NaN become ``default``."""
    value = c.try_cast("double")
    return F.coalesce(F.nanvl(value, F.lit(default)), F.lit(default))


def finite(c: Column, default: float = 0.0) -> Column:
    """Replace NaN, infinities and null by ``default``."""
    value = c.cast("double")
    return F.when(
        value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(default)
    ).otherwise(value)


def missing_if_infinite(c: Column) -> Column:
    """NaN and the infinities become null, so aggregates skip them."""
    value = c.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def text(c: Column, blank: str = "unknown") -> Column:
    """Trimmed text; missing or blank becomes ``blank``."""
    trimmed = F.trim(c.cast("string"))
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit(blank))


def meaningful(c: Column) -> Column:
    """Trimmed text, or null when it is one of the no-value spellings."""
    trimmed = F.trim(c.cast("string"))
    return F.when(~F.lower(trimmed).isin(*BLANK_TOKENS), trimmed)


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    """CASE over a small fixed vocabulary; null keys fall to the default."""
    expr = None
    for value, result in table.items():
        condition = key == F.lit(value)
        expr = F.when(condition, F.lit(result)) if expr is None else expr.when(condition, F.lit(result))
    fallback = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(fallback)
