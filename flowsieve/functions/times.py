"""Time parsing without failing on bad text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text layouts accepted besides ISO 8601.
TEXT_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss")


def parse_event_time(c: Column) -> Column:
    """Timestamp from ISO text, the fixed layouts, or epoch seconds; else null."""
    value = F.trim(c.cast("string"))
    parsed = [F.try_to_timestamp(value)]
    parsed += [F.try_to_timestamp(value, F.lit(layout)) for layout in TEXT_LAYOUTS]
    return F.when(
        value.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.timestamp_seconds(value.try_cast("double"))
    ).otherwise(F.coalesce(*parsed))


def parse_wall_time(c: Column) -> Column:
    """Timestamp of the wall-clock text, dropping any zone suffix unconverted."""
    value = F.regexp_replace(F.trim(c.cast("string")), r"(Z|[+-]\d{2}:?\d{2})$", "")
    parsed = [F.try_to_timestamp(value)]
    parsed += [F.try_to_timestamp(value, F.lit(layout)) for layout in TEXT_LAYOUTS]
    return F.coalesce(*parsed)


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_naive(ts: Column) -> Column:
    """ISO text with microseconds only when they are not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    return F.when(micros == 0, whole).otherwise(
        F.concat(whole, F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
