"""Points in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(text: Column) -> Column:
    """A point in time written with or without an offset, as Spark's timestamp; without one it means UTC, whatever the
    session's zone. Null where it can't be read."""
    has_zone = text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$")
    return F.when(has_zone, F.try_to_timestamp(text)).otherwise(F.try_to_timestamp(F.concat(text, F.lit("+00:00"))))


def utc_text(moment: Column) -> Column:
    """A timestamp as text in UTC with microseconds."""
    return F.concat(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
