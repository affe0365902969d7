"""Seconds <-> display strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from groundspan.functions import fixed_values as fv
from groundspan.functions.text import strip_ws


def _whole_seconds(seconds: Column) -> Column:
    return F.floor(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))).cast("bigint")


def _parts(seconds: Column) -> tuple[Column, Column, Column]:
    total = _whole_seconds(seconds)
    hours = F.floor(total / 3600).cast("bigint")
    minutes = F.floor((total % 3600) / 60).cast("bigint")
    return hours, minutes, total % 60


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def format_ts(seconds: Column) -> Column:
    """``M:SS``, or ``H:MM:SS`` past an hour; truncates, clamps below zero."""
    h, m, s = _parts(seconds)
    return F.when(
        h > 0, F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(s))
    ).otherwise(F.concat(m.cast("string"), F.lit(":"), _two(s)))


def format_range(start: Column, end: Column) -> Column:
    return F.concat(format_ts(start), F.lit(fv.EN_DASH), format_ts(end))


def format_duration(seconds: Column) -> Column:
    """``1h 04m``, ``42m 18s`` or ``5s``."""
    h, m, s = _parts(seconds)
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), _two(m), F.lit("m")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), _two(s), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def parse_ts(value: Column) -> Column:
    """Seconds of an ``M:SS`` / ``H:MM:SS`` string; NULL when it is not one."""
    text = strip_ws(value)

    def group(i: int) -> Column:
        return F.regexp_extract(text, fv.TIMESTAMP_PATTERN, i)

    def number(i: int) -> Column:
        return F.coalesce(group(i).try_cast("double"), F.lit(0.0))

    fraction = F.coalesce(F.concat(F.lit("0."), group(4)).try_cast("double"), F.lit(0.0))
    return F.when(
        text.rlike(fv.TIMESTAMP_PATTERN),
        number(1) * 3600 + number(2) * 60 + number(3) + fraction,
    )
