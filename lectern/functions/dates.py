"""Date and time expressions with one fixed semantics for both dialects."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_date(value: str | dt.date) -> Column:
    return F.lit(str(value)).cast("date")


def as_timestamp(value: str | dt.date | dt.datetime) -> Column:
    """A session-time-zone independent timestamp literal."""
    return F.lit(str(value)).cast("timestamp_ntz")


def whole_months(end: Column, start: Column) -> Column:
    """Complete months from ``start`` to ``end``, truncated toward zero."""
    return F.months_between(end, start).cast("int")


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour days from ``start`` to ``end``."""
    return F.timestamp_diff("DAY", start, end)


def month_start(c: Column) -> Column:
    return F.trunc(c, "month")


def _typed_bound(df: DataFrame, col: str, day: dt.date) -> Column:
    kind = df.schema[col].dataType
    if isinstance(kind, T.DateType):
        return as_date(day)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.lit(str(day)).cast(kind)
    return as_date(day)


def to_day(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value)[:10])


def on_or_after(df: DataFrame, col: str, lo: str | dt.date) -> Column:
    """``col`` falls on calendar day ``lo`` or later (pushes down as ``>=``)."""
    return F.col(col) >= _typed_bound(df, col, to_day(lo))


def day_range(df: DataFrame, col: str, lo: str | dt.date, hi: str | dt.date) -> Column:
    """``col`` falls on a calendar day in ``lo`` .. ``hi`` (both inclusive).

    Written as a half-open range on the raw column so the parquet scan gets
    ``>=`` and ``<`` pushed filters, instead of formatting every value.
    """
    end = to_day(hi) + dt.timedelta(days=1)
    return (F.col(col) >= _typed_bound(df, col, to_day(lo))) & (F.col(col) < _typed_bound(df, col, end))
