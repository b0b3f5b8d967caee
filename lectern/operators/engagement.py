"""G1-G7 (cohort, tenure, anchor, fact restriction) and G13-G16, G19, G20
(flags derived from window columns; no shuffle, one ``select``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (ACTIVE_MONTH_MIN_WEEKS, ACTIVE_WEEK_MIN_BOOKS, ACTIVE_WEEK_MIN_MINUTES,
                      ENGAGEMENT_EVENTS, OPEN_END_DATE, POWER_MONTH_MIN_WEEKS,
                      POWER_WEEK_MIN_MINUTES, THREE_PLUS_MIN_BOOKS)
from ..functions.dates import as_date, as_timestamp, month_start, on_or_after, whole_months


def engagement_base(users: DataFrame, countries: DataFrame, since, country_in: Sequence[str]) -> DataFrame:
    """G1: converted-subscribed users registered since ``since`` in the
    given countries (matched case-insensitively)."""
    u = users.filter(on_or_after(users, "registration_date", since) & F.col("is_converted_subscribed"))
    c = countries.filter(F.lower("country").isin(*[x.lower() for x in country_in]))
    joined = u.join(c, "country_id")
    return joined.select(
        month_start(F.col("registration_date")).alias("registration_month"),
        F.when(F.col("payment_model") == "direct", "d2c").otherwise("b2b").alias("user_type"),
        "user_id", "registration_date", "user_persona", "referrer_book_id",
        "country", "continent", "market", "region")


def kpi_base(users: DataFrame, since) -> DataFrame:
    """Converted-paid users registered since ``since``."""
    return (users.filter(on_or_after(users, "registration_date", since) & F.col("is_converted_paid"))
            .select(month_start(F.col("registration_date")).alias("registration_month"),
                    "registration_date", "user_id"))


def tenure(subs: DataFrame, base: DataFrame, as_of, months_col: str = "tenure_months_todate",
           user_col: str = "user_id") -> DataFrame:
    """Per user of ``base``: first start, last end, and the sum of whole
    months per 'subscribed' subscription (open end counts to ``as_of``; a
    missing start counts 0)."""
    start, end = F.col("subscription_start_time"), F.col("subscription_end_time")
    open_end = F.to_date(end) == as_date(OPEN_END_DATE)
    months = F.when(start.isNull(), F.lit(0)).otherwise(
        whole_months(F.when(open_end, as_timestamp(as_of)).otherwise(end), start)).cast("int")
    return (subs.filter(F.col("subscription_type") == "subscribed")
            .join(base.select(user_col), user_col, "left_semi")
            .groupBy(user_col)
            .agg(F.min(start).alias("subscription_start_time"),
                 F.max(end).alias("subscription_end_time"),
                 F.sum(months).alias(months_col)))


def anchor(base: DataFrame, ten: DataFrame, user_col: str = "user_id") -> DataFrame:
    """The day windows start at the first subscription, else at
    registration; ``start_time_status`` says which."""
    start = F.col("subscription_start_time")
    return (base.join(ten, user_col, "left")
            .select(*base.columns, *[c for c in ten.columns if c != user_col],
                    F.coalesce(start, F.col("registration_date")).alias("reg_sub_start_time"),
                    F.when(start.isNotNull(), "sub").otherwise("reg").alias("start_time_status")))


def tenure_expected(anchored: DataFrame, as_of) -> DataFrame:
    """Whole months from the anchor to ``as_of``."""
    return anchored.withColumn("tenure_months_expected",
                               whole_months(as_timestamp(as_of), F.col("reg_sub_start_time")))


def restrict(facts: DataFrame, base: DataFrame | None, date_col: str, since,
             names: Sequence[str] | None = None, name_col: str = "event_name",
             user_col: str = "user_id") -> DataFrame:
    """Facts since ``since`` (optionally of the given names) for the
    users of ``base`` (a left-semi join: each fact row kept at most once).

    ``base=None`` keeps only the date / name filter, for callers whose next
    step is an inner join with the same users anyway (the report windows).
    """
    cond = on_or_after(facts, date_col, since)
    if names is not None:
        cond = cond & F.col(name_col).isin(*names)
    out = facts.filter(cond)
    return out if base is None else out.join(base.select(user_col), user_col, "left_semi")


def restrict_events(events: DataFrame, base: DataFrame | None, since, names: Sequence[str] = ENGAGEMENT_EVENTS,
                    date_col: str = "event_date") -> DataFrame:
    return restrict(events, base, date_col, since, names)


# -- flags over window columns -------------------------------------------------
# Generated as SQL expression text (one JVM call per output column).

def _active(k: int, min_books: float = ACTIVE_WEEK_MIN_BOOKS, min_minutes: float = ACTIVE_WEEK_MIN_MINUTES) -> str:
    return f"(book_read_w{k} >= {min_books} AND reading_mins_w{k} >= {min_minutes})"


def _one(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def _flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN true ELSE false END"


def active_week_columns(weeks: int, min_books: float = ACTIVE_WEEK_MIN_BOOKS,
                        min_minutes: float = ACTIVE_WEEK_MIN_MINUTES) -> list[Column]:
    """1/0 and true/false per week: at least one book and 5 minutes."""
    cols = []
    for k in range(1, weeks + 1):
        cond = _active(k, min_books, min_minutes)
        cols += [F.expr(f"{_one(cond)} AS active_w{k}"), F.expr(f"{_flag(cond)} AS active_flag_w{k}")]
    return cols


def _active_weeks_sql(j: int, min_books: float, min_minutes: float) -> str:
    return "(" + " + ".join(_one(_active(k, min_books, min_minutes)) for k in range(4 * j - 3, 4 * j + 1)) + ")"


def active_month_columns(months: int, min_weeks: int = ACTIVE_MONTH_MIN_WEEKS,
                         min_books: float = ACTIVE_WEEK_MIN_BOOKS,
                         min_minutes: float = ACTIVE_WEEK_MIN_MINUTES) -> tuple[list[Column], list[Column]]:
    """Active weeks per four-week month and the >= 2 flag."""
    weeks = [_active_weeks_sql(j, min_books, min_minutes) for j in range(1, months + 1)]
    counts = [F.expr(f"{w} AS active_wk_m{j}") for j, w in enumerate(weeks, start=1)]
    flags = [F.expr(f"{_flag(f'{w} >= {min_weeks}')} AS active_wk_flag_m{j}") for j, w in enumerate(weeks, start=1)]
    return counts, flags


def power_month_columns(months: int, as_written: bool = True, min_minutes: float = POWER_WEEK_MIN_MINUTES,
                        min_weeks: int = POWER_MONTH_MIN_WEEKS) -> list[Column]:
    """A month is a power month when 2 of its weeks reach 72 minutes.

    ``as_written`` keeps quirk Q1 of the reference: month 1 tests week 3
    twice and never week 4.
    """
    parts = []
    for j in range(1, months + 1):
        weeks = list(range(4 * j - 3, 4 * j + 1))
        if as_written and j == 1:
            weeks = [1, 2, 3, 3]
        hits = " + ".join(_one(f"reading_mins_w{k} >= {min_minutes}") for k in weeks)
        parts.append(_one(f"({hits}) >= {min_weeks}"))
    cols = [F.expr(f"{p} AS power_active_m{j}") for j, p in enumerate(parts, start=1)]
    return cols + [F.expr("(" + " + ".join(parts) + f") AS power_active_m1_to_m{months}")]


def three_plus_column(months: int, min_books: int = THREE_PLUS_MIN_BOOKS) -> Column:
    """At least three distinct books over the whole period."""
    return F.expr(f"{_flag(f'book_read_m1_to_m{months} >= {min_books}')} AS flag_3plus_m1_m{months}")


def ugc_flag_columns(windows: Sequence[str] = ("d1", "w1", "w2", "w3", "w4", "m1"),
                     as_written: bool = True) -> list[Column]:
    """Highlight, annotation and both-flags per window.

    ``as_written`` keeps quirk Q2: the both-flag of w4 tests annotations of
    w3 and the both-flag of m1 tests annotations of w1.
    """
    partner = {"w4": "w3", "m1": "w1"} if as_written else {}
    cols = []
    for w in windows:
        a2 = partner.get(w, w)
        cols += [F.expr(f"{_flag(f'highlight_{w} > 0')} AS highlight_{w}_flag"),
                 F.expr(f"{_flag(f'annotation_{w} > 0')} AS annotation_{w}_flag"),
                 F.expr(f"{_flag(f'highlight_{w} > 0 AND annotation_{a2} > 0')} AS ugc_{w}_flag")]
    return cols


def minutes_per_session_columns(months: int) -> list[Column]:
    """Month minutes per month reading session; NULL without sessions."""
    return [F.expr(f"round(CAST(try_divide(reading_mins_m{j}, reading_session_m{j}) AS DOUBLE), 6) "
                   f"AS reading_mins_per_session_m{j}") for j in range(1, months + 1)]
