"""The retention dashboard's metrics (specified in prose only).

Decisions the prose leaves open: "above" the median means strictly greater;
the median is exact (percentile 0.5, interpolated); a user's book category
('0', '1', '2', '3+') is taken over the whole period; subscription week 1
is days 0-6 after the subscription start, earlier activity is not counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round6
from ..session import reliable_checkpoint
from .joins import bounded_broadcast

#: What ``_book_category`` can give.
BOOK_CATEGORIES = ("0", "1", "2", "3+")


def _active_days(reading: DataFrame, user_col: str, date_col: str) -> DataFrame:
    """Distinct (user, day): at most one row per user and day, so even a
    user with a huge share of the facts is small after this step."""
    return (reading.select(F.col(user_col).alias("user_id"), F.col(date_col).alias("read_date"))
            .filter(F.col("user_id").isNotNull() & F.col("read_date").isNotNull())
            .distinct())


def _ard_per_user(days: DataFrame) -> DataFrame:
    return days.groupBy("user_id").agg(F.count(F.lit(1)).alias("active_reading_days"))


def ard_distribution(reading: DataFrame, user_col: str = "user_id", date_col: str = "read_date") -> DataFrame:
    """Histogram of active reading days per user, with the median."""
    per_user = _ard_per_user(_active_days(reading, user_col, date_col))
    hist = per_user.groupBy("active_reading_days").agg(F.count(F.lit(1)).alias("users"))
    med = hist.agg(F.percentile("active_reading_days", 0.5, F.col("users")).cast("double").alias("median_ard"))
    return hist.crossJoin(bounded_broadcast(med, 1, 1))  # a global aggregate: one row


def ard_daily(reading: DataFrame, user_col: str = "user_id", date_col: str = "read_date") -> DataFrame:
    """Daily active readers split below / above the ARD median."""
    days = _active_days(reading, user_col, date_col)
    per_user = _ard_per_user(days)
    med = per_user.agg(F.median("active_reading_days").alias("_median"))
    segment = (per_user.crossJoin(bounded_broadcast(med, 1, 1))
               .select("user_id", F.when(F.col("active_reading_days") > F.col("_median"), "above")
                       .otherwise("below").alias("segment")))
    return (days.join(segment, "user_id").groupBy("read_date", "segment")
            .agg(F.count(F.lit(1)).alias("active_readers")))


def _sub_week(day_col: str) -> F.Column:
    return (F.floor(F.datediff(F.col(day_col), F.to_date("sub_start_timestamp")) / 7) + 1).cast("long")


def _cohort_starts(cohort: DataFrame) -> DataFrame:
    return (cohort.select("user_id", "cohort_period", "sub_start_timestamp")
            .filter(F.col("sub_start_timestamp").isNotNull()))


def _readers_in_weeks(reading: DataFrame, cohort: DataFrame, user_col: str, date_col: str) -> DataFrame:
    """Distinct (cohort, subscription week, user): duplicates go before the shuffle."""
    seen = (reading.select(F.col(user_col).alias("user_id"), F.col(date_col).alias("read_date"))
            .join(_cohort_starts(cohort), "user_id")
            .withColumn("sub_week", _sub_week("read_date")).filter(F.col("sub_week") >= 1))
    return seen.select("cohort_period", "sub_week", "user_id").distinct()


def readers_by_week(reading: DataFrame, cohort: DataFrame, user_col: str = "user_id",
                    date_col: str = "read_date") -> DataFrame:
    """D3: active readers per cohort and subscription week."""
    seen = _readers_in_weeks(reading, cohort, user_col, date_col)
    return seen.groupBy("cohort_period", "sub_week").agg(F.count(F.lit(1)).alias("active_readers"))


def reader_bitmaps(reading: DataFrame, cohort: DataFrame, user_col: str = "user_id", date_col: str = "read_date") -> DataFrame:
    """(cohort_period, sub_week, bucket, users): who read, as exact bitmaps of
    32,768 user ids each. They stand for the facts: any set of cohorts or weeks
    is counted from them, each user once."""
    seen = _readers_in_weeks(reading, cohort, user_col, date_col)
    return (seen.groupBy("cohort_period", "sub_week", F.bitmap_bucket_number("user_id").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users")))


def readers_from_bitmaps(state: DataFrame, by: list[str]) -> DataFrame:
    """Distinct readers per ``by`` (columns of the state, or made from them)."""
    merged = state.groupBy(*by, "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("users")).alias("active_readers"))


def _book_category(books: F.Column) -> F.Column:
    return F.when(books >= 3, F.lit("3+")).otherwise(books.cast("string"))


def _seen(events: DataFrame, user_col: str, session_col: str, book_col: str, *more: str) -> DataFrame:
    return (events.filter(F.col(user_col).isNotNull())
            .select(F.col(user_col).alias("user_id"), F.col(session_col).alias("session_id"), F.col(book_col).alias("_book"), *more))


def _distinct_of(rows: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    # pairs first: a hot user is spread over tasks, and nothing is expanded
    return rows.select(*by, column).distinct().groupBy(*by).agg(F.count(column).alias(name))


def _sessions_per_user(seen: DataFrame) -> DataFrame:
    per_user = _distinct_of(seen, ["user_id"], "session_id", "active_reading_sessions").join(_distinct_of(seen, ["user_id"], "_book", "_books"), "user_id")
    return per_user.select("user_id", "active_reading_sessions", _book_category(F.col("_books")).alias("book_category"))


def ars_distribution(events: DataFrame, user_col: str = "user_id", session_col: str = "session_id",
                     book_col: str = "book_id") -> DataFrame:
    """Histogram of active reading sessions per user by book category,
    with the median per category."""
    per_user = _sessions_per_user(_seen(events, user_col, session_col, book_col))
    hist = per_user.groupBy("book_category", "active_reading_sessions").agg(F.count(F.lit(1)).alias("users"))
    med = hist.groupBy("book_category").agg(
        F.percentile("active_reading_sessions", 0.5, F.col("users")).cast("double").alias("median_ars"))
    return hist.join(bounded_broadcast(med, len(BOOK_CATEGORIES), len(BOOK_CATEGORIES)), "book_category")


def sessions_by_week(events: DataFrame, cohort: DataFrame, user_col: str = "user_id",
                     session_col: str = "session_id", book_col: str = "book_id",
                     date_col: str = "event_date") -> DataFrame:
    """Reading sessions and sessions per user by cohort, subscription
    week and book category.

    The events are read once: what is left of them (distinct user, session,
    book and day) is written, then what is counted (distinct user and session
    by group) is written, and both counts come from that.
    """
    seen = reliable_checkpoint(_seen(events, user_col, session_col, book_col, F.col(date_col).alias("_day")).distinct(), "dashboard_events")
    category = _distinct_of(seen, ["user_id"], "_book", "_books").select("user_id", _book_category(F.col("_books")).alias("book_category"))
    in_weeks = (seen.select("user_id", "session_id", "_day").join(_cohort_starts(cohort), "user_id")
                .withColumn("sub_week", _sub_week("_day")).filter(F.col("sub_week") >= 1)
                .select("cohort_period", "sub_week", "user_id", "session_id").distinct())
    group = ["cohort_period", "sub_week", "book_category"]
    ev = reliable_checkpoint(in_weeks.join(category, "user_id").select(*group, "user_id", "session_id"), "dashboard_weeks")
    out = _distinct_of(ev, group, "session_id", "reading_sessions").join(_distinct_of(ev, group, "user_id", "users"), group)
    return out.withColumn("sessions_per_user", round6(F.try_divide(F.col("reading_sessions"), F.col("users"))))
