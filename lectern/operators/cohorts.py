"""Retention cohorts and the activity extracts behind the dashboard."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import REFERENCE_COHORTS, RETENTION_SESSION_EVENTS
from ..functions.dates import day_range
from .joins import bounded_broadcast

MAX_COHORTS = 10_000

REGISTRATION_COLUMNS = [
    "registration_time", "user_id", "payment_channel_crude", "internal_user", "converted_trial",
    "converted_subscribed", "converted_paid", "acquisition_country", "acquisition_region", "user_persona",
    "academic_institution", "organisation_id", "organisation_name", "utm_source", "utm_medium",
    "referrer_book", "internal_persona", "platform_status", "country_language", "user_language"]

COHORT_COLUMNS = ["cohort_month", "cohort_year", "cohort_period", "registration_month", *REGISTRATION_COLUMNS,
                  "academic_discipline", "sub_start_timestamp", "sub_end_timestamp", "subscribed_months"]


def cohort_table(spark: SparkSession, cohorts=REFERENCE_COHORTS) -> DataFrame:
    schema = T.StructType([T.StructField("_month", T.StringType()), T.StructField("cohort_month", T.StringType()),
                           T.StructField("cohort_year", T.StringType()), T.StructField("cohort_period", T.StringType())])
    rows = [(f"{first} 00:00:00", month, year, period) for first, month, year, period in cohorts]
    return (spark.createDataFrame(rows, schema)
            .select(F.col("_month").cast("timestamp_ntz").alias("registration_month"),
                    "cohort_month", "cohort_year", "cohort_period"))


def _next_month(d: dt.date) -> dt.date:
    return dt.date(d.year + d.month // 12, d.month % 12 + 1, 1)


def label_cohorts(registrations: DataFrame, cohorts=REFERENCE_COHORTS) -> DataFrame:
    """Converted users registered in one of the cohort months, with the
    cohort labels (a broadcast join to the small cohort list replaces the
    reference's CASE ladders). A range on the raw timestamp bounds the scan."""
    spark = registrations.sparkSession
    firsts = [c[0] for c in cohorts]
    bounds = day_range(registrations, "registration_time", min(firsts),
                       _next_month(max(firsts)) - dt.timedelta(days=1))
    reg = (registrations.filter(bounds & (F.col("converted_subscribed") == "Y"))
           .withColumn("registration_month", F.date_trunc("month", "registration_time").cast("timestamp_ntz")))
    table = bounded_broadcast(cohort_table(spark, cohorts), len(cohorts), MAX_COHORTS)
    labelled = reg.join(table, "registration_month")
    return labelled.select("cohort_month", "cohort_year", "cohort_period", "registration_month",
                           *REGISTRATION_COLUMNS)


def rollup_subscriptions(subs: DataFrame, start_col: str = "subscription_start_time",
                         end_col: str = "end_timestamp", paid_end_col: str = "paid_end_timestamp",
                         months_col: str = "subscribed_months") -> DataFrame:
    """Per user over 'subscribed' rows: first start, last end (paid end
    when the end is missing), total months (missing counts 0)."""
    return (subs.filter(F.col("subscription_type") == "subscribed")
            .groupBy("user_id")
            .agg(F.min(start_col).alias("sub_start_timestamp"),
                 F.max(F.coalesce(F.col(end_col), F.col(paid_end_col))).alias("sub_end_timestamp"),
                 F.sum(F.coalesce(F.col(months_col), F.lit(0))).alias("subscribed_months")))


def enrich_cohort(labelled: DataFrame, disciplines: DataFrame, rollup: DataFrame) -> DataFrame:
    """Cohort users with their discipline ('Unknown' when missing) and
    subscription roll-up; all three sides are keyed by user_id, so both
    left joins share one hash partitioning of the cohort."""
    joined = (labelled.join(disciplines.select("user_id", "academic_discipline"), "user_id", "left")
              .join(rollup, "user_id", "left"))
    return joined.select(*[F.coalesce(F.col(c), F.lit("Unknown")).alias(c) if c == "academic_discipline"
                           else F.col(c) for c in COHORT_COLUMNS])


FILTER_COLUMNS = {
    "cohort_month": "cohort_month",
    "region": "acquisition_region",
    "user_persona": "user_persona",
    "user_type": "payment_channel_crude",
    "academic_discipline": "academic_discipline",
    "platform": "platform_status",
}


def filter_cohort(df: DataFrame, **filters: Sequence[str] | None) -> DataFrame:
    """C4: the dashboard's optional filters; each is absent (no filter) or a
    list of accepted values."""
    out = df
    for name, values in filters.items():
        if name not in FILTER_COLUMNS:
            raise KeyError(f"unknown cohort filter {name!r}")
        if values:
            out = out.filter(F.col(FILTER_COLUMNS[name]).isin(*values))
    return out


def reading_list(matches: DataFrame, cleanup: DataFrame, book_col: str = "book_id",
                 isbn_col: str = "list_isbn", list_col: str = "list_isbn") -> DataFrame:
    """Books that are available or whose ISBN is on the clean-up list.

    ``IN (subquery)`` under ``OR`` becomes an existence join: each match row
    is kept once however often its ISBN is listed, and the list side is
    broadcast only when its runtime size allows.
    """
    spark = matches.sparkSession
    return spark.sql(
        f"select {book_col} as book_id from {{m}} "
        f"where available_status = 'Yes' or {isbn_col} in (select {list_col} from {{c}})",
        m=matches, c=cleanup)


def extract_range(df: DataFrame, date_col: str, lo, hi) -> DataFrame:
    """Rows whose ``date_col`` falls on a day in ``lo`` .. ``hi``."""
    return df.filter(day_range(df, date_col, lo, hi))


def extract_events(df: DataFrame, lo, hi, names: Sequence[str] = RETENTION_SESSION_EVENTS,
                   date_col: str = "event_date", name_col: str = "event_name") -> DataFrame:
    """Events of the listed names on a day in ``lo`` .. ``hi``."""
    return df.filter(day_range(df, date_col, lo, hi) & F.col(name_col).isin(*names))
