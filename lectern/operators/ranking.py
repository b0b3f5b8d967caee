"""The signals and scores of the per-market book ranking.

Every signal is computed for all markets in one pass with a ``market``
column (R12), instead of once per market: the facts are scanned once,
pre-aggregated to (user, book), and only then fanned out to the markets a
user belongs to. A single-market ranking (R11) is the same plan with one
market record.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (CLICKS_LOOKBACK_MONTHS, READING_LOOKBACK_MONTHS, REVENUE_LOOKBACK_MONTHS,
                      Market)
from ..functions.dates import on_or_after
from ..functions.numbers import EXACT, exact_sum, round6
from ..functions.scoring import clean_publication_date, first_non_blank, minmax_score, nullif_blank
from ..session import reliable_checkpoint
from .joins import bounded_broadcast, spread, spread_tasks
from .rank import global_rank

MAX_MARKETS = 10_000


def months_back(as_of: dt.date, months: int) -> dt.date:
    """First day of ``as_of``'s month, ``months`` months earlier."""
    total = as_of.year * 12 + (as_of.month - 1) - months
    return dt.date(total // 12, total % 12 + 1, 1)


def market_table(spark: SparkSession, markets: Sequence[Market]) -> DataFrame:
    schema = T.StructType([T.StructField("market", T.StringType()), T.StructField("locale", T.StringType()),
                           T.StructField("mandate", T.BooleanType())])
    return spark.createDataFrame([(m.name, m.locale, m.mandate) for m in markets], schema)


def active_books(meta: DataFrame) -> DataFrame:
    """Available books; blanks are missing; first non-blank ISBN,
    topic and author."""
    return meta.filter(F.col("is_available") == 1).select(
        F.col("id").alias("book_id"), F.col("isbn13_idvalue").alias("isbn"),
        first_non_blank("hardback_isbn", "softback_isbn").alias("other_isbn"),
        F.col("title_text").alias("book_title"), "publisher_name", "publisher_imprint",
        "publication_date", "date_activated", "date_added",
        nullif_blank(F.col("subject_name")).alias("subject_name"),
        first_non_blank("topic_name1", "topic_name2", "topic_name3", "topic_name4").alias("topic_name"),
        first_non_blank("contributor1_name", "contributor2_name", "contributor3_name").alias("author"),
        "language_name")


def market_users(registrations: DataFrame, markets: Sequence[Market]) -> DataFrame:
    """R2: (market, user_id) for every market a user belongs to, from one
    scan (a user can be in two markets, e.g. by language and by country)."""
    tags = []
    for m in markets:
        if m.language is not None:
            cond = F.col("country_language") == m.language
        else:
            cond = F.lower("acquisition_country").isin(*[c.lower() for c in m.countries])
        tags.append(F.when(cond, F.lit(m.name)))
    users = (registrations.select("user_id", F.explode(F.array_compact(F.array(*tags))).alias("market"))
             .filter(F.col("user_id").isNotNull())
             .dropDuplicates(["market", "user_id"])
             .select("market", "user_id"))
    return users


def dtc_revenue(registrations: DataFrame, subs: DataFrame, users_by_market: DataFrame,
                as_of: dt.date, max_markets: int | None = None) -> DataFrame:
    """Per (market, referrer book): direct, converted users registered in
    the last 12 months who paid anything, and their lifetime paid total."""
    regs = registrations.filter(
        on_or_after(registrations, "registration_time", months_back(as_of, REVENUE_LOOKBACK_MONTHS))
        & (F.col("payment_channel_crude") == "direct") & (F.col("converted_subscribed") == "Y")
        & F.col("referrer_book").isNotNull())
    eligible = regs.select("user_id", "referrer_book").join(users_by_market, "user_id")
    paid = (subs.join(eligible.select("user_id"), "user_id", "left_semi")
            .groupBy("user_id").agg(exact_sum("total_paid_gbp").alias("total_paid_gbp")))
    revenue = (eligible.join(paid, "user_id").filter(F.col("total_paid_gbp") > 0)
               .groupBy("market", "referrer_book")
               .agg(F.count("user_id").alias("users"), exact_sum("total_paid_gbp").alias("dtc_revenue")))
    return minmax_score(revenue, "dtc_revenue", "norm_dtc_revenue", ["market"], max_markets, materialize=True)


def readership(reading: DataFrame, users_by_market: DataFrame, as_of: dt.date,
               max_markets: int | None = None) -> DataFrame:
    """Per (market, book): readers and minutes over 6 months, and the
    Bayesian average ``(C*m + minutes) / (C + readers)`` with C the mean
    readers per book and m the mean minutes per reader of a book."""
    recent = reading.filter(on_or_after(reading, "read_date", months_back(as_of, READING_LOOKBACK_MONTHS)))
    # (user, book) first: bounds a hot user to one row per book it read; then by
    # user, each over tasks in proportion to the tables, so that none grows with them
    tasks = spread_tasks(recent)
    per_pair = (spread(recent, tasks, "user_id", "book_id")
                .groupBy("user_id", "book_id").agg(F.sum(F.col("reading_minutes").cast(EXACT)).alias("_mins")))
    per_book = (spread(per_pair, tasks, "user_id").join(spread(users_by_market, tasks, "user_id"), "user_id")
                .groupBy("market", "book_id")
                .agg(F.count(F.lit(1)).alias("users"), exact_sum("_mins").alias("total_reading_mins")))
    # read three times below (averages, scores, extremes): written once
    per_book = reliable_checkpoint(
        per_book.withColumn("avg_read_mins", F.col("total_reading_mins") / F.col("users")))
    averages = per_book.groupBy("market").agg(
        F.avg("users").alias("all_user"), (exact_sum("avg_read_mins") / F.count("avg_read_mins")).alias("all_avg_read_mins"))
    bay = ((F.col("all_user") * F.col("all_avg_read_mins")) + F.col("total_reading_mins")) \
        / (F.col("all_user") + F.col("users"))
    weighed = (per_book.join(bounded_broadcast(averages, max_markets, MAX_MARKETS), "market")
               .select("market", "book_id", "users", "total_reading_mins", "avg_read_mins", bay.alias("bay_read_mins")))
    scored = minmax_score(weighed, "bay_read_mins", "norm_bay_read_mins", ["market"], max_markets)
    return scored.withColumns({c: round6(c) for c in ("avg_read_mins", "bay_read_mins")})


def search_interest(clicks: DataFrame, markets: DataFrame, max_markets: int | None = None) -> DataFrame:
    """Per (market, book): clicks in the market's locale from the first
    of the month three months before the latest date in the table.

    The cut-off is a scalar subquery over the click table, so the range
    filter is evaluated once and applied to every scan task.
    """
    cut = clicks.agg(F.add_months(F.trunc(F.max("dates"), "month"), -CLICKS_LOOKBACK_MONTHS)).scalar()
    locales = markets.select("locale").distinct()
    book = F.col("book_id").try_cast("int")
    per_locale = (clicks.filter((F.col("dates") >= cut) & F.col("book_id").isNotNull())
                  .join(bounded_broadcast(locales, max_markets, MAX_MARKETS), "locale", "left_semi")
                  .select("locale", book.alias("book_id"),
                          F.col("impressions").try_cast("double").alias("impressions"),
                          F.col("clicks").try_cast("double").alias("clicks"))
                  .filter(F.col("book_id").isNotNull())
                  .groupBy("locale", "book_id")
                  .agg(exact_sum("impressions").alias("impressions"), exact_sum("clicks").alias("clicks")))
    by_market = (per_locale.join(bounded_broadcast(markets.select("market", "locale"), max_markets, MAX_MARKETS),
                                 "locale")
                 .filter(F.col("clicks") > 0)
                 .select("market", "book_id", "impressions", "clicks"))
    return minmax_score(by_market, "clicks", "norm_clicks", ["market"], max_markets, materialize=True)


def newness(books: DataFrame, with_rank: bool = True) -> DataFrame:
    """Publication date cleaned to 'yyyymmdd' (or '0'); optionally its
    rank, latest first."""
    out = books.select("book_id", "publication_date",
                       clean_publication_date(F.col("publication_date")).alias("publication_date_clean"),
                       "date_activated", "date_added", "book_title")
    if with_rank:
        out = global_rank(out, [("publication_date_clean", False)], out="norm_publication_dt")
    return out


def academic_mandate(matches: DataFrame) -> DataFrame:
    """Enrolments of distinct available (book, isbn, degree, university,
    enrolment) matches, summed per book, positive only, then scored."""
    enrol = F.col("degree_new_enrollments").try_cast("double")
    per_book = (matches.filter(F.col("available_status") == "Yes")
                .select("book_id", "isbn", "degree_name", "uni_code", enrol.alias("enrollment"))
                .dropDuplicates()
                .groupBy("book_id").agg(exact_sum("enrollment").alias("enrollment"))
                .filter(F.col("enrollment") > 0))
    return minmax_score(per_book, "enrollment", "norm_enrollment", materialize=True)


NEWNESS_ORDER = [("publication_date", False), ("date_activated", False), ("date_added", False),
                 ("book_title", True)]


def ranked_books(books: DataFrame) -> DataFrame:
    """Active books with the cleaned publication date and the newness rank
    (market-independent, so ranked once for all markets)."""
    fresh = books.select("book_id", "book_title", "subject_name", "topic_name", "language_name",
                         "publisher_name", "publisher_imprint", "author", "date_activated", "date_added",
                         F.coalesce(clean_publication_date(F.col("publication_date")), F.lit("0"))
                         .alias("publication_date"))
    return global_rank(fresh, NEWNESS_ORDER, out="newness")


def consolidate(books: DataFrame, markets: DataFrame, revenue: DataFrame, readers: DataFrame,
                interest: DataFrame, mandate: DataFrame | None, max_markets: int | None = None,
                ranked: DataFrame | None = None) -> DataFrame:
    """One row per (market, active book) with every signal (missing -> 0)
    and the newness rank. ``ranked`` is ``ranked_books(books)`` if already
    computed."""
    fresh = ranked if ranked is not None else ranked_books(books)
    grid = fresh.crossJoin(bounded_broadcast(markets.select("market", "mandate"), max_markets, MAX_MARKETS))
    rev = revenue.select("market", F.col("referrer_book").alias("book_id"), "norm_dtc_revenue")
    rd = readers.select("market", "book_id", "norm_bay_read_mins")
    cl = interest.select("market", "book_id", "norm_clicks")
    scored = (grid.join(rev, ["market", "book_id"], "left").join(rd, ["market", "book_id"], "left")
              .join(cl, ["market", "book_id"], "left"))
    if mandate is not None:
        scored = scored.join(mandate.select("book_id", "norm_enrollment"), "book_id", "left")
        enrol = F.when(F.col("mandate"), F.coalesce(F.col("norm_enrollment"), F.lit(0.0))).otherwise(F.lit(0.0))
    else:
        enrol = F.lit(0.0)
    zero = F.lit(0.0)
    return scored.select(
        "market", "book_id", "book_title", "subject_name", "topic_name", "language_name", "publisher_name",
        "publisher_imprint", "author",
        F.coalesce(F.col("norm_dtc_revenue"), zero).cast("double").alias("norm_dtc_revenue"),
        F.coalesce(F.col("norm_bay_read_mins"), zero).cast("double").alias("norm_bay_read_mins"),
        F.coalesce(F.col("norm_clicks"), zero).cast("double").alias("norm_clicks"),
        "publication_date", enrol.cast("double").alias("norm_enrollment"), "newness")


OVERALL_ORDER = [("norm_dtc_revenue", False), ("norm_enrollment", False), ("norm_bay_read_mins", False),
                 ("norm_clicks", False), ("newness", True)]


def overall_rank(scored: DataFrame, max_markets: int | None = None) -> DataFrame:
    """Rank per market by revenue, mandate (0 outside mandate markets,
    so it never reorders them), readership and clicks descending, then
    newness rank ascending."""
    return global_rank(scored, OVERALL_ORDER, out="overall_rank", partition_cols=["market"], max_groups=max_markets)
