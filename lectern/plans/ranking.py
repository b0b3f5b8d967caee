"""The per-market book ranking as one plan over all markets."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Market
from ..functions.dates import as_timestamp
from ..operators import ranking as R
from ..session import reliable_checkpoint

OUTPUT = ["book_id", "book_title", "subject_name", "topic_name", "language_name", "publisher_name",
          "publisher_imprint", "author", "norm_dtc_revenue", "norm_bay_read_mins", "norm_clicks",
          "publication_date", "norm_enrollment", "newness", "overall_rank", "local_index", "ranked_at"]


def signals(meta: DataFrame, registrations: DataFrame, subs: DataFrame, reading: DataFrame,
            clicks: DataFrame, matches: DataFrame, markets: Sequence[Market], as_of: dt.date):
    """The independent signals, built concurrently.

    Each signal ends in a small written stage (its multi-read aggregate);
    those jobs do not depend on each other, so they are submitted from
    separate driver threads and Spark runs their tasks side by side instead
    of leaving executors idle between small stages.
    """
    spark = meta.sparkSession
    table = R.market_table(spark, markets)
    # (market, user) is read by the revenue and the readership signal: once
    users = reliable_checkpoint(R.market_users(registrations, markets), "market_users")
    books = R.active_books(meta)
    n = len(markets)
    jobs = {
        "revenue": lambda: R.dtc_revenue(registrations, subs, users, as_of, max_markets=n),
        "readers": lambda: R.readership(reading, users, as_of, max_markets=n),
        "interest": lambda: R.search_interest(clicks, table, max_markets=n),
        "ranked": lambda: R.ranked_books(books),
    }
    if any(m.mandate for m in markets):
        jobs["mandate"] = lambda: R.academic_mandate(matches)
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        futures = {k: pool.submit(fn) for k, fn in jobs.items()}
        done = {k: f.result() for k, f in futures.items()}
    return table, books, done["revenue"], done["readers"], done["interest"], done.get("mandate"), done["ranked"]


def scored_books(meta: DataFrame, registrations: DataFrame, subs: DataFrame, reading: DataFrame,
                 clicks: DataFrame, matches: DataFrame, markets: Sequence[Market], as_of: dt.date) -> DataFrame:
    """R9 for all given markets."""
    table, books, revenue, readers, interest, mandate, ranked = signals(
        meta, registrations, subs, reading, clicks, matches, markets, as_of)
    return R.consolidate(books, table, revenue, readers, interest, mandate, max_markets=len(markets),
                         ranked=ranked)


def market_rank(meta: DataFrame, registrations: DataFrame, subs: DataFrame, reading: DataFrame,
                clicks: DataFrame, matches: DataFrame, markets: Sequence[Market], as_of: dt.date) -> DataFrame:
    """R11 (one market record) / R12 (several): 17 columns, ordered by
    market and overall rank."""
    scored = scored_books(meta, registrations, subs, reading, clicks, matches, markets=markets, as_of=as_of)
    ranked = R.overall_rank(scored, max_markets=len(markets))
    return (ranked.select(*[c for c in OUTPUT[:15]], F.col("market").alias("local_index"),
                          as_timestamp(f"{as_of} 00:00:00").alias("ranked_at"))
            .orderBy("local_index", "overall_rank", "book_id"))
