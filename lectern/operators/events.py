"""E1 event_catalog: which tracking events arrive, how often, how recently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EVENT_CATALOG_LIMIT
from ..functions.dates import as_timestamp, whole_days


def event_catalog(events: DataFrame, cutoff, as_of, limit: int = EVENT_CATALOG_LIMIT,
                  name_col: str = "event_name", env_col: str = "environment_name",
                  ts_col: str = "record_date") -> DataFrame:
    """Per (event, environment): count, first and last arrival up to ``cutoff``.

    Keeps the ``limit`` most frequent pairs (ties broken by name, then
    environment) and adds the whole days from the last arrival to ``as_of``.
    The aggregate is partial per task and the cut is a distributed top-k
    (``TakeOrderedAndProject``), so nothing but ``limit`` rows per task
    reaches the final merge.
    """
    ts = F.col(ts_col)
    per_pair = (events.filter(ts <= as_timestamp(cutoff))
                .groupBy(name_col, env_col)
                .agg(F.count(F.lit(1)).alias("cnt"),
                     F.min(ts).alias("first_event_timestamp"),
                     F.max(ts).alias("last_event_timestamp")))
    top = per_pair.orderBy(F.desc("cnt"), F.asc(name_col), F.asc(env_col)).limit(limit)
    return (top.select("*", whole_days(F.col("last_event_timestamp"), as_timestamp(as_of))
                       .alias("last_time_event_was_received"))
            .orderBy(name_col, env_col))
