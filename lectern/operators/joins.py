"""Broadcasts of sides whose size is bounded by construction, and shuffles whose tasks are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, known_rows: int | None, max_rows: int) -> DataFrame:
    """``df`` to be broadcast if the caller knows, by construction, that it has
    at most ``known_rows`` rows and these are no more than ``max_rows``.

    Nothing is counted here. Without a bound the frame is returned as it is,
    and the planner chooses the join from the sizes it finds at run time.
    """
    return F.broadcast(df) if known_rows is not None and known_rows <= max_rows else df


#: Stored bytes of the tables read, for a task of a shuffle that is spread.
SPREAD_BYTES = 16 << 20


def spread_tasks(*frames: DataFrame) -> int:
    """Tasks in proportion to the stored size of the tables that ``frames`` read
    (by the planner's statistics; no job is run)."""
    total = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.length()))
        total += sum(s for s in sizes if s < 1 << 60)  # larger: not known
    return -(-total // SPREAD_BYTES)


def spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over ``tasks`` partitions, if these are more than the
    session's number, which stays the same however large the tables are."""
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
