"""Distributed ``rank()``: the SQL rank without a single-partition window.

``rank() over (order by k)`` makes Spark move every row into one task
(``Exchange SinglePartition``). Here the rows themselves are dealt out in the
order of the ranking, and what a task cannot see is added from a summary of
a row per task:

1. the input is read once and written with a number for each row, so that
   nothing that is decided below can change when a task is repeated;
2. rows are range-partitioned by the sort order and, behind it, the row number:
   a key with any share of the rows spreads over as many partitions as it
   fills. Inside a partition the plain ``rank()`` is taken, and written;
3. each (range partition, group) gives a summary row: how many rows, the rank
   of its last key, and hashes of its first and last key. In order of the
   partitions, running sums give the rows before each, and a key that goes on
   from the partition before keeps the rank it had there;
4. the summary (bounded by partitions x groups) is sent to the rows: the rank
   is the place where its key begins, or rows before + local rank.

No key is joined back, and no key's rows have to meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, reliable_checkpoint
from .joins import bounded_broadcast

#: Summary rows (one per range partition and group) that are broadcast.
OFFSET_ROWS_LIMIT = 1_000_000


def _sort(order: Sequence[tuple[str, bool]], partition_cols: Sequence[str]) -> list[Column]:
    cols = [F.col(p).asc_nulls_last() for p in partition_cols]
    cols += [F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last() for c, asc in order]
    return cols


def _digest(cols: Sequence[str], seed: int) -> Column:
    """64 bits of a key, nulls told from values."""
    return F.xxhash64(F.lit(seed), *[x for c in cols for x in (F.col(c), F.col(c).isNull())])


def summarise(local: DataFrame, keys: Sequence[str], partition_cols: Sequence[str]) -> DataFrame:
    """Per (``_pid``, group): rows before it, and the rank of its first key."""
    sums = local.groupBy("_pid", *partition_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_local").alias("_last"),
        *[f(_digest(keys, seed), "_local").alias(f"_{name}{seed}") for seed in (1, 2) for name, f in (("first", F.min_by), ("end", F.max_by))])
    by = Window.partitionBy(*partition_cols).orderBy("_pid")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("_n").over(so_far) - F.col("_n")
    goes_on = F.coalesce((F.lag("_end1").over(by) == F.col("_first1")) & (F.lag("_end2").over(by) == F.col("_first2")), F.lit(False))
    marked = sums.select("_pid", *partition_cols, "_n", "_last", before.alias("_before"), goes_on.alias("_goes_on"))
    # the rank of a partition's last key, unknown where its one key began earlier
    own = F.when((F.col("_last") > 1) | ~F.col("_goes_on"), F.col("_before") + F.col("_last"))
    ends = marked.withColumn("_end", F.last(own, ignorenulls=True).over(so_far))
    first = F.when(F.col("_goes_on"), F.lag("_end").over(by)).otherwise(F.col("_before") + 1)
    return ends.select("_pid", *partition_cols, "_before", first.alias("_begins"))


def global_rank(df: DataFrame, order: Sequence[tuple[str, bool]], out: str = "rank",
                partition_cols: Sequence[str] = (), num_partitions: int | None = None,
                max_groups: int | None = None) -> DataFrame:
    """``df`` plus ``out`` = rank() over (partition by ``partition_cols``
    order by ``order``), NULLs last in both directions. ``order`` is a list
    of (column, ascending). ``max_groups`` bounds the distinct
    ``partition_cols`` values when the caller knows it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [c for c, _ in order]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = _sort(order, partition_cols)

    rows = reliable_checkpoint(df.withColumn("_row", F.monotonically_increasing_id()), "rank_rows")
    ranged = rows.repartitionByRange(n, *sort, F.col("_row")).drop("_row").withColumn("_pid", F.spark_partition_id())
    inside = Window.partitionBy("_pid", *partition_cols).orderBy(*_sort(order, ()))
    local = reliable_checkpoint(ranged.withColumn("_local", F.rank().over(inside).cast("long")), "rank_local")

    known = None if partition_cols and max_groups is None else n * (max_groups or 1)
    summary = summarise(local, keys, partition_cols).select(
        F.col("_pid").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(partition_cols)], "_before", "_begins")
    on = (F.col("_pid") == F.col("_p"))
    for i, c in enumerate(partition_cols):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    rank = F.when(F.col("_local") == 1, F.col("_begins")).otherwise(F.col("_before") + F.col("_local"))
    return local.join(bounded_broadcast(summary, known, OFFSET_ROWS_LIMIT), on).select(*df.columns, rank.cast("long").alias(out))


def plain_rank(df: DataFrame, order: Sequence[tuple[str, bool]], out: str = "rank",
               partition_cols: Sequence[str] = ()) -> DataFrame:
    """The textbook window form (single partition without ``partition_cols``);
    kept as the test oracle for ``global_rank``."""
    w = Window.partitionBy(*partition_cols).orderBy(*_sort(order, ()))
    return df.withColumn(out, F.rank().over(w).cast("long"))
