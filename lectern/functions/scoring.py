"""Scores and text clean-up used by the book ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SCORE_FLOOR, SCORE_ROUND_DIGITS, SCORE_SCALE
from ..operators.joins import bounded_broadcast
from ..session import reliable_checkpoint
from .numbers import round6

MAX_SCORE_GROUPS = 100_000


def nullif_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_non_blank(*cols: str) -> Column:
    return F.coalesce(*[nullif_blank(F.col(c)) for c in cols])


def clean_publication_date(c: Column) -> Column:
    """First 8 characters without '-'; blank, 'none', 'na' or NULL -> '0'."""
    s = F.substring(F.replace(c, F.lit("-"), F.lit("")), 1, 8)
    return (F.when(s == "", F.lit("0")).when(F.lower(s).isin("none", "na"), F.lit("0"))
            .when(s.isNull(), F.lit("0")).otherwise(s))


def minmax_score(df: DataFrame, col: str, out: str, partition_cols: Sequence[str] = (),
                 max_groups: int | None = None, materialize: bool = False) -> DataFrame:
    """Scale ``col`` to 0..1000 within each partition, round to tens,
    lift 0 to 1. A partition whose values are all equal scores 1.

    The extremes come from a partial aggregate (one row per partition value,
    size checked) joined back by broadcast, not from a ``partition by 1``
    window that would pull every row into one task. ``max_groups`` is a
    bound on the distinct partition values the caller knows by construction.
    ``df`` is read twice (extremes, then scores); ``materialize`` writes it
    once to the checkpoint folder first, for an aggregate over large facts.
    """
    if materialize:
        df = reliable_checkpoint(df)
    stats = df.groupBy(*partition_cols).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    if partition_cols:
        joined = df.join(bounded_broadcast(stats, max_groups, MAX_SCORE_GROUPS), list(partition_cols))
    else:
        joined = df.crossJoin(bounded_broadcast(stats, 1, 1))  # a global aggregate: one row
    v, mn, mx = F.col(col).cast("double"), F.col("_mn").cast("double"), F.col("_mx").cast("double")
    scaled = F.round(F.try_divide(v - mn, mx - mn) * SCORE_SCALE, SCORE_ROUND_DIGITS)
    score = (F.when(mx == mn, F.lit(SCORE_FLOOR)).when(scaled == 0, F.lit(SCORE_FLOOR))
             .otherwise(scaled))
    return joined.select(*df.columns, round6(score).alias(out))
