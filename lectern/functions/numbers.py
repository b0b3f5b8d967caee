"""Numeric result conventions shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def round6(c: Column | str) -> Column:
    """Doubles leave an operator rounded to 6 places, so results do not
    depend on the order in which a distributed sum met its inputs."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), DIGITS)


#: Money, minutes and counts given as doubles are summed as decimals of so
#: many places, so that a sum doesn't depend on the order of its rows.
EXACT = "decimal(28,10)"


def exact_sum(c: Column | str) -> Column:
    return F.sum(F.col(c).cast(EXACT) if isinstance(c, str) else c.cast(EXACT)).cast("double")
