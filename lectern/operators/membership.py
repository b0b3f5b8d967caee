"""Facts reduced to a cohort before they are moved.

A semi-join whose cohort is too large to broadcast shuffles every fact first.
Here the cohort becomes a bitmap of hashed ids of a fixed number of words, so
it can always be sent to the tasks that scan the facts: a fact stays if the
bit of its id is set. No member is lost; others that share a bit stay too, so
an exact join has to follow. A cohort that sets most bits prunes little and
costs one probe per fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import bounded_broadcast

#: Words of 64 bits: at most so many small rows are broadcast (about 40 MB as a
#: hash table), whatever the cohort. 10 million members set 14 % of the bits.
BITMAP_WORDS = 1 << 20

_WORD, _BIT = "_member_word", "_member_bits"


def _place(col: str, words: int) -> tuple[F.Column, F.Column]:
    h = F.pmod(F.xxhash64(F.col(col).cast("string")), F.lit(64 * words))
    return F.shiftright(h, 6), h.bitwiseAND(F.lit(63)).cast("int")


def member_bitmap(cohort: DataFrame, col: str = "user_id", words: int = BITMAP_WORDS) -> DataFrame:
    """(word, bits) of the ids of ``cohort``: ``words`` rows at most."""
    word, bit = _place(col, words)
    placed = cohort.filter(F.col(col).isNotNull()).select(word.alias(_WORD), bit.alias("_b"))
    return placed.groupBy(_WORD).agg(F.expr("bit_or(shiftleft(1L, _b))").alias(_BIT))


def likely_members(facts: DataFrame, cohort: DataFrame, col: str = "user_id", words: int = BITMAP_WORDS) -> DataFrame:
    """Facts of members of ``cohort``, and of few others; columns and rows else as they are."""
    word, bit = _place(col, words)
    bitmap = bounded_broadcast(member_bitmap(cohort, col, words), words, BITMAP_WORDS)
    near = facts.join(bitmap, word == F.col(_WORD)).filter(F.getbit(F.col(_BIT), bit) == 1)
    return near.select(*[F.col(f"`{c}`") for c in facts.columns])
