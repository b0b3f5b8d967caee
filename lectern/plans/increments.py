"""G8-G12 by increments: new days are added to what is known, late ones too.

The state of a report is a published table of partial rows, one per (user,
book) and batch (``operators.windows.reading_partials``): masks of windows and
sums of minutes. Masks merge by OR and sums by addition, so batches may come in
any order, hold any days, and cut the facts anywhere; only their facts are
read. A batch is added once however often it is tried. ``compact`` puts a
user's rows together.

An anchor that is set stays (a first subscription does not move). If anchors
are corrected, the state has to be made anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.windows import ReadingLayout, merge_reading, reading_metrics, reading_partials
from ..sources.published import Published


class ReadingState:
    def __init__(self, spark: SparkSession, path: str, layout: ReadingLayout):
        self.table, self.layout = Published(spark, path), layout

    def add(self, anchored: DataFrame, reading: DataFrame, batch: str) -> None:
        """Adds the facts ``reading``, none of which an earlier batch has."""
        self.table.append(reading_partials(anchored, reading, self.layout), batch)

    def compact(self) -> None:
        """One row per (user, book) again; batches stay known."""
        self.table.publish(merge_reading([self.table.read()], self.layout))

    def metrics(self, anchored: DataFrame) -> DataFrame:
        """``reading_windows`` of all facts added so far."""
        return reading_metrics(anchored, merge_reading([self.table.read()], self.layout), self.layout)
