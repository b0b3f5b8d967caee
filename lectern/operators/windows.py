"""Per-user activity in day windows after an anchor.

Both operators follow the same plan:

1. join the facts with the anchors on ``user_id`` (the planner chooses by
   their size; small cohorts are joined inside the scan's tasks) and keep
   offsets inside the windows;
2. aggregate once per (user, entity) into an atom bitmask plus plain
   conditional sums (partial aggregation map-side; a hot user is spread over
   tasks by its entities);
3. aggregate per user with bit tests (one row per user and task survives the
   partial step, so even a user with a third of all rows is cheap here);
4. left-join back to every anchored user so users without activity get
   zero counts and NULL sums, exactly like the reference's left join.

The rows of step 2 can be kept and merged: masks by OR, sums by addition, in
any order and however late a day comes (``reading_partials``,
``merge_reading``, ``reading_metrics``).

The many per-window expressions are generated as SQL expression text: one
JVM call each, instead of one per column / literal / operator.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (ANNOTATION_EVENT, BOOK_OPEN_EVENT, HIGHLIGHT_EVENT,
                      READING_SESSION_EVENTS, Window)
from ..functions.masks import atom_bit_sql, atom_words, atoms, count_sql, meets_sql, position_bit_sql, span_words, word_names

_ANCHOR_DAY = "_anchor_day"
_OFFSET = "_offset"
E = F.expr
#: Minutes are summed as whole numbers of 10^-8 minutes: exact up to so many
#: places, in any order, and in long arithmetic (a sum holds 9e10 minutes).
MINUTES_TYPE, MINUTE_PARTS = "decimal(18,8)", 100_000_000


def _anchors(anchored: DataFrame, user_col: str, anchor_col: str) -> DataFrame:
    return anchored.select(F.col(user_col), F.to_date(anchor_col).alias(_ANCHOR_DAY))


def _with_offsets(facts: DataFrame, anchors: DataFrame, user_col: str, date_col: str,
                  lo: int, hi: int) -> DataFrame:
    return (facts.join(anchors, user_col)
            .withColumn(_OFFSET, F.datediff(F.col(date_col), F.col(_ANCHOR_DAY)))
            .filter(E(f"{_OFFSET} BETWEEN {lo} AND {hi}")))


def _in(w: Window) -> str:
    return f"{_OFFSET} BETWEEN {w.lo} AND {w.hi}"


def _attach(anchored: DataFrame, user_col: str, per_user: DataFrame, counts: list[str]) -> DataFrame:
    out = anchored.select(user_col).join(per_user, user_col, "left")
    return out.selectExpr(user_col, *[f"coalesce(CAST({c} AS BIGINT), 0L) AS {c}" if c in counts else c
                                      for c in per_user.columns if c != user_col])


@dataclass(frozen=True)
class ReadingLayout:
    """Which reading metrics are wanted, and the columns that hold them per (user, book)."""

    book_windows: tuple[Window, ...] = ()
    minute_windows: tuple[Window, ...] = ()
    day_windows: tuple[Window, ...] = ()
    calendar_week_windows: tuple[Window, ...] = ()

    @property
    def every(self) -> list[Window]:
        return [*self.book_windows, *self.minute_windows, *self.day_windows, *self.calendar_week_windows]

    @property
    def span(self) -> tuple[int, int]:
        return min(w.lo for w in self.every), max(w.hi for w in self.every)

    @property
    def runs(self) -> list[tuple[int, int]]:
        return atoms(self.book_windows) if self.book_windows else []

    @property
    def days(self) -> tuple[int, int]:
        """First day, and number of days, of the day masks."""
        if not self.day_windows:
            return 0, 0
        lo = min(w.lo for w in self.day_windows)
        return lo, max(w.hi for w in self.day_windows) - lo + 1

    def book_words(self) -> list[str]:
        return word_names("_books", len(self.runs))

    def day_words(self) -> list[str]:
        return word_names("_days", self.days[1])

    @staticmethod
    def weeks(w: Window) -> int:
        """Calendar weeks that a window can touch."""
        return (w.hi - w.lo) // 7 + 2

    def week_words(self, w: Window) -> list[str]:
        return word_names(f"_cw_{w.name}", self.weeks(w))

    def masks(self) -> list[str]:
        return self.book_words() + self.day_words() + [c for w in self.calendar_week_windows for c in self.week_words(w)]

    def sums(self) -> list[str]:
        return [f"_m_{w.name}" for w in self.minute_windows]


def reading_partials(anchored: DataFrame, reading: DataFrame, layout: ReadingLayout, *, user_col: str = "user_id",
                     anchor_col: str = "reg_sub_start_time", book_col: str = "book_id", date_col: str = "read_date",
                     minutes_col: str = "reading_minutes") -> DataFrame:
    """One row per (user, book): masks of atoms, days and calendar weeks, minutes per window."""
    if not layout.every:
        raise ValueError("no windows requested")
    # exact sums, so that neither order nor rounding decides a threshold
    parts = (F.col(minutes_col).cast(MINUTES_TYPE) * F.lit(MINUTE_PARTS)).cast("bigint")
    facts = reading.select(user_col, book_col, date_col, parts.alias(minutes_col))
    rows = _with_offsets(facts, _anchors(anchored, user_col, anchor_col), user_col, date_col, *layout.span)
    inner: list[str] = []
    if layout.book_windows:
        inner += [f"bit_or({sql}) AS {c}" for sql, c in zip(atom_bit_sql(_OFFSET, layout.runs), layout.book_words())]
    if layout.day_windows:
        lo, n = layout.days
        where = f"{_OFFSET} BETWEEN {lo} AND {lo + n - 1}"
        inner += [f"bit_or({sql}) AS {c}" for sql, c in zip(position_bit_sql(f"({_OFFSET} - {lo})", n, where), layout.day_words())]
    for w in layout.calendar_week_windows:
        # calendar weeks counted from the Monday on or before the window's first day
        cw = (f"CAST(floor(datediff(CAST(date_trunc('week', {date_col}) AS DATE), "
              f"CAST(date_trunc('week', date_add({_ANCHOR_DAY}, {w.lo})) AS DATE)) / 7) AS INT)")
        inner += [f"bit_or({sql}) AS {c}" for sql, c in zip(position_bit_sql(cw, layout.weeks(w), _in(w)), layout.week_words(w))]
    for w in layout.minute_windows:
        inner.append(f"sum(CASE WHEN {_in(w)} THEN {minutes_col} END) AS _m_{w.name}")
    return rows.groupBy(user_col, book_col).agg(*[E(x) for x in inner])


def merge_reading(parts: Sequence[DataFrame], layout: ReadingLayout, user_col: str = "user_id", book_col: str = "book_id") -> DataFrame:
    """Partial rows of disjoint facts put together: a row per (user, book) again."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    merged = [f"bit_or({c}) AS {c}" for c in layout.masks()] + [f"sum({c}) AS {c}" for c in layout.sums()]
    return out.groupBy(user_col, book_col).agg(*[E(x) for x in merged])


def reading_metrics(anchored: DataFrame, partials: DataFrame, layout: ReadingLayout, user_col: str = "user_id", book_col: str = "book_id") -> DataFrame:
    """The columns of ``reading_windows`` from partial rows."""
    outer: list[str] = []
    counts: list[str] = []
    for w in layout.book_windows:
        test = meets_sql(layout.book_words(), atom_words(w, layout.runs))
        outer.append(f"count(CASE WHEN {book_col} IS NOT NULL AND {test} THEN 1 END) AS book_read_{w.name}")
        counts.append(f"book_read_{w.name}")
    for w in layout.minute_windows:
        outer.append(f"sum(_m_{w.name}) / {MINUTE_PARTS}D AS reading_mins_{w.name}")
    outer += [f"bit_or({c}) AS {c}" for c in layout.masks() if c not in layout.book_words()]
    per_user = partials.groupBy(user_col).agg(*[E(x) for x in outer])

    cols = [user_col] + [f"book_read_{w.name}" for w in layout.book_windows] + [f"reading_mins_{w.name}" for w in layout.minute_windows]
    lo, n = layout.days
    for w in layout.day_windows:
        cols.append(f"{count_sql(layout.day_words(), span_words(w.lo - lo, w.hi - lo, n))} AS reading_days_{w.name}")
        counts.append(f"reading_days_{w.name}")
    for w in layout.calendar_week_windows:
        cols.append(f"{count_sql(layout.week_words(w), span_words(0, layout.weeks(w) - 1, layout.weeks(w)))} AS reading_weeks_{w.name}")
        counts.append(f"reading_weeks_{w.name}")
    return _attach(anchored, user_col, per_user.selectExpr(*cols), counts)


def reading_windows(anchored: DataFrame, reading: DataFrame, *,
                    book_windows: Sequence[Window] = (),
                    minute_windows: Sequence[Window] = (),
                    day_windows: Sequence[Window] = (),
                    calendar_week_windows: Sequence[Window] = (),
                    cumulative: Sequence[Window] = (),
                    user_col: str = "user_id", anchor_col: str = "reg_sub_start_time",
                    book_col: str = "book_id", date_col: str = "read_date",
                    minutes_col: str = "reading_minutes") -> DataFrame:
    """Distinct books, minutes, distinct days and distinct calendar weeks
    per window, one row per anchored user.

    Columns: ``book_read_<w>`` (books in ``book_windows`` and ``cumulative``),
    ``reading_mins_<w>``, ``reading_days_<w>``, ``reading_weeks_<w>``.
    """
    layout = ReadingLayout((*book_windows, *cumulative), tuple(minute_windows), tuple(day_windows), tuple(calendar_week_windows))
    partials = reading_partials(anchored, reading, layout, user_col=user_col, anchor_col=anchor_col, book_col=book_col,
                                date_col=date_col, minutes_col=minutes_col)
    return reading_metrics(anchored, partials, layout, user_col, book_col)


# metric name -> (entity column, event names)
EVENT_METRICS = {
    "book_opened": ("book_id", (BOOK_OPEN_EVENT,)),
    "reading_session": ("session_id", READING_SESSION_EVENTS),
    "highlight": ("event_id", (HIGHLIGHT_EVENT,)),
    "annotation": ("event_id", (ANNOTATION_EVENT,)),
}


def _quoted(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def event_windows(anchored: DataFrame, events: DataFrame,
                  metrics: dict[str, Sequence[Window]], *,
                  user_col: str = "user_id", anchor_col: str = "reg_sub_start_time",
                  date_col: str = "event_date", name_col: str = "event_name",
                  entity_cols: dict[str, str] | None = None) -> DataFrame:
    """Distinct entities per metric and window, one row per anchored user.

    ``metrics`` maps a metric of ``EVENT_METRICS`` to its windows; columns
    are ``<metric>_<window>``. Each event row is exploded into the metric
    entities it feeds ('open book' feeds a book and a session), then
    aggregated once per (user, metric, entity).
    """
    entity_cols = entity_cols or {}
    names = list(metrics)
    every = [w for m in names for w in metrics[m]]
    lo, hi = min(w.lo for w in every), max(w.hi for w in every)
    runs = atoms(every)

    used = {entity_cols.get(m, EVENT_METRICS[m][0]) for m in names}
    facts = events.select(user_col, date_col, name_col, *sorted(used))
    types = dict(facts.dtypes)
    rows = _with_offsets(facts, _anchors(anchored, user_col, anchor_col), user_col, date_col, lo, hi)

    entries = []
    for k, m in enumerate(names):
        col_name, event_names = EVENT_METRICS[m]
        key = entity_cols.get(m, col_name)
        num, txt = ("CAST(NULL AS BIGINT)", key) if types[key] == "string" else (f"CAST({key} AS BIGINT)", "CAST(NULL AS STRING)")
        entries.append(f"CASE WHEN {name_col} IN ({_quoted(event_names)}) AND {key} IS NOT NULL "
                       f"THEN named_struct('kind', {k}, 'num', {num}, 'txt', {txt}) END")
    words = word_names("_mask", len(runs))
    exploded = (rows.selectExpr(user_col, _OFFSET, f"explode(array_compact(array({', '.join(entries)}))) AS _e")
                .selectExpr(user_col, _OFFSET, "_e.kind", "_e.num", "_e.txt"))
    per_entity = exploded.groupBy(user_col, "kind", "num", "txt").agg(
        *[E(f"bit_or({sql}) AS {c}") for sql, c in zip(atom_bit_sql(_OFFSET, runs), words)])

    outer, counts = [], []
    for k, m in enumerate(names):
        for w in metrics[m]:
            name = f"{m}_{w.name}"
            outer.append(f"count(CASE WHEN kind = {k} AND {meets_sql(words, atom_words(w, runs))} THEN 1 END) AS {name}")
            counts.append(name)
    per_user = per_entity.groupBy(user_col).agg(*[E(x) for x in outer])
    return _attach(anchored, user_col, per_user, counts)
