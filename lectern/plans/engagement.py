"""The engagement reports (v1, v2, v3) and the learning KPI report.

The whole report is one DataFrame plan: the anchored users feed the reading
branch, the event branch and the final join, and Spark's exchange reuse
shares their shuffle instead of recomputing it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (ENGAGEMENT_EVENTS, SHAPE_KPI, SHAPE_V1, SHAPE_V2, SHAPE_V3, ReportShape,
                      cumulative_window, day_windows, month_windows, week_windows)
from ..operators import engagement as G
from ..operators.membership import likely_members
from ..operators.windows import event_windows, reading_windows
from ..session import reliable_checkpoint

SHAPES = {1: SHAPE_V1, 2: SHAPE_V2, 3: SHAPE_V3}


def _window(name: str):
    kind, k = name[0], int(name[1:])
    return {"d": day_windows, "w": week_windows, "m": month_windows}[kind](k)[k - 1]


def reading_block(anchored: DataFrame, reading: DataFrame, shape: ReportShape,
                  anchor_col: str = "reg_sub_start_time") -> DataFrame:
    """Reading metrics of one report shape, in the reference's column order."""
    days = day_windows(7) if shape.daily else []
    weeks = week_windows(shape.weeks)
    months = month_windows(shape.months)
    active = weeks[:4] + months[:1] if shape.active_days else []
    cum = [cumulative_window(shape.months)] if shape.cumulative else []
    win = reading_windows(anchored, reading, book_windows=days + weeks + months,
                          minute_windows=days + weeks + months, day_windows=active,
                          calendar_week_windows=months[:1] if shape.active_days else [],
                          cumulative=cum, anchor_col=anchor_col)
    order: list[str] = []
    for d in days:
        order += [f"book_read_{d.name}", f"reading_mins_{d.name}"]
    for j, m in enumerate(months, start=1):
        for w in weeks[4 * (j - 1):4 * j]:
            order += [f"book_read_{w.name}", f"reading_mins_{w.name}"]
            if shape.active_days and j == 1:
                order.append(f"reading_days_{w.name}")
        order += [f"reading_mins_{m.name}", f"book_read_{m.name}"]
        if shape.active_days and j == 1:
            order += [f"reading_days_{m.name}", f"reading_weeks_{m.name}"]
    order += [f"book_read_{c.name}" for c in cum]
    return win.select("user_id", *order)


def event_block(anchored: DataFrame, events: DataFrame, shape: ReportShape,
                anchor_col: str = "reg_sub_start_time") -> DataFrame:
    ev = [_window(n) for n in shape.event_windows]
    sessions = month_windows(shape.session_months) if shape.session_months else []
    metrics = {"book_opened": ev, "reading_session": ev + [m for m in sessions if m.name not in shape.event_windows],
               "highlight": ev, "annotation": ev}
    win = event_windows(anchored, events, metrics, anchor_col=anchor_col)
    order = [f"{m}_{w.name}" for w in ev for m in ("book_opened", "reading_session", "highlight", "annotation")]
    order += [f"reading_session_{m.name}" for m in sessions if m.name not in shape.event_windows]
    return win.select(F.col("user_id").alias("user_id_ref"), *order)


def engagement_report(users: DataFrame, countries: DataFrame, subs: DataFrame, reading: DataFrame,
                      events: DataFrame, *, as_of, since, country_in: Sequence[str],
                      level: int = 3) -> DataFrame:
    """G21 (level 1), G22 (level 2), G23 (level 3)."""
    shape = SHAPES[level]
    base = G.engagement_base(users, countries, since, country_in)
    # one row per cohort user, read by both fact branches and the final join
    anchored = reliable_checkpoint(G.anchor(base, G.tenure(subs, base, as_of)))
    # other users' facts are left behind in the scan's tasks; the windows'
    # inner join with ``anchored`` then restricts the rest exactly
    read = likely_members(G.restrict(reading, None, "read_date", since), anchored)
    evts = likely_members(G.restrict_events(events, None, since, ENGAGEMENT_EVENTS), anchored)

    block = reading_block(anchored, read, shape)
    weeks_cols = G.active_week_columns(shape.weeks)
    month_counts, month_flags = G.active_month_columns(shape.months)
    summary_read = (anchored.join(block, "user_id", "left")
                    .select(*anchored.columns, *[c for c in block.columns if c != "user_id"],
                            *weeks_cols, *month_counts, *month_flags))
    summary_event = event_block(anchored, evts, shape)
    joined = summary_read.join(summary_event, summary_read.user_id == summary_event.user_id_ref, "left")
    return joined.select(*summary_read.columns, *summary_event.columns,
                         *G.minutes_per_session_columns(shape.months))


def learning_kpi_report(users: DataFrame, subs: DataFrame, reading: DataFrame, events: DataFrame, *,
                        as_of, since, as_written: bool = True) -> DataFrame:
    """16-week learning KPIs with power months, 3+ readers and UGC flags."""
    shape = SHAPE_KPI
    base = G.kpi_base(users, since)
    ten = G.tenure(subs, base, as_of, months_col="tenure_months")
    anchored = reliable_checkpoint(G.tenure_expected(G.anchor(base, ten), as_of))
    # other users' facts are left behind in the scan's tasks; the windows'
    # inner join with ``anchored`` then restricts the rest exactly
    read = likely_members(G.restrict(reading, None, "read_date", since), anchored)
    evts = likely_members(G.restrict_events(events, None, since, ENGAGEMENT_EVENTS), anchored)

    block = reading_block(anchored, read, shape)
    head = ["registration_month", "user_id", "registration_date", "subscription_start_time",
            "subscription_end_time"]
    tail = ["reg_sub_start_time", "start_time_status", "tenure_months_expected"]
    summary_reading = (anchored.join(block, "user_id", "left")
                       .select(*head, F.coalesce(F.col("tenure_months"), F.lit(0).cast("long")).alias("tenure_months"),
                               *tail, *[c for c in block.columns if c != "user_id"]))
    summary_read = summary_reading.select(
        "*", G.three_plus_column(shape.months), *G.power_month_columns(shape.months, as_written))
    summary_event = event_block(anchored, evts, shape)
    joined = summary_read.join(summary_event, summary_read.user_id == summary_event.user_id_ref, "left")
    return joined.select(*summary_read.columns, *summary_event.columns,
                         *G.ugc_flag_columns(shape.event_windows, as_written))
