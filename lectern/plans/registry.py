"""The query registry: one callable (spark, sf_dir) -> DataFrame per key.

(``sources.catalog``) with the parameters of ``plans.params``. The full
reports (G21-G24), cohorts, ranking and dashboard read the order-derived
tables (1995-2001); the standalone window keys (G8-G20) read the
event-derived tables, where all sixteen weeks after the anchor hold data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import Tables
from . import params as P

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(key: str):
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir, derive=True))
        return fn
    return register


# -- event monitoring ---------------------------------------------------------

@query("event_catalog")
def _event_catalog(t: Tables) -> DataFrame:
    from ..operators.events import event_catalog
    return event_catalog(t.tracking, P.EVENT_CUTOFF, P.EVENT_AS_OF, limit=P.EVENT_LIMIT)


# -- engagement: cohort, tenure, anchor ---------------------------------------

def _g1(t: Tables) -> DataFrame:
    from ..operators.engagement import engagement_base
    return engagement_base(t.users, t.country_regions, P.SINCE, P.COUNTRIES)


def _g2(t: Tables) -> DataFrame:
    from ..operators.engagement import kpi_base
    return kpi_base(t.users, P.SINCE)


@query("engagement_base")
def _engagement_base(t: Tables) -> DataFrame:
    return _g1(t)


@query("kpi_base")
def _kpi_base(t: Tables) -> DataFrame:
    return _g2(t)


@query("subscription_tenure")
def _subscription_tenure(t: Tables) -> DataFrame:
    from ..operators.engagement import tenure
    return tenure(t.subscriptions, _g1(t), P.AS_OF)


@query("anchor_start")
def _anchor_start(t: Tables) -> DataFrame:
    from ..operators.engagement import anchor, tenure
    base = _g1(t)
    return anchor(base, tenure(t.subscriptions, base, P.AS_OF))


@query("tenure_expected")
def _tenure_expected(t: Tables) -> DataFrame:
    from ..operators.engagement import anchor, tenure, tenure_expected
    base = _g2(t)
    return tenure_expected(anchor(base, tenure(t.subscriptions, base, P.AS_OF, months_col="tenure_months")),
                           P.AS_OF)


@query("reading_for_cohort")
def _reading_for_cohort(t: Tables) -> DataFrame:
    from ..operators.engagement import restrict
    return restrict(t.reading_activity, _g1(t), "read_date", P.SINCE)


@query("events_for_cohort")
def _events_for_cohort(t: Tables) -> DataFrame:
    from ..operators.engagement import restrict_events
    return restrict_events(t.event_facts, _g1(t), P.SINCE)


# -- engagement: windows on the dense event-derived data -------------------------

def _dense_reading(t: Tables, **windows) -> DataFrame:
    from ..operators.windows import reading_windows
    return reading_windows(t.event_users, t.event_reading, **windows)


@query("reading_days_d1_d7")
def _reading_days(t: Tables) -> DataFrame:
    from ..config import day_windows
    d = day_windows(7)
    return _dense_reading(t, book_windows=d, minute_windows=d)


@query("reading_weeks")
def _reading_weeks(t: Tables) -> DataFrame:
    from ..config import week_windows
    w = week_windows(16)
    return _dense_reading(t, book_windows=w, minute_windows=w)


@query("reading_days_16_weeks")
def _reading_days_16_weeks(t: Tables) -> DataFrame:
    """One window per day of 16 weeks, and days counted over all of them."""
    from ..config import cumulative_window, day_windows, month_windows
    d = day_windows(112)
    return _dense_reading(t, book_windows=d, day_windows=[*month_windows(4), cumulative_window(4)])


@query("reading_weeks_by_increments")
def _reading_weeks_by_increments(t: Tables) -> DataFrame:
    """G9 from three batches, the second with days before and after those of the first; each is tried twice."""
    from pyspark.sql import functions as F

    from ..config import week_windows
    from ..operators.windows import ReadingLayout
    from ..session import scratch_path
    from .increments import ReadingState
    w = tuple(week_windows(16))
    state = ReadingState(t.spark, scratch_path(t.spark, "reading_state"), ReadingLayout(w, w))
    day = F.coalesce(F.dayofyear("read_date"), F.lit(0))
    for k in (1, 0, 2):
        for _ in range(2):
            state.add(t.event_users, t.event_reading.filter(F.floor(day / 13) % 3 == k), f"batch-{k}")
        if k == 0:
            state.compact()
    return state.metrics(t.event_users)


@query("reading_months")
def _reading_months(t: Tables) -> DataFrame:
    from ..config import month_windows
    m = month_windows(4)
    return _dense_reading(t, book_windows=m, minute_windows=m)


@query("active_reading_days")
def _active_reading_days(t: Tables) -> DataFrame:
    from ..config import month_windows, week_windows
    return _dense_reading(t, day_windows=week_windows(4) + month_windows(1),
                          calendar_week_windows=month_windows(1))


@query("cumulative_books")
def _cumulative_books(t: Tables) -> DataFrame:
    from ..config import cumulative_window
    return _dense_reading(t, cumulative=[cumulative_window(4)])


@query("active_week_flags")
def _active_week_flags(t: Tables) -> DataFrame:
    from ..config import week_windows
    from ..operators.engagement import active_week_columns
    w = week_windows(12)
    return _dense_reading(t, book_windows=w, minute_windows=w).select("user_id", *active_week_columns(12))


@query("active_month_flags")
def _active_month_flags(t: Tables) -> DataFrame:
    from ..config import week_windows
    from ..operators.engagement import active_month_columns
    w = week_windows(12)
    counts, flags = active_month_columns(3)
    return _dense_reading(t, book_windows=w, minute_windows=w).select("user_id", *counts, *flags)


@query("power_months")
def _power_months(t: Tables) -> DataFrame:
    from ..config import week_windows
    from ..operators.engagement import power_month_columns
    w = week_windows(16)
    win = _dense_reading(t, minute_windows=w)
    return win.select("user_id", *power_month_columns(4))


@query("three_plus_readers")
def _three_plus(t: Tables) -> DataFrame:
    from ..config import cumulative_window
    from ..operators.engagement import three_plus_column
    return _dense_reading(t, cumulative=[cumulative_window(4)]).select("user_id", three_plus_column(4))


def _dense_events(t: Tables, shape_windows=("d1", "w1", "w2", "w3", "w4", "m1")) -> DataFrame:
    from .engagement import _window
    from ..operators.windows import event_windows
    ev = [_window(n) for n in shape_windows]
    metrics = {"book_opened": ev, "reading_session": ev, "highlight": ev, "annotation": ev}
    return event_windows(t.event_users, t.event_facts, metrics)


@query("event_windows")
def _event_windows(t: Tables) -> DataFrame:
    return _dense_events(t)


@query("session_months")
def _session_months(t: Tables) -> DataFrame:
    from ..config import month_windows
    from ..operators.windows import event_windows
    return event_windows(t.event_users, t.event_facts, {"reading_session": month_windows(3)})


@query("ugc_flags")
def _ugc_flags(t: Tables) -> DataFrame:
    from ..operators.engagement import ugc_flag_columns
    return _dense_events(t).select("user_id", *ugc_flag_columns())


@query("minutes_per_session")
def _minutes_per_session(t: Tables) -> DataFrame:
    from ..config import month_windows
    from ..operators.engagement import minutes_per_session_columns
    from ..operators.windows import event_windows
    m = month_windows(3)
    mins = _dense_reading(t, minute_windows=m)
    sess = event_windows(t.event_users, t.event_facts, {"reading_session": m})
    return mins.join(sess, "user_id").select("user_id", *minutes_per_session_columns(3))


# -- engagement: whole reports --------------------------------------------------

def _report(t: Tables, level: int) -> DataFrame:
    from .engagement import engagement_report
    return engagement_report(t.users, t.country_regions, t.subscriptions, t.reading_activity, t.report_events,
                             as_of=P.AS_OF, since=P.SINCE, country_in=P.COUNTRIES, level=level)


@query("engagement_report_v1")
def _report_v1(t: Tables) -> DataFrame:
    return _report(t, 1)


@query("engagement_report_v2")
def _report_v2(t: Tables) -> DataFrame:
    return _report(t, 2)


@query("engagement_report_v3")
def _report_v3(t: Tables) -> DataFrame:
    return _report(t, 3)


@query("learning_kpi_report")
def _learning_kpi(t: Tables) -> DataFrame:
    from .engagement import learning_kpi_report
    return learning_kpi_report(t.users, t.subscriptions, t.reading_activity, t.report_events,
                               as_of=P.AS_OF, since=P.SINCE)


@query("engagement_report_published")
def _report_published(t: Tables) -> DataFrame:
    """G23 as a table by month of registration; the months from the middle on are then published again."""
    from pyspark.sql import functions as F

    from ..session import reliable_checkpoint, scratch_path
    from ..sources.published import Published
    report = reliable_checkpoint(_report(t, 3))
    table = Published(t.spark, scratch_path(t.spark, "report_v3"))
    table.create(report, ["registration_month"])
    table.publish(report.filter(F.col("registration_month") >= P.AGAIN_FROM), ["registration_month"])
    return table.read()


# -- book ranking ---------------------------------------------------------------

def _rank_inputs(t: Tables) -> dict:
    return dict(meta=t.book_meta, registrations=t.registrations, subs=t.subscriptions,
                reading=t.reading_activity, clicks=t.landing_pages, matches=t.academic_matches)


@query("active_books")
def _active_books(t: Tables) -> DataFrame:
    from ..operators.ranking import active_books
    return active_books(t.book_meta)


@query("market_users")
def _market_users(t: Tables) -> DataFrame:
    from ..operators.ranking import market_users
    return market_users(t.registrations, P.MARKETS)


@query("dtc_revenue")
def _dtc_revenue(t: Tables) -> DataFrame:
    from ..operators.ranking import dtc_revenue, market_users
    return dtc_revenue(t.registrations, t.subscriptions, market_users(t.registrations, P.MARKETS), P.AS_OF,
                       max_markets=len(P.MARKETS))


@query("minmax_score")
def _minmax_score(t: Tables) -> DataFrame:
    from ..functions.scoring import minmax_score
    from ..operators.ranking import market_users, months_back
    from pyspark.sql import functions as F
    reading = t.reading_activity
    recent = reading.filter(reading.read_date >= F.lit(str(months_back(P.AS_OF, 6))).cast("date"))
    per_book = (recent.join(market_users(t.registrations, P.MARKETS), "user_id")
                .groupBy("market", "book_id").agg(F.round(F.sum("reading_minutes"), 6).alias("reading_mins")))
    return minmax_score(per_book, "reading_mins", "norm_reading_mins", ["market"], max_groups=len(P.MARKETS))


@query("readership_bayes")
def _readership(t: Tables) -> DataFrame:
    from ..operators.ranking import market_users, readership
    return readership(t.reading_activity, market_users(t.registrations, P.MARKETS), P.AS_OF,
                      max_markets=len(P.MARKETS))


@query("search_interest")
def _interest(t: Tables) -> DataFrame:
    from ..operators.ranking import market_table, search_interest
    return search_interest(t.landing_pages, market_table(t.spark, P.MARKETS), max_markets=len(P.MARKETS))


@query("newness")
def _newness(t: Tables) -> DataFrame:
    from ..operators.ranking import active_books, newness
    return newness(active_books(t.book_meta))


@query("academic_mandate")
def _mandate(t: Tables) -> DataFrame:
    from ..operators.ranking import academic_mandate
    return academic_mandate(t.academic_matches)


@query("score_consolidate")
def _consolidate(t: Tables) -> DataFrame:
    from .ranking import scored_books
    return scored_books(**_rank_inputs(t), markets=P.MARKETS, as_of=P.AS_OF)


@query("overall_rank")
def _overall(t: Tables) -> DataFrame:
    from ..operators.ranking import overall_rank
    from .ranking import scored_books
    return overall_rank(scored_books(**_rank_inputs(t), markets=P.MARKETS, as_of=P.AS_OF),
                        max_markets=len(P.MARKETS))


def _market_rank_key(name: str):
    def run(t: Tables) -> DataFrame:
        from .ranking import market_rank
        return market_rank(**_rank_inputs(t), markets=[P.MARKET_BY_NAME[name]], as_of=P.AS_OF)
    return run


for _m in P.MARKETS:
    query(f"market_rank_{_m.name}")(_market_rank_key(_m.name))


@query("market_rank_all")
def _market_rank_all(t: Tables) -> DataFrame:
    from .ranking import market_rank
    return market_rank(**_rank_inputs(t), markets=P.MARKETS, as_of=P.AS_OF)


@query("market_rank_published")
def _market_rank_published(t: Tables) -> DataFrame:
    """R12 as a table by market."""
    from .ranking import market_rank
    from ..session import scratch_path
    from ..sources.published import Published
    table = Published(t.spark, scratch_path(t.spark, "market_rank"))
    table.publish(market_rank(**_rank_inputs(t), markets=P.MARKETS, as_of=P.AS_OF), ["local_index"])
    return table.read()


# -- sources and sinks ----------------------------------------------------------

@query("source_scan")
def _source_scan(t: Tables) -> DataFrame:
    return t.book_meta


@query("source_profile")
def _source_profile(t: Tables) -> DataFrame:
    """S1 over every logical table: columns, types, rows, values."""
    from ..sources.mapping import profile, resolve
    from ..sources.schemas import LOGICAL_SCHEMAS
    return profile({name: resolve(getattr(t, name), name) for name in LOGICAL_SCHEMAS})


@query("ctas_sink")
def _ctas_sink(t: Tables) -> DataFrame:
    from ..session import scratch_path
    from ..sources.sinks import write_new
    return write_new(_c3(t), scratch_path(t.spark, "cohort_refine"))


@query("schema_append_sink")
def _schema_append_sink(t: Tables) -> DataFrame:
    from ..session import scratch_path
    from ..sources.schemas import COHORT_TABLE_SCHEMA
    from ..sources.sinks import append_positional
    return append_positional(_c3(t), scratch_path(t.spark, "cohort_reference"), COHORT_TABLE_SCHEMA)


@query("cohort_enrich_bucketed")
def _cohort_enrich_bucketed(t: Tables) -> DataFrame:
    """C3 over user tables kept in buckets by user."""
    import uuid

    from ..operators.cohorts import enrich_cohort, label_cohorts, rollup_subscriptions
    from ..sources.sinks import write_bucketed
    run, n = uuid.uuid4().hex, int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    regs, disc, subs = (write_bucketed(getattr(t, name), f"lectern_{name}_{run}", "user_id", n)
                        for name in ("registrations", "disciplines", "subscriptions"))
    return enrich_cohort(label_cohorts(regs, P.COHORTS), disc, rollup_subscriptions(subs))


@query("cohort_append_repeated")
def _cohort_append_repeated(t: Tables) -> DataFrame:
    """S3 by batches of a cohort year, each tried twice."""
    from pyspark.sql import functions as F

    from ..session import reliable_checkpoint, scratch_path
    from ..sources.schemas import COHORT_TABLE_SCHEMA
    from ..sources.sinks import append_batch
    rows, path = reliable_checkpoint(_c3(t)), scratch_path(t.spark, "cohort_batches")
    for year in sorted({c[2] for c in P.COHORTS}) * 2:
        out = append_batch(rows.filter(F.col("cohort_year") == year), path, COHORT_TABLE_SCHEMA, f"year-{year}")
    return out


# -- retention cohorts -------------------------------------------------------------

def _c1(t: Tables) -> DataFrame:
    from ..operators.cohorts import label_cohorts
    return label_cohorts(t.registrations, P.COHORTS)


def _c2(t: Tables) -> DataFrame:
    from ..operators.cohorts import rollup_subscriptions
    return rollup_subscriptions(t.subscriptions)


def _c3(t: Tables) -> DataFrame:
    from ..operators.cohorts import enrich_cohort
    return enrich_cohort(_c1(t), t.disciplines, _c2(t))


@query("cohort_label")
def _cohort_label(t: Tables) -> DataFrame:
    return _c1(t)


@query("subscription_rollup")
def _subscription_rollup(t: Tables) -> DataFrame:
    return _c2(t)


@query("cohort_enrich")
def _cohort_enrich(t: Tables) -> DataFrame:
    return _c3(t)


COHORT_FILTERS = dict(cohort_month=["Jan"], user_persona=["BUILDING", "MACHINERY", "AUTOMOBILE"],
                      academic_discipline=["BUILDING", "MACHINERY", "Unknown"], region=None,
                      user_type=None, platform=None)


@query("cohort_filter")
def _cohort_filter(t: Tables) -> DataFrame:
    from ..operators.cohorts import filter_cohort
    return filter_cohort(_c3(t), **COHORT_FILTERS)


@query("reading_list_extract")
def _reading_list(t: Tables) -> DataFrame:
    from ..operators.cohorts import reading_list
    return reading_list(t.book_matches, t.cleanup)


def _c6(t: Tables) -> DataFrame:
    from ..operators.cohorts import extract_range
    return extract_range(t.reading_activity, "read_date", *P.READING_RANGE)


def _c7(t: Tables) -> DataFrame:
    from ..operators.cohorts import extract_events
    return extract_events(t.event_facts, *P.EVENT_RANGE)


@query("reading_window_extract")
def _reading_window(t: Tables) -> DataFrame:
    return _c6(t)


@query("session_event_extract")
def _session_events(t: Tables) -> DataFrame:
    return _c7(t)


# -- retention dashboard -------------------------------------------------------------

@query("ard_distribution")
def _ard_distribution(t: Tables) -> DataFrame:
    from ..operators.dashboard import ard_distribution
    return ard_distribution(_c6(t))


@query("ard_daily_segment")
def _ard_daily(t: Tables) -> DataFrame:
    from ..operators.dashboard import ard_daily
    return ard_daily(_c6(t))


@query("readers_by_sub_week")
def _readers_by_week(t: Tables) -> DataFrame:
    from ..operators.dashboard import readers_by_week
    return readers_by_week(_c6(t), _c3(t))


@query("readers_by_sub_week_of_all")
def _readers_of_all(t: Tables) -> DataFrame:
    """D3 for all cohorts together, from the bitmaps of the single ones."""
    from ..operators.dashboard import reader_bitmaps, readers_from_bitmaps
    from ..session import reliable_checkpoint
    return readers_from_bitmaps(reliable_checkpoint(reader_bitmaps(_c6(t), _c3(t))), ["sub_week"])


@query("ars_distribution")
def _ars_distribution(t: Tables) -> DataFrame:
    from ..operators.dashboard import ars_distribution
    return ars_distribution(_c7(t))


@query("sessions_by_sub_week")
def _sessions_by_week(t: Tables) -> DataFrame:
    from ..operators.dashboard import sessions_by_week
    return sessions_by_week(_c7(t), _c3(t))
