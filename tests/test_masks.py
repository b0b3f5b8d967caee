"""Masks of any length, cohort bitmaps and increments, against literal forms."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from lectern.config import Window, cumulative_window, day_windows, week_windows
from lectern.functions.masks import WORD_BITS, atom_words, atoms, span_words
from lectern.operators.membership import likely_members, member_bitmap
from lectern.operators.windows import ReadingLayout, event_windows, reading_windows
from lectern.plans.increments import ReadingState

D0 = dt.date(2024, 1, 3)


def facts(spark, n=4000, users=12, days=140, seed=3):
    r = random.Random(seed)
    rows = [(r.randint(1, users), r.choice([None, *range(1, 40)]), D0 + dt.timedelta(days=r.randint(-10, days)), r.choice([0.1, 0.25, 3.0, 7.75])) for _ in range(n)]
    return spark.createDataFrame(rows, "user_id long, book_id long, read_date date, reading_minutes double")


def anchors(spark, users=14):
    return spark.createDataFrame([(u, D0 + dt.timedelta(days=u % 5)) for u in range(1, users + 1)], "user_id long, reg_sub_start_time date")


def literal(anchored, reading, windows):
    off = F.datediff("read_date", "reg_sub_start_time")
    inside = lambda w: off.between(w.lo, w.hi)
    joined = anchored.join(reading, "user_id", "left").groupBy("user_id")
    aggs = []
    for w in windows:
        aggs += [F.countDistinct(F.when(inside(w), F.col("book_id"))).alias(f"book_read_{w.name}"),
                 F.countDistinct(F.when(inside(w), F.col("read_date"))).alias(f"reading_days_{w.name}"),
                 F.countDistinct(F.when(inside(w), F.trunc("read_date", "week"))).alias(f"reading_weeks_{w.name}")]
    return joined.agg(*aggs)


def test_words_cover_all_bits():
    runs = atoms(day_windows(200))
    assert len(runs) == 200 and len(atom_words(Window("x", 0, 199), runs)) == 4
    assert sum(bin(w).count("1") for w in atom_words(Window("x", 60, 130), runs)) == 71
    assert span_words(62, 64, 70) == [1 << 62, 0b11] and WORD_BITS == 63


def test_112_daily_windows_equal_literal_counts(spark):
    windows = [*day_windows(112), Window("late", 60, 112), cumulative_window(4)]
    out = reading_windows(anchors(spark), facts(spark), book_windows=windows, day_windows=windows, calendar_week_windows=windows[-2:])
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text
    want = literal(anchors(spark), facts(spark), windows)
    assert sorted(out.collect()) == sorted(want.select(*out.columns).collect())


def test_calendar_weeks_over_more_than_63(spark):
    w = [Window("years", 0, 900)]
    reading = facts(spark, days=1000)
    out = reading_windows(anchors(spark), reading, calendar_week_windows=w, day_windows=w)
    assert sorted(out.collect()) == sorted(literal(anchors(spark), reading, w).select(*out.columns).collect())


def test_event_windows_past_63_atoms(spark):
    r = random.Random(4)
    rows = [(r.randint(1, 5), k, "open book", D0 + dt.timedelta(days=r.randint(0, 100)), f"s{r.randint(0, 60)}", r.randint(1, 30)) for k in range(900)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, event_name string, event_date date, session_id string, book_id int")
    windows = day_windows(90)
    out = event_windows(anchors(spark, 6), events, {"book_opened": windows, "reading_session": windows})
    joined = anchors(spark, 6).join(events, "user_id", "left").withColumn("o", F.datediff("event_date", "reg_sub_start_time"))
    want = joined.groupBy("user_id").agg(*[F.countDistinct(F.when(F.col("o").between(w.lo, w.hi), F.col(c))).alias(f"{m}_{w.name}")
                                           for m, c in (("book_opened", "book_id"), ("reading_session", "session_id")) for w in windows])
    assert sorted(out.collect()) == sorted(want.select(*out.columns).collect())


@pytest.mark.parametrize("words", [1, 16, 1 << 20])
def test_no_member_is_lost(spark, words):
    cohort = spark.createDataFrame([(u,) for u in (3, 5, 5, None, 700)], "user_id long")
    given = spark.range(1000).selectExpr("id AS user_id", "id * 2 AS v", "CAST(id AS STRING) AS text").union(spark.sql("SELECT CAST(NULL AS BIGINT), 0L, ''"))
    got = likely_members(given, cohort, words=words)
    assert got.columns == given.columns
    rows = [r.user_id for r in got.collect()]
    assert {3, 5, 700} <= set(rows) and len(rows) == len(set(rows))
    assert member_bitmap(cohort, words=words).count() <= words
    if words == 1 << 20:
        assert sorted(rows) == [3, 5, 700]
    assert likely_members(given, cohort.limit(0), words=words).count() == 0


def test_reports_leave_other_users_facts_behind(spark):
    """The bitmap's test stands below the first exchange of the facts, and few others pass it."""
    import __spark_entry__ as entry
    from conftest import SMALL
    from lectern.plans import params as P
    from lectern.operators.engagement import restrict
    from lectern.sources.catalog import Tables
    df = entry.queries()["learning_kpi_report"](spark, SMALL)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in text and text.index("Aggregate [user_id") < text.index("getbit")
    t = Tables(spark, SMALL, derive=True)
    cohort = t.users.filter("user_id % 10 = 0")
    facts_ = restrict(t.reading_activity, None, "read_date", P.SINCE)
    own, near = restrict(facts_, cohort, "read_date", P.SINCE).count(), likely_members(facts_, cohort).count()
    assert own <= near <= 1.01 * own < facts_.count()


def test_increments_in_any_order_equal_one_run(spark):
    reading, who = facts(spark, seed=9), anchors(spark)
    w = tuple(week_windows(16))
    layout = ReadingLayout((*w, cumulative_window(4)), w, (cumulative_window(2),), (cumulative_window(1),))
    state = ReadingState(spark, tempfile.mkdtemp(prefix="lectern-test-") + "/state", layout)
    part = F.pmod(F.xxhash64("user_id", "book_id", "read_date", "reading_minutes"), F.lit(4))
    for k in (2, 0, 3, 0, 1):
        state.add(who, reading.filter(part == k), f"b{k}")
        if k == 3:
            state.compact()
    want = reading_windows(who, reading, book_windows=w, cumulative=[cumulative_window(4)], minute_windows=w,
                           day_windows=[cumulative_window(2)], calendar_week_windows=[cumulative_window(1)])
    assert sorted(map(repr, state.metrics(who).collect())) == sorted(map(repr, want.collect()))
    state.compact()
    state.add(who, reading, "b1")  # known: nothing happens
    assert sorted(map(repr, state.metrics(who).collect())) == sorted(map(repr, want.collect()))
