"""Edge rows of the engagement windows (FIXTURES.md §4)."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import cumulative_window, day_windows, month_windows, week_windows
from lectern.operators import engagement as G
from lectern.operators.windows import event_windows, reading_windows

ANCHOR = dt.datetime(2023, 9, 4, 10, 0)
D0 = dt.date(2023, 9, 4)


def anchors(spark, users=(1,)):
    schema = "user_id long, reg_sub_start_time timestamp_ntz"
    return spark.createDataFrame([(u, ANCHOR) for u in users], schema)


def reads(spark, rows):
    return spark.createDataFrame(rows, "user_id long, book_id long, read_date date, reading_minutes double")


def day(n):
    return D0 + dt.timedelta(days=n)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_window_edges(spark):
    r = reads(spark, [(1, 10, day(-1), 5.0), (1, 11, day(0), 5.0), (1, 12, day(6), 5.0), (1, 13, day(7), 5.0)])
    w = week_windows(2)
    out = one(reading_windows(anchors(spark), r, book_windows=w, minute_windows=w))
    assert out["book_read_w1"] == 2 and out["book_read_w2"] == 1
    assert out["reading_mins_w1"] == 10.0 and out["reading_mins_w2"] == 5.0


def test_last_day_v3_and_kpi(spark):
    r = reads(spark, [(1, b, day(o), 1.0) for b, o in [(1, 83), (2, 84), (3, 111), (4, 112)]])
    out = one(reading_windows(anchors(spark), r, cumulative=[cumulative_window(3), cumulative_window(4)]))
    assert out["book_read_m1_to_m3"] == 1
    assert out["book_read_m1_to_m4"] == 3


def test_overlap_counts_once_per_window(spark):
    r = reads(spark, [(1, 7, day(1), 1.0), (1, 7, day(8), 1.0)])
    w, m = week_windows(2), month_windows(1)
    out = one(reading_windows(anchors(spark), r, book_windows=w + m, cumulative=[cumulative_window(3)]))
    assert (out["book_read_w1"], out["book_read_w2"], out["book_read_m1"], out["book_read_m1_to_m3"]) == (1, 1, 1, 1)


def test_no_reads_gives_zero_counts_null_minutes_false_flags(spark):
    r = reads(spark, [(2, 1, day(0), 9.0)])
    w = week_windows(4)
    win = reading_windows(anchors(spark, (1,)), r, book_windows=w, minute_windows=w)
    out = one(win.select("user_id", "book_read_w1", "reading_mins_w1", *G.active_week_columns(4)))
    assert out["book_read_w1"] == 0 and out["reading_mins_w1"] is None
    assert out["active_w1"] == 0 and out["active_flag_w1"] is False


def test_active_week_threshold(spark):
    r = reads(spark, [(1, 1, day(0), 5.0), (2, 1, day(0), 4.9)])
    w = week_windows(4)
    win = reading_windows(anchors(spark, (1, 2)), r, book_windows=w, minute_windows=w)
    flags = {row.user_id: row.active_flag_w1 for row in win.select("user_id", *G.active_week_columns(4)).collect()}
    assert flags == {1: True, 2: False}


def test_active_month_needs_two_weeks(spark):
    r = reads(spark, [(1, 1, day(0), 5.0), (1, 1, day(7), 5.0), (2, 1, day(0), 5.0)])
    w = week_windows(12)
    win = reading_windows(anchors(spark, (1, 2)), r, book_windows=w, minute_windows=w)
    counts, flags = G.active_month_columns(3)
    got = {row.user_id: row.active_wk_flag_m1 for row in win.select("user_id", *counts, *flags).collect()}
    assert got == {1: True, 2: False}


def _power(spark, rows, as_written):
    w = week_windows(16)
    win = reading_windows(anchors(spark), reads(spark, rows), minute_windows=w)
    return one(win.select(*G.power_month_columns(4, as_written)))["power_active_m1"]


def test_quirk_q1_power_month(spark):
    only_w3 = [(1, 1, day(14), 72.0)]
    w1_w4 = [(1, 1, day(0), 72.0), (1, 1, day(21), 72.0)]
    assert _power(spark, only_w3, True) == 1 and _power(spark, only_w3, False) == 0
    assert _power(spark, w1_w4, True) == 0 and _power(spark, w1_w4, False) == 1


def events(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_id long, event_name string, event_date date, "
                                       "session_id string, book_id int")


def test_quirk_q2_and_book_opening_ignored(spark):
    ev = events(spark, [(1, 1, "highlight creation", day(21), "s1", 5),
                        (1, 2, "annotation creation", day(14), "s1", 5),
                        (1, 3, "book opening", day(0), "s2", 6)])
    wins = [day_windows(1)[0]] + week_windows(4) + month_windows(1)
    metrics = {m: wins for m in ("book_opened", "reading_session", "highlight", "annotation")}
    out = one(event_windows(anchors(spark), ev, metrics).select("*", *G.ugc_flag_columns()))
    assert out["ugc_w4_flag"] is True
    assert out["book_opened_w1"] == 0 and out["reading_session_w1"] == 0
    fixed = one(event_windows(anchors(spark), ev, metrics).select(*G.ugc_flag_columns(as_written=False)))
    assert fixed["ugc_w4_flag"] is False


def test_sessions_zero_gives_null_ratio(spark):
    r = reads(spark, [(1, 1, day(0), 30.0)])
    m = month_windows(3)
    mins = reading_windows(anchors(spark), r, minute_windows=m)
    sess = event_windows(anchors(spark), events(spark, [(9, 1, "open book", day(0), "s", 1)]), {"reading_session": m})
    out = one(mins.join(sess, "user_id").select(*G.minutes_per_session_columns(3)))
    assert out["reading_mins_per_session_m1"] is None


def subs(spark, rows):
    return spark.createDataFrame(rows, "user_id long, subscription_type string, subscription_start_time timestamp_ntz, "
                                       "subscription_end_time date")


def base(spark, users=(1,)):
    return spark.createDataFrame([(u, dt.date(2023, 8, 1)) for u in users], "user_id long, registration_date date")


def test_tenure_sentinel_no_start_trial_and_month_end(spark):
    s = subs(spark, [(1, "subscribed", dt.datetime(2023, 9, 4), dt.date(9999, 12, 31)),
                     (2, "subscribed", None, dt.date(2023, 12, 1)),
                     (3, "trial", dt.datetime(2023, 9, 4), dt.date(2023, 12, 1)),
                     (4, "subscribed", dt.datetime(2024, 1, 30), dt.date(2024, 2, 29))])
    ten = {r.user_id: r for r in G.tenure(s, base(spark, (1, 2, 3, 4)), dt.date(2024, 1, 3)).collect()}
    assert ten[1].tenure_months_todate == 3
    assert ten[2].tenure_months_todate == 0 and ten[2].subscription_start_time is None
    assert 3 not in ten
    assert ten[4].tenure_months_todate == 0
    anchored = {r.user_id: r for r in G.anchor(base(spark, (1, 2, 3)),
                                               G.tenure(s, base(spark, (1, 2, 3)), dt.date(2024, 1, 3))).collect()}
    assert anchored[1].start_time_status == "sub"
    assert anchored[2].start_time_status == "reg" and anchored[3].start_time_status == "reg"
    assert anchored[2].reg_sub_start_time == dt.datetime(2023, 8, 1)


def test_unknown_country_dropped(spark):
    users = spark.createDataFrame(
        [(1, dt.date(2023, 9, 1), "direct", True, True, "p", None, 1), (2, dt.date(2023, 9, 1), "x", True, True, "p", None, 99)],
        "user_id long, registration_date date, payment_model string, is_converted_subscribed boolean, "
        "is_converted_paid boolean, user_persona string, referrer_book_id long, country_id int")
    countries = spark.createDataFrame([(1, "United Kingdom", "Europe", "UK", "r")],
                                      "country_id int, country string, continent string, market string, region string")
    out = G.engagement_base(users, countries, dt.date(2023, 8, 1), ["united kingdom"]).collect()
    assert [r.user_id for r in out] == [1] and out[0].user_type == "d2c"
    assert out[0].registration_month == dt.date(2023, 9, 1)


def test_bitmask_equals_literal_distinct(spark):
    """Random reads: bitmask windows equal literal count(distinct case ...)."""
    import random
    rnd = random.Random(7)
    rows = [(rnd.randint(1, 20), rnd.choice([None] + list(range(15))), day(rnd.randint(-5, 120)),
             float(rnd.randint(0, 30))) for _ in range(3000)]
    r = reads(spark, rows)
    a = anchors(spark, range(1, 23))
    wins = day_windows(7) + week_windows(16) + month_windows(4)
    got = reading_windows(a, r, book_windows=wins, cumulative=[cumulative_window(4)],
                          day_windows=week_windows(4) + month_windows(1), calendar_week_windows=month_windows(1))
    anchor_day = F.to_date("reg_sub_start_time")
    joined = a.join(r, "user_id", "left")
    exprs = []
    for w in wins + [cumulative_window(4)]:
        inside = F.col("read_date").between(F.date_add(anchor_day, w.lo), F.date_add(anchor_day, w.hi))
        exprs.append(F.countDistinct(F.when(inside, F.col("book_id"))).alias(f"book_read_{w.name}"))
    for w in week_windows(4) + month_windows(1):
        inside = F.col("read_date").between(F.date_add(anchor_day, w.lo), F.date_add(anchor_day, w.hi))
        exprs.append(F.countDistinct(F.when(inside, F.col("read_date"))).alias(f"reading_days_{w.name}"))
    m1 = F.col("read_date").between(anchor_day, F.date_add(anchor_day, 27))
    exprs.append(F.countDistinct(F.when(m1, F.date_trunc("week", "read_date"))).alias("reading_weeks_m1"))
    literal = joined.groupBy("user_id").agg(*exprs)
    cols = literal.columns
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, literal.select(*cols).collect()))


def test_bitmask_exact_for_random_window_sets(spark):
    """Atoms make any set of windows exact, not only aligned weeks and months."""
    import random
    from lectern.config import Window
    rnd = random.Random(11)
    rows = [(rnd.randint(1, 12), rnd.choice([None] + list(range(10))), day(rnd.randint(-3, 70)), 1.0)
            for _ in range(1500)]
    r = reads(spark, rows)
    a = anchors(spark, range(1, 14))
    for trial in range(2):
        wins = []
        for k in range(6):
            lo = rnd.randint(0, 50)
            wins.append(Window(f"x{trial}_{k}", lo, lo + rnd.randint(0, 20)))
        got = reading_windows(a, r, book_windows=wins)
        anchor_day = F.to_date("reg_sub_start_time")
        literal = a.join(r, "user_id", "left").groupBy("user_id").agg(*[
            F.countDistinct(F.when(F.col("read_date").between(F.date_add(anchor_day, w.lo), F.date_add(anchor_day, w.hi)),
                                   F.col("book_id"))).alias(f"book_read_{w.name}") for w in wins])
        cols = literal.columns
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, literal.select(*cols).collect()))


def test_minutes_just_below_the_threshold_are_not_active(spark):
    from lectern.operators.engagement import active_week_columns
    reads = spark.createDataFrame([(1, 5, dt.date(2024, 1, 2), 4.9999996), (2, 5, dt.date(2024, 1, 2), 5.0)],
                                  "user_id long, book_id long, read_date date, reading_minutes double")
    anchors = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 1))],
                                    "user_id long, reg_sub_start_time timestamp_ntz")
    from lectern.config import week_windows
    from lectern.operators.windows import reading_windows
    w = week_windows(1)
    got = {r.user_id: r.active_w1 for r in reading_windows(anchors, reads, book_windows=w, minute_windows=w)
           .select("user_id", *active_week_columns(1)).collect()}
    assert got == {1: 0, 2: 1}
