"""The dashboard decisions the prose leaves open (operators/dashboard.py)."""

import datetime as dt

from pyspark.sql import functions as F

from lectern.operators import dashboard as D

D0 = dt.date(2023, 9, 1)


def reads(spark, rows):
    return spark.createDataFrame([(u, D0 + dt.timedelta(days=o)) for u, o in rows], "user_id long, read_date date")


def test_ard_median_interpolates(spark):
    got = D.ard_distribution(reads(spark, [(1, 0), (2, 0), (2, 1)])).collect()
    assert {(r.active_reading_days, r.users) for r in got} == {(1, 1), (2, 1)}
    assert {r.median_ard for r in got} == {1.5}


def test_equal_to_median_is_below(spark):
    # ARD per user: 1, 2, 2 -> median 2; users 2 and 3 are not above it
    rows = [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1)]
    got = {(r.read_date, r.segment): r.active_readers for r in D.ard_daily(reads(spark, rows)).collect()}
    assert got == {(D0, "below"): 3, (D0 + dt.timedelta(days=1), "below"): 2}


def test_subscription_week_one_is_days_zero_to_six(spark):
    cohort = spark.createDataFrame([(1, "Sept-2023", dt.datetime(2023, 9, 1, 18))],
                                   "user_id long, cohort_period string, sub_start_timestamp timestamp_ntz")
    r = reads(spark, [(1, -1), (1, 0), (1, 6), (1, 7)])
    got = {x.sub_week: x.active_readers for x in D.readers_by_week(r, cohort).collect()}
    assert got == {1: 1, 2: 1}


def test_book_categories(spark):
    ev = spark.createDataFrame(
        [(1, "s1", 10), (2, "s2", 10), (2, "s3", 11), (3, "s4", 1), (3, "s4", 2), (3, "s5", 3), (4, "s6", None)],
        "user_id long, session_id string, book_id int")
    got = {(r.book_category, r.active_reading_sessions): (r.users, r.median_ars)
           for r in D.ars_distribution(ev).collect()}
    assert got == {("1", 1): (1, 1.0), ("2", 2): (1, 2.0), ("3+", 2): (1, 2.0), ("0", 1): (1, 1.0)}


def test_any_set_of_cohorts_is_counted_from_bitmaps(spark):
    import random

    from lectern.operators.dashboard import reader_bitmaps, readers_by_week, readers_from_bitmaps
    r = random.Random(5)
    reading = spark.createDataFrame([(r.choice([None, *range(-40, 90_000, 997)]), dt.date(2024, 1, 1) + dt.timedelta(days=r.randint(0, 40))) for _ in range(3000)], "user_id long, read_date date")
    cohort = spark.createDataFrame([(u, r.choice("abc"), dt.datetime(2024, 1, r.randint(1, 20))) for u in range(-40, 90_000, 997)], "user_id long, cohort_period string, sub_start_timestamp timestamp_ntz")
    state = reader_bitmaps(reading, cohort)
    assert sorted(readers_from_bitmaps(state, ["cohort_period", "sub_week"]).collect()) == sorted(readers_by_week(reading, cohort).collect())
    some = cohort.filter("cohort_period IN ('a', 'c')")
    want = readers_by_week(reading, some.withColumn("cohort_period", F.lit("both")))
    got = readers_from_bitmaps(state.filter("cohort_period IN ('a', 'c')"), ["sub_week"])
    assert sorted(map(tuple, got.collect())) == sorted((x.sub_week, x.active_readers) for x in want.collect())


def test_sessions_by_week_reads_the_events_once(spark):
    import __spark_entry__ as entry
    from conftest import SMALL
    df = entry.queries()["sessions_by_sub_week"](spark, SMALL)
    assert "events.parquet" not in " ".join(df.inputFiles()) and "Expand" not in df._jdf.queryExecution().executedPlan().toString()
