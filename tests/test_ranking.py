"""Edge rows of the book ranking (FIXTURES.md §4)."""

import datetime as dt

from pyspark.sql import functions as F

from lectern.config import Market
from lectern.functions.scoring import clean_publication_date, minmax_score
from lectern.operators import joins
from lectern.operators import ranking as R


def test_score_floor_and_single_value(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 10.01), (3, 20.0)], "id long, v double")
    got = dict(minmax_score(df, "v", "s").select("id", "s").collect())
    assert got == {1: 1.0, 2: 1.0, 3: 1000.0}
    single = minmax_score(spark.createDataFrame([(1, 7.0)], "id long, v double"), "v", "s").collect()
    assert single[0].s == 1.0


def test_publication_date_clean(spark):
    vals = ["", "None", "NA", None, "2021-03-04", "2021"]
    df = spark.createDataFrame([(v,) for v in vals], "p string")
    got = [r.c for r in df.select(clean_publication_date(F.col("p")).alias("c")).collect()]
    assert got == ["0", "0", "0", "0", "20210304", "2021"]


def test_blanks_become_missing(spark):
    meta = spark.createDataFrame(
        [(1, None, "", "x", "t", "p", "i", "2020-01-01", dt.date(2020, 1, 1), dt.date(2020, 1, 1), "",
          "", "", "", "", "", None, "", "English", 1)],
        "id long, isbn13_idvalue string, hardback_isbn string, softback_isbn string, title_text string, "
        "publisher_name string, publisher_imprint string, publication_date string, date_activated date, "
        "date_added date, subject_name string, topic_name1 string, topic_name2 string, topic_name3 string, "
        "topic_name4 string, contributor1_name string, contributor2_name string, contributor3_name string, "
        "language_name string, is_available int")
    row = R.active_books(meta).collect()[0]
    assert row.other_isbn == "x" and row.topic_name is None and row.author is None and row.subject_name is None


def test_revenue_excludes_zero_payers_and_unsubscribed(spark):
    regs = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 5), "direct", "Y", 100, "spain", "es"),
         (2, dt.datetime(2024, 1, 5), "direct", "Y", 100, "spain", "es"),
         (3, dt.datetime(2024, 1, 5), "direct", "Y", 100, "spain", "es")],
        "user_id long, registration_time timestamp_ntz, payment_channel_crude string, converted_subscribed string, "
        "referrer_book long, acquisition_country string, country_language string")
    subs = spark.createDataFrame([(1, 0.0), (2, 12.5), (2, None)], "user_id long, total_paid_gbp double")
    market = [Market("spain", "es", countries=("spain",))]
    users = R.market_users(regs, market)
    rev = R.dtc_revenue(regs, subs, users, dt.date(2024, 3, 15)).collect()
    assert [(r.referrer_book, r.users, r.dtc_revenue) for r in rev] == [(100, 1, 12.5)]


def test_clicks_bad_cast_dropped(spark):
    clicks = spark.createDataFrame(
        [(dt.date(2024, 10, 1), "abc", "es", "5", "1"), (dt.date(2024, 10, 1), "7", "es", "5", "x"),
         (dt.date(2024, 10, 2), "7", "es", "1", "2"), (dt.date(2024, 10, 2), "8", "es", "1", "1")],
        "dates date, book_id string, locale string, impressions string, clicks string")
    got = {r.book_id: r.clicks for r in R.search_interest(clicks, R.market_table(spark, [Market("spain", "es")])).collect()}
    assert got == {7: 2.0, 8: 1.0}


def test_mandate_duplicates_summed_once(spark):
    m = spark.createDataFrame([(1, 9, "d", "u", "10", "Yes"), (1, 9, "d", "u", "10", "Yes"), (2, 9, "d", "u", "4", "Yes"),
                               (3, 9, "d", "u", "50", "No")],
                              "book_id long, isbn long, degree_name string, uni_code string, "
                              "degree_new_enrollments string, available_status string")
    got = {r.book_id: r.enrollment for r in R.academic_mandate(m).collect()}
    assert got == {1: 10.0, 2: 4.0}


def test_months_back():
    assert R.months_back(dt.date(1996, 3, 15), 12) == dt.date(1995, 3, 1)
    assert R.months_back(dt.date(1996, 3, 15), 6) == dt.date(1995, 9, 1)
    assert R.months_back(dt.date(2024, 1, 31), 1) == dt.date(2023, 12, 1)


def test_readership_tasks_grow_with_the_tables(spark, tmp_path, monkeypatch):
    """Tasks of the large shuffles go by the stored size, and the rows stay the same."""
    rows = [(k % 40 if k % 3 else 0, k % 7, dt.date(2024, 3, 1), 0.1 * (k % 9)) for k in range(4000)] + [(None, 1, dt.date(2024, 3, 1), 1.0), (5, None, None, None)]
    spark.createDataFrame(rows, "user_id long, book_id long, read_date date, reading_minutes double").write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    one.union(one).union(one).write.parquet(str(tmp_path / "three"))
    three = spark.read.parquet(str(tmp_path / "three"))
    users = spark.createDataFrame([(u, m) for u in range(30) for m in ("a", "b")[:1 + u % 2]], "user_id long, market string")
    plain = sorted(map(tuple, R.readership(one, users, dt.date(2024, 3, 15)).collect()))
    monkeypatch.setattr(joins, "SPREAD_BYTES", 100)
    assert joins.spread_tasks(three) > joins.spread_tasks(one) > 4
    seen = []
    monkeypatch.setattr(R, "spread", lambda df, tasks, *keys: seen.append((tasks, keys)) or joins.spread(df, tasks, *keys))
    assert sorted(map(tuple, R.readership(one, users, dt.date(2024, 3, 15)).collect())) == plain
    assert seen == [(joins.spread_tasks(one), k) for k in (("user_id", "book_id"), ("user_id",), ("user_id",))]
    assert joins.spread(one, 50, "user_id").rdd.getNumPartitions() == 50
    assert joins.spread(one, 3, "user_id").rdd.getNumPartitions() == one.rdd.getNumPartitions()
