
import __spark_entry__ as entry

from conftest import SMALL


def test_month_minutes_are_week_sums_and_books_bounded(spark):
    from lectern.config import month_windows, week_windows
    from lectern.operators.windows import reading_windows
    from lectern.sources.catalog import Tables
    t = Tables(spark, SMALL, derive=True)
    w, m = week_windows(4), month_windows(1)
    rows = reading_windows(t.event_users, t.event_reading, book_windows=w + m, minute_windows=w + m).collect()
    assert rows
    for r in rows:
        weeks = [r[f"reading_mins_w{k}"] for k in range(1, 5)]
        if all(x is None for x in weeks):
            assert r.reading_mins_m1 is None
        else:
            assert abs(r.reading_mins_m1 - sum(x or 0 for x in weeks)) < 1e-6
        books = [r[f"book_read_w{k}"] for k in range(1, 5)]
        assert max(books) <= r.book_read_m1 <= sum(books)


def test_results_do_not_depend_on_shuffle_partitions(spark):
    key = "learning_kpi_report"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(map(repr, entry.queries()[key](spark, SMALL).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = sorted(map(repr, entry.queries()[key](spark, SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b
