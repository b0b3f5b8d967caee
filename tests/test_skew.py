"""A key holding a third of all rows: results stay exact on the shuffle path."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lectern.config import month_windows, week_windows
from lectern.operators import windows as W
from lectern.operators.rank import global_rank, plain_rank


def test_hot_user_on_shuffle_join_path(spark):
    rnd = random.Random(3)
    d0 = dt.date(2024, 1, 1)
    rows = []
    for i in range(3000):
        user = 0 if i % 3 == 0 else rnd.randint(1, 40)   # user 0 holds a third of all rows
        rows.append((user, rnd.randint(0, 30), d0 + dt.timedelta(days=rnd.randint(0, 60)), float(rnd.randint(1, 9))))
    reads = spark.createDataFrame(rows, "user_id long, book_id long, read_date date, reading_minutes double")
    anchors = spark.createDataFrame([(u, dt.datetime(2024, 1, 1, 8)) for u in range(41)],
                                    "user_id long, reg_sub_start_time timestamp_ntz")
    wins = week_windows(8) + month_windows(2)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = W.reading_windows(anchors, reads, book_windows=wins, minute_windows=wins)
        picked = got.select("user_id", "book_read_w1", "book_read_m2", "reading_mins_w3")
        rows_got = sorted(map(tuple, picked.collect()))
        plan = picked._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    a = F.to_date("reg_sub_start_time")

    def inside(w):
        return F.col("read_date").between(F.date_add(a, w.lo), F.date_add(a, w.hi))

    w1, m2, w3 = wins[0], wins[9], wins[2]
    literal = (anchors.join(reads, "user_id", "left").groupBy("user_id")
               .agg(F.countDistinct(F.when(inside(w1), F.col("book_id"))).alias("b1"),
                    F.countDistinct(F.when(inside(m2), F.col("book_id"))).alias("bm2"),
                    F.round(F.sum(F.when(inside(w3), F.col("reading_minutes"))), 6).alias("m3")))
    assert rows_got == sorted(map(tuple, literal.collect()))


def test_rank_with_a_hot_key(spark):
    rows = [(i, 7.0 if i % 3 == 0 else float(i % 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v double")
    a = global_rank(df, [("v", False)], out="r", num_partitions=6)
    b = plain_rank(df, [("v", False)], out="r")
    assert sorted(a.select("id", "r").collect()) == sorted(b.select("id", "r").collect())
