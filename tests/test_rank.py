"""Distributed rank equals the plain window rank."""

import random

import pytest

from lectern.operators.rank import global_rank, plain_rank


@pytest.mark.parametrize("seed", [1, 2])
def test_global_rank_equals_window_rank(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "b", "c"]), rnd.choice([None, 1.0, 2.0, 3.0]), rnd.choice([None, "x", "y", "z"]),
             rnd.randint(0, 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, market string, score double, title string, n int")
    order = [("score", False), ("title", True), ("n", False)]
    for parts in ([], ["market"]):
        b = sorted(plain_rank(df, order, out="r", partition_cols=parts).select("id", "r").collect())
        a = global_rank(df, order, out="r", partition_cols=parts, num_partitions=5)
        assert sorted(a.select("id", "r").collect()) == b


def test_ties_share_rank_and_next_skips(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 4.0), (4, None)], "id long, v double")
    got = dict(global_rank(df, [("v", False)], out="r").select("id", "r").collect())
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_rank_is_independent_of_partition_count(spark):
    df = spark.range(0, 500).selectExpr("id", "id % 17 as k")
    one = global_rank(df, [("k", True)], out="r", num_partitions=1).collect()
    many = global_rank(df, [("k", True)], out="r", num_partitions=7).collect()
    assert sorted(one) == sorted(many)


def test_no_rows(spark):
    assert global_rank(spark.createDataFrame([], "id long, v double"), [("v", False)]).collect() == []


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_a_key_with_most_rows_spreads_and_keeps_one_rank(spark, parts):
    """Two thirds of the rows are one whole row; it fills several range partitions."""
    rows = [("a", 5.0, "x")] * 400 + [("a", float(k % 7), "y") for k in range(100)] + [(None, 1.0, None)] * 60 + [(None, None, "z"), ("b", None, None)]
    df = spark.createDataFrame(rows, "market string, score double, title string").repartition(3)
    order = [("score", False), ("title", True)]
    for by in ([], ["market"]):
        want = sorted(map(repr, plain_rank(df, order, out="r", partition_cols=by).collect()))
        assert sorted(map(repr, global_rank(df, order, out="r", partition_cols=by, num_partitions=parts).collect())) == want


def test_zeros_of_both_signs_tie_and_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, 0.0, 7), (2, -0.0, 8), (3, float("nan"), 9), (4, float("nan"), 9), (5, -1.0, 9)], "id long, v double, _n int")
    want = sorted(plain_rank(df, [("v", True)], out="r").select("id", "r", "_n").collect())
    assert sorted(global_rank(df, [("v", True)], out="r", num_partitions=3).select("id", "r", "_n").collect()) == want


def test_keys_are_not_joined_back(spark):
    df = spark.range(1000).selectExpr("id", "id % 9 AS a", "id % 4 AS b")
    out = global_rank(df, [("a", True), ("b", False)], out="r", num_partitions=5)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") == 1 and "_pid" in next(line for line in text.splitlines() if "Join" in line)
    assert sorted(out.select("id", "r").collect()) == sorted(plain_rank(df, [("a", True), ("b", False)], out="r").select("id", "r").collect())
