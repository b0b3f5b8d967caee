"""Published tables: staged writes, commit markers, repeats, pruning."""

import tempfile

import pytest

from lectern.sources.published import Published
from lectern.sources.sinks import append_batch, write_bucketed
from lectern.sources.schemas import COHORT_TABLE_SCHEMA


def table(spark):
    return Published(spark, tempfile.mkdtemp(prefix="lectern-test-") + "/t")


def frame(spark, rows):
    return spark.createDataFrame(rows, "market string, k int, v double")


def rows(df):
    return sorted(map(tuple, df.select("market", "k", "v").collect()), key=str)


def test_a_write_that_dies_leaves_the_last_version(spark, monkeypatch):
    t = table(spark)
    with pytest.raises(FileNotFoundError):
        t.read()
    t.create(frame(spark, [("es", 1, 1.0)]), ["market"])
    monkeypatch.setattr(t, "_commit", lambda manifest: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        t.publish(frame(spark, [("es", 2, 2.0)]), ["market"])
    monkeypatch.undo()
    assert rows(t.read()) == [("es", 1, 1.0)]
    bad = frame(spark, [("es", 0, 1.0)]).selectExpr("market", "k", "CAST(raise_error('lost') AS DOUBLE) AS v")
    with pytest.raises(Exception):
        t.publish(bad, ["market"])
    assert rows(t.read()) == [("es", 1, 1.0)] and t.versions() == [1]
    assert t.vacuum() == 1 and rows(t.read()) == [("es", 1, 1.0)]


def test_publish_replaces_only_the_partitions_it_has_rows_of(spark):
    t = table(spark)
    t.publish(frame(spark, [("es", 1, 1.0), ("fr", 1, 2.0), (None, 1, 3.0)]), ["market"])
    t.publish(frame(spark, [("fr", 7, 7.0), ("it", 1, 4.0)]), ["market"])
    assert rows(t.read()) == rows(frame(spark, [("es", 1, 1.0), ("fr", 7, 7.0), ("it", 1, 4.0), (None, 1, 3.0)]))
    assert rows(t.read(1)) == rows(frame(spark, [("es", 1, 1.0), ("fr", 1, 2.0), (None, 1, 3.0)]))
    t.publish(frame(spark, []), ["market"])
    assert t.read().count() == 4
    with pytest.raises(FileExistsError):
        t.create(frame(spark, []), ["market"])
    with pytest.raises(ValueError):
        t.publish(frame(spark, []), ["k"])
    with pytest.raises(ValueError):
        t.publish(frame(spark, []).withColumnRenamed("v", "w"), ["market"])


def test_partitions_are_pruned_in_the_read(spark):
    t = table(spark)
    t.publish(frame(spark, [(m, k, 0.5) for m in ("es", "fr", "it") for k in range(5)]), ["market"])
    df = t.read().filter("market = 'fr'")
    assert df.count() == 5 and len(df.inputFiles()) >= 1
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(market" in text


def test_without_partitions_the_whole_table_is_replaced(spark):
    t = table(spark)
    t.publish(frame(spark, [("es", 1, 1.0)]))
    t.publish(frame(spark, [("fr", 2, 2.0)]))
    assert rows(t.read()) == [("fr", 2, 2.0)]
    t.publish(frame(spark, []))
    assert t.read().count() == 0


def test_the_same_batch_twice_gives_one_copy(spark):
    t = table(spark)
    for batch, k in (("a", 1), ("b", 2), ("a", 1), ("b", 99)):
        t.append(frame(spark, [("es", k, 0.0)]), batch)
    assert rows(t.read()) == [("es", 1, 0.0), ("es", 2, 0.0)] and t.versions() == [1, 2]


def test_two_writers_from_one_version(spark, monkeypatch):
    """The other commits between this one's look and its marker: both batches are there in the end."""
    t = table(spark)
    other = Published(spark, t.path)
    commit, raced = t._commit, []

    def late(manifest):
        if not raced:
            raced.append(1)
            other.append(frame(spark, [("fr", 2, 2.0)]), "theirs")
        return commit(manifest)

    monkeypatch.setattr(t, "_commit", late)
    t.append(frame(spark, [("es", 1, 1.0)]), "ours")
    assert rows(t.read()) == [("es", 1, 1.0), ("fr", 2, 2.0)] and t.versions() == [1, 2]
    assert not [n for n in t._names("_commits") if n.startswith(".") and not n.endswith(".crc")]


def test_append_batch_is_positional_and_checked(spark):
    with pytest.raises(ValueError):
        append_batch(spark.range(1), tempfile.mkdtemp() + "/t", COHORT_TABLE_SCHEMA, "x")
    path = tempfile.mkdtemp(prefix="lectern-test-") + "/t"
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("label", T.StringType())])
    for _ in range(2):
        out = append_batch(spark.createDataFrame([(7, "x")], "other long, name string"), path, schema, "one")
    assert out.schema == schema and [tuple(r) for r in out.collect()] == [(7, "x")]


def test_bucketed_user_tables_join_without_exchange(spark):
    from lectern.operators.cohorts import enrich_cohort, label_cohorts, rollup_subscriptions
    from lectern.operators.engagement import anchor, kpi_base, tenure
    from lectern.plans import params as P
    from lectern.sources.catalog import Tables
    from conftest import SMALL
    t = Tables(spark, SMALL, derive=True)
    names = ("registrations", "disciplines", "subscriptions", "users")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")
    b = {name: write_bucketed(getattr(t, name), f"bucketed_{name}", "user_id", 4) for name in names}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

        def c3(x):
            return enrich_cohort(label_cohorts(x["registrations"], P.COHORTS), x["disciplines"], rollup_subscriptions(x["subscriptions"]))

        def g4(x):
            base = kpi_base(x["users"], P.SINCE)
            return anchor(base, tenure(x["subscriptions"], base, P.AS_OF))

        plain = {name: getattr(t, name) for name in names}
        for build in (c3, g4):
            df = build(b)
            got = sorted(map(repr, df.collect()))
            assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
            assert got == sorted(map(repr, build(plain).collect())) and got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")
