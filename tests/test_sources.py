"""Adapters equal their DuckDB text; stored tables are read as they are."""

import datetime as dt
import tempfile

import pytest

from lectern.oracle.adapters_sql import ADAPTER_SQL, with_tables
from lectern.sources.catalog import load
from lectern.sources.schemas import LOGICAL_SCHEMAS
from oracle_compare import normalise

from conftest import SMALL


@pytest.mark.parametrize("name", sorted(ADAPTER_SQL))
def test_adapter_matches_duckdb(spark, duck, name):
    df = load(spark, name, SMALL, derive=True)
    assert [f.name for f in df.schema.fields] == [f.name for f in LOGICAL_SCHEMAS[name].fields]
    assert [f.dataType for f in df.schema.fields] == [f.dataType for f in LOGICAL_SCHEMAS[name].fields]
    res = duck.execute(with_tables([name], f"select * from {name}"))
    sn, sr = normalise(df.columns, [tuple(r) for r in df.collect()])
    dn, dr = normalise([d[0] for d in res.description], res.fetchall())
    assert sn == dn and sr == dr


def test_stored_table_read_with_declared_schema(spark):
    folder = tempfile.mkdtemp(prefix="lectern-test-")
    rows = [(1, "subscribed", dt.datetime(2024, 1, 2), dt.date(2024, 3, 1), None, None, 9.5, 2)]
    spark.createDataFrame(rows, LOGICAL_SCHEMAS["subscriptions"]).write.parquet(f"{folder}/subscriptions.parquet")
    df = load(spark, "subscriptions", folder, columns=["user_id", "total_paid_gbp"])
    assert df.columns == ["user_id", "total_paid_gbp"]
    assert df.collect()[0].total_paid_gbp == 9.5


def test_append_positional_checks_arity(spark):
    from lectern.sources.schemas import COHORT_TABLE_SCHEMA
    from lectern.sources.sinks import append_positional
    with pytest.raises(ValueError):
        append_positional(spark.range(1), tempfile.mkdtemp() + "/t", COHORT_TABLE_SCHEMA)


def test_write_new_fails_if_exists_and_append_is_positional(spark):
    from pyspark.sql import types as T
    from lectern.sources.sinks import append_positional, write_new
    folder = tempfile.mkdtemp(prefix="lectern-test-") + "/t"
    back = write_new(spark.createDataFrame([(1, "a")], "k long, v string"), folder)
    assert back.count() == 1
    with pytest.raises(Exception):
        write_new(spark.createDataFrame([(2, "b")], "k long, v string"), folder)
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("label", T.StringType())])
    target = tempfile.mkdtemp(prefix="lectern-test-") + "/p"
    append_positional(spark.createDataFrame([(7, "x")], "whatever long, other string"), target, schema)
    out = append_positional(spark.createDataFrame([(8, "y")], "a long, b string"), target, schema)
    assert out.schema == schema
    assert sorted(tuple(r) for r in out.collect()) == [(7, "x"), (8, "y")]


def test_a_missing_table_is_an_error(spark):
    with pytest.raises(Exception):
        load(spark, "users", tempfile.mkdtemp(prefix="lectern-test-"))


def test_rows_appended_after_a_read_are_found(spark):
    folder = tempfile.mkdtemp(prefix="lectern-test-")
    rows = spark.range(3).selectExpr("id AS list_isbn")
    rows.write.parquet(f"{folder}/cleanup.parquet")
    assert load(spark, "cleanup", folder).count() == 3
    rows.write.mode("append").parquet(f"{folder}/cleanup.parquet")
    assert load(spark, "cleanup", folder).count() == 6


def test_stored_timestamps_and_decimals_are_cast(spark):
    folder = tempfile.mkdtemp(prefix="lectern-test-")
    spark.sql("""SELECT 1 AS user_id, 'subscribed' AS subscription_type, TIMESTAMP '2024-01-02 03:04:05' AS subscription_start_time,
                 TIMESTAMP '2024-03-01 10:00:00' AS subscription_end_time, TIMESTAMP '2024-03-01 00:00:00' AS end_timestamp,
                 CAST(NULL AS TIMESTAMP) AS paid_end_timestamp, CAST(9.50 AS DECIMAL(12, 2)) AS total_paid_gbp, 2L AS subscribed_months"""
              ).write.parquet(f"{folder}/subscriptions.parquet")
    df = load(spark, "subscriptions", folder)
    assert df.schema == LOGICAL_SCHEMAS["subscriptions"]
    (row,) = df.collect()
    assert row.total_paid_gbp == 9.5 and row.subscription_end_time == dt.date(2024, 3, 1)


def test_every_logical_table_reads_back_from_storage(spark):
    folder = tempfile.mkdtemp(prefix="lectern-test-")
    for name, schema in LOGICAL_SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
        assert load(spark, name, folder).schema == schema


def test_drift_is_found_without_reading_rows():
    from pyspark.sql import types as T

    from lectern.sources.mapping import Drift, TableMapping, drift
    stored = T.StructType().add("user_id", T.LongType()).add("book_id", T.DecimalType(20, 0)).add("reading_date", T.TimestampType()).add("note", T.StringType())
    mapping = TableMapping("x", {"read_date": "reading_date"})
    assert drift(stored, "reading_activity", mapping) == [
        Drift("narrowed", "book_id", "bigint", "decimal(20,0)"), Drift("missing", "reading_minutes", "double", None), Drift("extra", "note", None, "string")]
    assert [d.kind for d in drift(stored, "reading_activity", TableMapping("x", {"read_date": "reading_date"}, frozenset({"reading_minutes"})))] == ["narrowed", "extra"]


@pytest.mark.parametrize("stored, declared, want", [
    ("int", "bigint", True), ("bigint", "int", False), ("decimal(12,2)", "double", True), ("double", "float", False), ("string", "date", False),
    ("timestamp", "date", True), ("date", "timestamp", True), ("bigint", "string", True), ("double", "bigint", False), ("decimal(9,0)", "decimal(12,2)", True),
    ("decimal(12,2)", "decimal(12,4)", False), ("boolean", "int", False), ("void", "date", True)])
def test_which_types_fit(spark, stored, declared, want):
    from lectern.sources.mapping import fits
    schema = spark.sql(f"SELECT CAST(NULL AS {stored}) AS a, CAST(NULL AS {declared}) AS b").schema
    assert fits(schema["a"].dataType, schema["b"].dataType) is want


def test_mapped_tables_read_under_their_logical_names_with_filters_pushed(spark):
    from lectern.sources.catalog import Tables
    from lectern.sources.mapping import REFERENCE_MAPPINGS, DriftError
    folder = tempfile.mkdtemp(prefix="lectern-test-")
    spark.sql("SELECT 1L AS user_id, 2L AS book_id, TIMESTAMP '2024-01-02 03:04:05' AS reading_date, 4 AS reading_minutes, 'x' AS more").write.parquet(f"{folder}/reading_activity_daily.parquet")
    spark.sql("SELECT 1L AS user_id, 2L AS event_id, 'open book' AS event_name_master, DATE '2024-01-02' AS event_timestamp, 's' AS session_id, 3 AS book_id").write.parquet(f"{folder}/user_tracking_events.parquet")
    t = Tables(spark, folder, mappings=REFERENCE_MAPPINGS)
    assert t.reading_activity.schema == LOGICAL_SCHEMAS["reading_activity"]
    assert tuple(t.reading_activity.head()) == (1, 2, dt.date(2024, 1, 2), 4.0)
    df = t.event_facts.filter("event_name = 'open book'").select("user_id", "value")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_name_master,open book)" in text
    assert "GreaterThanOrEqual(event_timestamp" in t.event_facts.filter("event_date >= DATE '2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "session_id" not in text[text.index("ReadSchema"):] and [tuple(r) for r in df.collect()] == [(1, None)]
    spark.sql("SELECT 1L AS user_id").write.parquet(f"{folder}/second/reading_activity_daily.parquet")
    with pytest.raises(DriftError):
        load(spark, "reading_activity", f"{folder}/second", mappings=REFERENCE_MAPPINGS)
