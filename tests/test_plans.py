"""Physical plan shape: the scale properties the operators promise."""

import __spark_entry__ as entry

from conftest import SMALL


def plan(df) -> str:
    df.collect()  # run once so the adaptive plan is final
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_have_no_expand(spark):
    for key in ("learning_kpi_report", "engagement_report_v3", "event_windows", "ars_distribution", "sessions_by_sub_week"):
        assert "Expand" not in plan(entry.queries()[key](spark, SMALL)), key


def _marker(line: str) -> int:
    hits = [i for i in (line.find("+- "), line.find(":- ")) if i >= 0]
    return min(hits) if hits else -1


def _child(lines: list[str], i: int) -> str:
    """The operator line directly below line ``i`` in Spark's tree string."""
    depth = _marker(lines[i])
    for line in lines[i + 1:]:
        m = _marker(line)
        if m == depth + 3:
            return line
        if 0 <= m <= depth:
            break
    return ""


def test_rank_never_gathers_keys_in_one_task(spark):
    """A single-partition exchange only ever takes totals, a row for each range
    partition: its input is an aggregate by range partition."""
    for key in ("market_rank_all", "newness"):
        lines = plan(entry.queries()[key](spark, SMALL)).splitlines()
        assert any("_pid" in line for line in lines), key
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line and "ReusedExchange" not in line:
                child = _child(lines, i)
                assert "HashAggregate" in child and "_pid" in child, child


def test_extract_range_pushed_to_scan(spark):
    df = entry.queries()["reading_window_extract"](spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThan(l_shipdate" in text


def test_v1_columns_of_v3_equal_v1(spark):
    v1 = entry.queries()["engagement_report_v1"](spark, SMALL)
    v3 = entry.queries()["engagement_report_v3"](spark, SMALL)
    cols = v1.columns
    assert set(cols) <= set(v3.columns)
    assert sorted(map(repr, v1.select(*cols).collect())) == sorted(map(repr, v3.select(*cols).collect()))


def test_market_rank_slice_equals_single_market(spark):
    all_markets = entry.queries()["market_rank_all"](spark, SMALL).filter("local_index = 'italy'")
    italy = entry.queries()["market_rank_italy"](spark, SMALL)
    assert sorted(map(tuple, all_markets.collect())) == sorted(map(tuple, italy.collect()))


def test_projection_prunes_the_scan(spark):
    from lectern.sources.catalog import load
    df = load(spark, "book_meta", SMALL, columns=["id", "title_text"], derive=True)
    text = df._jdf.queryExecution().executedPlan().toString()
    schema = text[text.index("ReadSchema: "):].split("\n")[0]
    assert "p_partkey" in schema and "p_name" in schema
    assert "p_brand" not in schema and "p_type" not in schema and "p_retailprice" not in schema


def test_report_event_columns_hold_data(spark):
    from pyspark.sql import functions as F
    df = entry.queries()["learning_kpi_report"](spark, SMALL.replace("sf0.001", "sf0.01"))
    done = [c for c in df.columns if c.startswith(("book_opened_", "reading_session_", "highlight_", "annotation_")) and not c.endswith("_flag")]
    flags = [c for c in df.columns if c.startswith(("ugc_", "highlight_", "annotation_")) and c.endswith("_flag")]
    sums = df.agg(*[F.sum(c).alias(c) for c in done], *[F.min(c).alias(f"{c}_all") for c in flags], *[F.max(c).alias(f"{c}_any") for c in flags]).first()
    assert len(done) == 24 and all(sums[c] > 0 for c in done)
    assert not any(sums[f"{c}_all"] for c in flags)
    assert all(sums[f"{c}_any"] for c in flags if not c.startswith("ugc_d1"))
