"""Every registered query equals its DuckDB oracle on the small test data."""

import pytest

import __spark_entry__ as entry
from oracle_compare import normalise

from conftest import SMALL

KEYS = sorted(entry.oracle_sql())


def test_every_query_has_an_oracle():
    from lectern.plans.registry import QUERIES
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    sn, sr = normalise(df.columns, srows)
    dn, dr = normalise(dcols, res.fetchall())
    assert sn == dn
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "user_id" in df.columns
