"""Checkpoint folder handling and written stages."""

import pytest

from lectern import session as S


def test_scratch_paths_live_under_the_checkpoint_folder(spark):
    base = S.ensure_checkpoint_dir(spark)
    a, b = S.scratch_path(spark, "x"), S.scratch_path(spark, "x")
    assert a.startswith(base.rstrip("/")) and b.startswith(base.rstrip("/")) and a != b


def test_reliable_checkpoint_keeps_rows_and_cuts_lineage(spark):
    df = spark.range(0, 1000).selectExpr("id", "id % 7 AS k")
    written = S.reliable_checkpoint(df, "test")
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, df.collect()))
    plan = written._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan  # reads the written table, not the original plan


class _FakeContext:
    master = "yarn"

    def getCheckpointDir(self):
        return None

    def getConf(self):
        class C:
            def get(self, key, default=None):
                return default
        return C()


class _FakeSession:
    sparkContext = _FakeContext()

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        S.ensure_checkpoint_dir(_FakeSession())
