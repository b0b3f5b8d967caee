"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import SparkSession

# Settings the operators are written against. They are applied only when a
# session is built here (tests, bench); a cluster session keeps its own.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when the split forces one more
    # exchange before the following aggregation (hot users, hot books).
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "lectern",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Local-mode fallback folders, keyed weakly by session object.
_LOCAL_DIRS: "weakref.WeakKeyDictionary[SparkSession, str]" = weakref.WeakKeyDictionary()


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # a session without a JVM context (Spark Connect)
        return None


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the cluster, if any."""
    sc = _context(spark)
    if sc is not None:
        if sc.getCheckpointDir():
            return sc.getCheckpointDir()
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if configured:
            return configured
    try:
        return spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_DIRS.get(spark)
    except Exception:
        return _LOCAL_DIRS.get(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use ``spark.checkpoint.dir`` when the cluster sets it.

    Only a local-mode session (tests, bench) without one gets a fresh
    temporary folder; a cluster session without a shared folder is an error,
    because a machine-local folder does not survive executor loss.
    """
    sc = _context(spark)
    configured = checkpoint_dir(spark)
    if configured:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return (sc.getCheckpointDir() if sc is not None else None) or configured
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not str(master).startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="lectern-ckpt-")
    _LOCAL_DIRS[spark] = folder
    if sc is not None:
        sc.setCheckpointDir(folder)
        return sc.getCheckpointDir() or folder
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex}"


def reliable_checkpoint(df, name: str = "stage"):
    """Write ``df`` once as a Parquet table in the shared checkpoint folder
    and continue from that table: its lineage is cut, so a lost executor
    costs a re-read of the table, never a recomputation of the plan behind
    it (and values fixed at write time, such as range-partition ids, stay
    fixed). One write job; the read back is a columnar scan with pruning.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
