"""What the text operators share: table access, written stages, Arrow batches."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import scratch_path

#: Folder of the public tokenizer files; a parameter, never part of the repository.
TOKENIZER_DIR = os.environ.get("LECTERN_TOKENIZERS", "")

#: Seconds that listeners are given to see the end of a job.
SETTLED = 1.0


def tokenizer_path(name: str) -> str:
    """Path of a tokenizer file: in ``LECTERN_TOKENIZERS`` or the installed package."""
    if TOKENIZER_DIR:
        return os.path.join(TOKENIZER_DIR, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as it is stored (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs a re-read, and values fixed at
    write time (partition ids, ranks) stay as they are.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*stages: DataFrame) -> None:
    """Removes the folders of written stages that nothing reads any more."""
    for df in stages:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df._written_to)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished jobs. Spark removes them once the driver's
    JVM has found them out of reach, which a driver with little to do finds late. The end of
    a job names its plan to listeners (an event log, say); the second look is after them."""
    spark.sparkContext._jvm.System.gc()
    time.sleep(SETTLED)
    spark.sparkContext._jvm.System.gc()


def renamed_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but doc_id and text named by their place, so that
    no name clashes with a helper column; undone by ``toDF(*docs.columns)``."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"given{i}" for i, c in enumerate(docs.columns)])


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` written with ``_row``, a number of its own for every row."""
    return written(docs.select("*", F.monotonically_increasing_id().alias("_row")), name)


def per_row(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[..., Iterator[tuple]]], out_rows: int = 4096) -> DataFrame:
    """Arrow-batched flat map: ``make()`` is called once per task and gives a
    function of the row's values that yields output tuples.

    Output leaves in batches of at most ``out_rows`` rows, so memory stays
    bounded by the input batch and one output batch.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, rows = make(), []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                for row in f(*values):
                    rows.append(row)
                    if len(rows) >= out_rows:
                        yield to_batch(rows, arrow)
                        rows = []
        end = getattr(f, "end", None)
        rows.extend(end() if end else ())
        if rows:
            yield to_batch(rows, arrow)

    return df.mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)
