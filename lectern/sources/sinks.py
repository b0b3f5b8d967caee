"""Table sinks.

A target is a folder path (anything with '/' or a URI scheme) or a table
name in the session catalog. Tables that are replaced or appended to again
and again are kept as ``published.Published``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .published import Published


def _is_path(target: str) -> bool:
    return "/" in target or ":" in target


def write_new(df: DataFrame, target: str, partition_by: list[str] | None = None) -> DataFrame:
    """S2 (CREATE TABLE AS): write ``df`` as a new Parquet table; fail if it
    exists. Returns the table read back."""
    writer = df.write.mode("errorifexists").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    spark = df.sparkSession
    if _is_path(target):
        writer.save(target)
        return spark.read.parquet(target)
    writer.saveAsTable(target)
    return spark.table(target)


def by_position(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``df``, in their order, as those of ``schema``: its names, cast to its types."""
    if len(df.columns) != len(schema.fields):
        raise ValueError(f"{len(df.columns)} columns for a {len(schema.fields)}-column table")
    return df.select(*[F.col(f"`{src}`").cast(field.dataType).alias(field.name) for src, field in zip(df.columns, schema.fields)])


def append_batch(df: DataFrame, path: str, schema: T.StructType, batch: str) -> DataFrame:
    """S3, safe to repeat: a positional append of ``batch`` into the published
    table at ``path``; a batch that was added before is left as it is. Returns
    the table read back."""
    table = Published(df.sparkSession, path)
    table.append(by_position(df, schema), batch)
    return table.read()


def append_positional(df: DataFrame, target: str, schema: T.StructType) -> DataFrame:
    """S3 (INSERT INTO t SELECT *): append ``df`` into a table with a
    declared schema, matching columns by position and casting to the
    declared types. Returns the table read back with that schema.

    For a catalog table the declared schema is the table's own and the
    write is ``insertInto`` (positional by definition); a folder target
    gets the schema given here.
    """
    spark = df.sparkSession
    if not _is_path(target) and spark.catalog.tableExists(target):
        schema = spark.table(target).schema
    out = by_position(df, schema)
    if _is_path(target):
        out.write.mode("append").parquet(target)
        return spark.read.schema(schema).parquet(target)
    if spark.catalog.tableExists(target):
        out.write.insertInto(target)
    else:
        out.write.format("parquet").saveAsTable(target)
    return spark.table(target)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a catalog table in ``buckets`` buckets by ``key``, sorted inside:
    joins and groupings on ``key`` between tables of equally many buckets read
    them where they are, without an exchange."""
    df.write.mode("errorifexists").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)
