"""S1 source_scan: read a logical table by name with its declared columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import ADAPTERS
from .mapping import TableMapping, resolve
from .schemas import LOGICAL_SCHEMAS


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as it is now."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def enforce(df: DataFrame, name: str) -> DataFrame:
    """Project to the declared schema, casting where the types differ."""
    schema = LOGICAL_SCHEMAS[name]
    cols = []
    for field in schema.fields:
        col = F.col(field.name)
        if df.schema[field.name].dataType != field.dataType:
            col = col.cast(field.dataType)
        cols.append(col.alias(field.name))
    return df.select(*cols)


def load(spark: SparkSession, name: str, sf_dir: str, columns: list[str] | None = None,
         derive: bool = False, mappings: Mapping[str, TableMapping] | None = None) -> DataFrame:
    """Logical table ``name`` under ``sf_dir``, as it is now.

    The stored table ``{sf_dir}/{name}.parquet`` is read with the types it
    has (timestamps, decimals, ...) and cast to the declared ones; a missing
    table is an error. With ``derive`` the table is made from the driver's
    tables by its adapter instead. ``columns`` prunes the result. A table in
    ``mappings`` is stored under the names given there, and checked for drift.
    """
    if name not in LOGICAL_SCHEMAS:
        raise KeyError(f"unknown logical table {name!r}")
    if derive:
        df = enforce(ADAPTERS[name](lambda t: driver_table(spark, sf_dir, t)), name)
    elif mappings and name in mappings:
        df = resolve(driver_table(spark, sf_dir, mappings[name].stored), name, mappings[name])
    else:
        df = enforce(driver_table(spark, sf_dir, name), name)
    return df.select(*columns) if columns else df


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).users`` etc. A table is looked up
    once per accessor, so a query that uses it twice reads the same files.
    ``derive``, ``mappings``: see ``load``."""

    def __init__(self, spark: SparkSession, sf_dir: str, derive: bool = False, mappings: Mapping[str, TableMapping] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.derive = derive
        self.mappings = mappings
        self._loaded: dict[str, DataFrame] = {}
        self._driver: dict[str, DataFrame] = {}

    def _base(self, name: str) -> DataFrame:
        if name not in self._driver:
            self._driver[name] = driver_table(self.spark, self.sf_dir, name)
        return self._driver[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in LOGICAL_SCHEMAS:
            raise AttributeError(name)
        if name not in self._loaded:
            self._loaded[name] = (enforce(ADAPTERS[name](self._base), name) if self.derive
                                  else load(self.spark, name, self.sf_dir, mappings=self.mappings))
        return self._loaded[name]
