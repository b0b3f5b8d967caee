"""Stored tables under other names, checked for drift.

A ``TableMapping`` says which stored table and columns a logical table comes
from. ``drift`` compares what is stored with what is declared, without reading
rows: columns that are missing, that nobody asked for, or whose stored type
holds more than the declared one (a cast would lose or refuse values).
``resolve`` turns the mapping into one projection (renames, casts, NULLs for
optional columns), so filters and pruning still reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import LOGICAL_SCHEMAS


@dataclass(frozen=True)
class TableMapping:
    """``columns``: stored name of the logical columns that have another one;
    ``optional``: logical columns that may be missing (read as NULL)."""

    stored: str
    columns: Mapping[str, str] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()


# Where the reader tables' columns have other names than here.
REFERENCE_MAPPINGS: dict[str, TableMapping] = {
    "reading_activity": TableMapping("reading_activity_daily", {"read_date": "reading_date"}),
    "event_facts": TableMapping("user_tracking_events", {"event_date": "event_timestamp", "event_name": "event_name_master"}, frozenset({"value"})),
}


@dataclass(frozen=True)
class Drift:
    """``kind``: missing, extra or narrowed."""

    kind: str
    column: str
    declared: str | None
    stored: str | None


class DriftError(ValueError):
    pass


_INTEGERS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_FLOATS = {T.FloatType: 7, T.DoubleType: 15}
_TIMES = (T.TimestampType, T.TimestampNTZType)


def fits(stored: T.DataType, declared: T.DataType) -> bool:
    """Whether every value of ``stored`` has a place in ``declared``. A day may
    come from a timestamp (the part of the day is not asked for), a double from
    any number (to 15 digits), text from anything."""
    if stored == declared or isinstance(declared, T.StringType) or isinstance(stored, T.NullType):
        return True
    s, d = type(stored), type(declared)
    if d in _INTEGERS:
        return s in _INTEGERS and _INTEGERS[s] <= _INTEGERS[d]
    if d in _FLOATS:
        return s in _INTEGERS or isinstance(stored, T.DecimalType) or (s in _FLOATS and _FLOATS[s] <= _FLOATS[d])
    if isinstance(declared, T.DecimalType):
        if isinstance(stored, T.DecimalType):
            return stored.scale <= declared.scale and stored.precision - stored.scale <= declared.precision - declared.scale
        return s in _INTEGERS and _INTEGERS[s] <= declared.precision - declared.scale
    if isinstance(declared, T.DateType) or d in _TIMES:
        return isinstance(stored, T.DateType) or s in _TIMES
    return False


def _stored_name(logical: str, mapping: TableMapping) -> str:
    return mapping.columns.get(logical, logical)


def drift(stored: T.StructType, name: str, mapping: TableMapping) -> list[Drift]:
    """How the stored columns differ from the declared ones of logical table ``name``."""
    out, have = [], {f.name: f.dataType for f in stored.fields}
    schema = LOGICAL_SCHEMAS[name]
    for f in schema.fields:
        kind = have.get(_stored_name(f.name, mapping))
        if kind is None:
            if f.name not in mapping.optional:
                out.append(Drift("missing", f.name, f.dataType.simpleString(), None))
        elif not fits(kind, f.dataType):
            out.append(Drift("narrowed", f.name, f.dataType.simpleString(), kind.simpleString()))
    asked = {_stored_name(f.name, mapping) for f in schema.fields}
    return out + [Drift("extra", c, None, t.simpleString()) for c, t in have.items() if c not in asked]


def resolve(df: DataFrame, name: str, mapping: TableMapping | None = None, refuse: Iterable[str] = ("missing", "narrowed")) -> DataFrame:
    """``df`` as logical table ``name``; kinds of drift in ``refuse`` are an error."""
    mapping = mapping or TableMapping(name)
    found = [d for d in drift(df.schema, name, mapping) if d.kind in set(refuse)]
    if found:
        raise DriftError(f"{name}: " + "; ".join(f"{d.kind} {d.column} (declared {d.declared}, stored {d.stored})" for d in found))
    have = set(df.columns)
    cols = []
    for f in LOGICAL_SCHEMAS[name].fields:
        source = _stored_name(f.name, mapping)
        col = F.col(f"`{source}`") if source in have else F.lit(None)
        cols.append((col if source in have and df.schema[source].dataType == f.dataType else col.cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A row for each column of each table: its type, the table's rows, and how many have a value; each table is read once."""
    out = None
    for name, df in tables.items():
        counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_n{k}") for k, c in enumerate(df.columns)])
        rows = [F.struct(F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"),
                         F.col("_rows").alias("row_count"), F.col(f"_n{k}").alias("value_count")) for k, f in enumerate(df.schema.fields)]
        one = counted.select(F.inline(F.array(*rows)))
        out = one if out is None else out.unionByName(one)
    return out
