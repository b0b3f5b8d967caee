"""Operator 6: repeated passages by maximal repeats of an enhanced suffix array.

A byte goes if a ``LEAST``-byte string covers it that also starts earlier.
Every ``LEAST``-byte window is settled where its smallest 32-byte gram
(leftmost of equals) is: equal windows choose the same gram at the same
place. The windows that share a gram occurrence are one fragment.

1. Fragments equal to an earlier one go, first inside a task, then in the part
   their gram is dealt to: a hot passage reaches that part once per task.
2. Grams with several different fragments stay open: there a passage begins or
   ends. The open fragments' bytes are fetched, dealt by gram, and the
   common-prefix interval tree of their enhanced suffix array gives the
   maximal repeats with all occurrences; all but the earliest go. Fragments of
   a gram with very many of them are dealt window by window instead.

Windows are compared by 128 bits of hash in step 1, by bytes in step 2.

Null and empty texts have no bytes and lose none. Every row is a text of its
own, named by a number written with it: earlier is the smaller doc_id (null
is the least long), of rows that repeat one or have none the smaller number, and
in a row the earlier start. Of equal rows the first stays. An empty table gives no rows; further columns are not read by
``removals`` and kept by ``without_repeats``, where bytes of a cut character
are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_shuffles, numbered, per_row, renamed_apart, table, written
from .esa import repeats

LEAST = 100
GRAM = 32
#: A gram with more different fragments is dealt by window.
HOT = 1000
#: Anchors a task holds before it compares and hands them on.
HELD = 600_000
#: Suffixes sorted at once.
SORTED = 60_000
NULL_KEY = -(1 << 63)

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every ``GRAM`` bytes, by doubling."""
    h, width, power = (data.astype(np.uint64) + np.uint64(1)) * _Q, 1, int(_P)
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        h = h ^ (h >> np.uint64(31))
        power, width = (power * power + 2) % (1 << 64), width * 2
    return _mixed(h)


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    m, have = x, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def fragments(data: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(gram, content, anchor, from, to) of the fragments of one text: windows
    from..to choose the gram at ``anchor``; ``content`` hashes their bytes."""
    if len(data) < least:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    h = gram_hashes(data)
    low = np.uint64(0xFFFFFFFF)
    chosen = _window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), least - GRAM + 1) & low
    lo = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    hi = np.r_[lo[1:], len(chosen)] - 1
    anchor = chosen[lo].astype(np.int64)
    last = hi + least - GRAM
    content = ((anchor - lo).astype(np.uint64) << np.uint64(20)) + (hi - lo).astype(np.uint64)
    for k in range(0, 2 * least, GRAM):  # grams that cover the fragment, at most 2 * least - GRAM + ... bytes
        content = _mixed(content + h[np.minimum(lo + k, last)])
    return h[anchor], content, anchor, lo, hi


def _merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Byte spans joined where they touch, per row."""
    order = np.lexsort((hi, lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    if not len(row):
        return row, lo, hi
    new_row = np.r_[True, row[1:] != row[:-1]]
    # ends grow within a row; a row's place lifts its ends above those before
    lift = np.cumsum(new_row) * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + lift) - lift
    start = np.flatnonzero(np.r_[True, new_row[1:] | (lo[1:] > reach[:-1])])
    return row[start], lo[start], np.maximum.reduceat(hi, start)


_ANCHORS = pa.schema([("part", pa.int32()), ("packet", pa.binary())])
_FOUND = pa.schema([("row", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("gram", pa.int64()), ("anchor", pa.int64()), ("hot", pa.bool_())])
_FOUND_DDL = "row long, lo long, hi long, gram long, anchor long, hot boolean"


def _batches(schema: pa.Schema, *columns: np.ndarray, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[at:at + rows], f.type) for c, f in zip(columns, schema)], schema=schema)


def _packed(gram: np.ndarray, content: np.ndarray, doc: np.ndarray, row: np.ndarray, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Fragments in order of their texts: steps from each to the next, byte by byte, compressed."""
    columns = np.stack([gram, content, *(np.diff(c, prepend=0) for c in (doc, row, anchor)), anchor - lo, hi - lo])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(columns.view(np.uint8).reshape(7, -1, 8).transpose(0, 2, 1)))


def _unpacked(packet: bytes) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packet), np.uint8).reshape(7, 8, -1)
    gram, content, doc, row, anchor, before, width = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64)[:, :, 0]
    doc, row, anchor = (np.cumsum(c) for c in (doc, row, anchor))
    lo = anchor - before
    return [gram, content, doc, row, anchor, lo, lo + width]


def _anchors(batches: Iterator[pa.RecordBatch], least: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Earliest of equal fragments of a task; the others as spans to go (anchor -1).
    Packets of them, with the part of their gram (of spans: of their row)."""
    held, n = [], 0

    def part_of(x: np.ndarray) -> np.ndarray:
        return (_mixed(x.view(np.uint64)) % np.uint64(parts)).astype(np.int64)

    def flush():
        columns = [np.concatenate(c) for c in zip(*held)]
        gram, content, doc, row, _, lo, hi = columns
        if not len(gram):
            return
        order = np.lexsort((lo, row, doc, content, gram))
        again = np.r_[False, (np.diff(gram[order]) == 0) & (np.diff(content[order]) == 0)]
        first = np.sort(order[~again])
        d, a, b = _merged(row[order[again]], lo[order[again]], hi[order[again]] + least)
        none = np.zeros(len(d), np.int64)
        part = np.concatenate([part_of(gram[first]), part_of(d)])
        columns = [np.concatenate([c[first], s]) for c, s in zip(columns, (none, none, none, d, none - 1, a, b))]
        order = np.argsort(part, kind="stable")
        bounds = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1)).tolist()
        for x, y in zip(bounds, bounds[1:]):
            at = order[x:y]
            packet = _packed(*(c[at] for c in columns))
            yield pa.RecordBatch.from_arrays([pa.array([part[at[0]]], pa.int32()), pa.array([packet], pa.binary())], schema=_ANCHORS)

    for batch in batches:
        for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            raw = text.as_buffer()
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
            gram, content, anchor, lo, hi = fragments(data, least)
            held.append((gram.view(np.int64), content.view(np.int64), np.full(len(lo), doc), np.full(len(lo), row), anchor, lo, hi))
            n += len(lo)
            if n >= HELD:
                yield from flush()
                held, n = [], 0
    if held:
        yield from flush()


def _settle(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of the fragments dealt to a task: spans to go (no gram), and open fragments."""
    parts = [_unpacked(packet) for b in batches for packet in b.column(0).to_pylist()]
    if not parts:
        return
    gram, content, doc, row, anchor, lo, hi = (np.concatenate(c) for c in zip(*parts))
    del parts
    gone = anchor < 0
    spans = [(row[gone], lo[gone], hi[gone])]
    gram, content, doc, row, anchor, lo, hi = (c[~gone] for c in (gram, content, doc, row, anchor, lo, hi))
    order = np.lexsort((lo, row, doc, content, gram))
    gram, content, row, anchor, lo, hi = (c[order] for c in (gram, content, row, anchor, lo, hi))
    del doc
    if len(gram):
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        first = new_gram | np.r_[True, content[1:] != content[:-1]]
        spans.append((row[~first], lo[~first], hi[~first] + least))
        gram, row, anchor, lo, hi = (c[first] for c in (gram, row, anchor, lo, hi))
        start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        many = np.repeat(np.diff(np.r_[start, len(gram)]), np.diff(np.r_[start, len(gram)]))
        open_ = many > 1
        for b in _batches(_FOUND, row[open_], lo[open_], hi[open_], gram[open_], anchor[open_], many[open_] > HOT):
            yield b
    d, a, b = _merged(*(np.concatenate(c) for c in zip(*spans)))
    none = np.zeros(len(d), np.int64)
    for batch in _batches(_FOUND, d, a, b, none, none - 1, none > 0):
        yield batch


def _cut_out(width: int):
    """Open fragments' bytes: rows (key, doc, row, at, bytes)."""

    def row(doc, number, text, open_):
        data = text or b""
        for f in open_:
            lo, hi = f["lo"], f["hi"]
            if not f["hot"]:
                yield f["gram"], doc, number, lo, data[lo:hi + width]
            else:
                for at in range(lo, hi + 1):
                    window = data[at:at + width]
                    yield int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), doc, number, at, window

    return row


def _repeated(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Spans to go among the fragments dealt to a task, by their maximal repeats."""
    parts = [[*(c.to_numpy(zero_copy_only=False) for c in b.columns[:4]), b.column(4).to_pylist()] for b in batches]
    if not parts:
        return
    key, doc, row, at = (np.concatenate([p[i] for p in parts]) for i in range(4))
    data = [x for p in parts for x in p[4]]
    order = np.lexsort((at, row, doc, key))
    key, doc, row, at = key[order], doc[order], row[order], at[order]
    data = [data[i] for i in order.tolist()]
    sizes = np.array([len(x) - least + 1 for x in data], np.int64)
    bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist() + [len(key)]
    spans: list[tuple[int, int, int]] = []

    def run(a: int, b: int) -> None:
        for length, found in repeats(data[a:b], least):
            where = sorted((int(doc[a + f]), int(row[a + f]), int(at[a + f]) + o) for f, o in found)
            spans.extend((d, p, p + length) for _, d, p in where[1:])

    a, n = 0, 0  # several grams at a time: an equal window is never in two of them
    for lo, hi in zip(bounds, bounds[1:]):
        size = int(sizes[lo:hi].sum())
        if n and n + size > SORTED:
            run(a, lo)
            a, n = lo, 0
        n += size
    run(a, len(key))
    if spans:
        d, x, y = _merged(*(np.array(c, np.int64) for c in zip(*spans)))
        none = np.zeros(len(d), np.int64)
        yield from _batches(_FOUND, d, x, y, none, none - 1, none > 0)


def removals(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(_row, spans): the byte spans [lo, hi) to go of every row of ``numbered``
    documents that has any."""
    if least < 2 * GRAM:
        raise ValueError(f"strings of {2 * GRAM} bytes and more are looked for")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("doc"), F.col("_row").alias("row"), F.col("text").cast("binary").alias("text"))
    anchors = keyed.mapInArrow(lambda b: _anchors(b, least, n), "part int, packet binary")
    found = written(anchors.repartitionById(n, "part").select("packet").mapInArrow(lambda b: _settle(b, least), _FOUND_DDL), "op6-found")
    free_shuffles(docs.sparkSession)
    open_ = found.filter("anchor >= 0").groupBy("row").agg(F.collect_list(F.struct("gram", "lo", "hi", "hot")).alias("open"))
    pieces = per_row(keyed.join(open_, "row").select("doc", "row", "text", "open"), "key long, doc long, row long, at long, data binary", lambda: _cut_out(least))
    late = written(pieces.repartition(n, "key").mapInArrow(lambda b: _repeated(b, least), _FOUND_DDL), "op6-repeats")
    free_shuffles(docs.sparkSession)
    spans = found.filter("anchor < 0").select("row", "lo", "hi").union(late.select("row", "lo", "hi"))
    return spans.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def runs(spans: list | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def kept_bytes(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    ends = [0, *(hi for _, hi in gone)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(lo for lo, _ in gone), len(data)]))


def digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """What goes and what stays of every document, as counts and a digest."""
    rows = numbered(docs.select("doc_id", "text"), "op6-rows")
    joined = rows.join(removals(rows, least), "_row", "left")

    def make():
        def row(doc_id, text, spans):
            data, gone = (text or "").encode(), runs(spans)
            kept = kept_bytes(data, gone)
            yield doc_id, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()

        return row

    return per_row(joined.select("doc_id", "text", "spans"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make)


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents with their texts cut; all columns and rows are kept, and a
    text that loses everything is empty."""
    given = renamed_apart(docs)
    rows = numbered(given, "op6-rows")
    found = removals(rows, least).withColumnRenamed("spans", "_spans")
    joined = rows.join(found, "_row", "left").select(*given.columns, "_spans")
    schema, at = given.schema, given.columns.index("text")

    def make():
        def row(*values):
            values, spans = list(values[:-1]), values[-1]
            if spans:
                values[at] = kept_bytes(values[at].encode(), runs(spans)).decode("utf-8", "ignore")
            return [tuple(values)]

        return row

    return per_row(joined, schema, make, 512).toDF(*docs.columns)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
