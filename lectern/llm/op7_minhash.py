"""Operator 7: near-duplicate documents by MinHash.

Texts with equal shingle sets form a class, found by digest; its smallest
doc_id stands for it. Many universal hash minima of each set are banded;
sets that share a band are candidates. Candidates are first compared by
signature (a byte of each minimum), those not clearly below the limit on
their full sets. Links are merged by large-star / small-star.

A band's bucket is never expanded into its pairs. First, in some bands, every
member is compared with the bucket's smallest; what that links is merged. In
buckets of all bands that still hold several components, members of all but
the largest one there are compared with the rest, once, block by block, by
signature. Where a block has no more pairs alike than rows, they are confirmed on
the full sets one by one; where it has (a family just below the limit), its full
sets are brought together and it gives only links that join two components, fewer
than its rows. So the rows that are made grow with a family, not with its square.

The chance that a pair at the limit is missed is 2.2e-7 at 85 %, 4.9e-8 at 80 %: it
shares no band (1.93e-7, 4.37e-8) or its signature is too far off (2.1e-8, 5.4e-9).
Null and empty
texts have an empty set and are linked with nothing; a null doc_id is kept,
unlinked. doc_id names a text: repeated rows get one row each. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.membership import likely_members
from .common import discard, free_shuffles, numbered, per_row, renamed_apart, table, to_batch, written
from .components import components

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
#: Bands of rows by percent: a pair at the limit misses all 40 with probability
#: 1.93e-7 at 85 %, all 72 with 4.37e-8 at 80 %.
ROWS = 7
BANDS = {85: 40, 80: 72}
#: Members of a bucket that are compared in one block.
BLOCK = 1024
#: Bands whose buckets are first compared with their smallest member only.
FIRST_BANDS = 8
#: A pair at the limit agrees in so much less of its signature (in standard deviations)
#: with probability 2.1e-8 at 85 %, 5.4e-9 at 80 % (binomial tail).
SIGMAS = 6

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words, A-Z in
    lower case; fewer words are one shingle, none are an empty set."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * _MIX[0] + h[k:k + n] * _MIX[1 + k % 4]
    out ^= out >> np.uint64(32)
    return np.unique(out * _MIX[1])


def hash_family(n: int, seed: int = 7) -> np.ndarray:
    """Odd multipliers and offsets of ``n`` multiply-shift hashes."""
    r = np.random.default_rng(seed)
    return np.stack([r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)])


def signature(items: np.ndarray, family: np.ndarray) -> np.ndarray:
    """Least hash of the set under each function (upper 32 bits)."""
    out = np.empty(family.shape[1], np.uint64)
    for at in range(0, family.shape[1], 40):
        a, b = family[0, at:at + 40, None], family[1, at:at + 40, None]
        least = None
        for cut in range(0, len(items), 4096):  # bounded memory for very long texts
            m = ((a * items[None, cut:cut + 4096] + b) >> np.uint64(32)).min(1)
            least = m if least is None else np.minimum(least, m)
        out[at:at + 40] = least
    return out


def sketches(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """(row, doc_id, n_shingles, set_id, keys, minima) per document; ``row`` numbers
    the rows, set_id digests the set."""

    def make():
        family = hash_family(bands * ROWS)
        powers = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(ROWS)], np.uint64)
        salt = np.arange(bands, dtype=np.uint64) * _MIX[2]

        at = {"row": TaskContext.get().partitionId() << 40}

        def row(doc_id, text):
            items = shingle_set(text or "", width)
            at["row"] += 1
            if not len(items):
                return [(at["row"], doc_id, 0, None, None, None)]
            minima = signature(items, family)
            keys = (minima.reshape(bands, ROWS) * powers).sum(1, dtype=np.uint64) + salt
            keys = (keys ^ (keys >> np.uint64(31))) * _MIX[3]
            return [(at["row"], doc_id, len(items), hashlib.blake2b(items.tobytes(), digest_size=16).digest(), keys.view(np.int64).tolist(), minima.astype(np.uint8).tobytes())]

        return row

    return per_row(docs.select("doc_id", "text"), "row long, doc_id long, n_shingles long, set_id binary, keys array<long>, minima binary", make, 512)


def _alike(minima: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Share of equal signature bytes, chance agreement taken off."""
    same = (minima == one).mean(1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _least_alike(percent: int, bands: int) -> float:
    p = percent / 100
    return p - SIGMAS * (p * (1 - p) / (bands * ROWS)) ** 0.5


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, items) with the full sets of the documents ``nodes`` (doc_id)."""

    def make():
        done: set = set()  # rows of one doc_id mostly meet in a task; a pair confirmed twice is one link

        def row(doc_id, text):
            if doc_id not in done:
                done.add(doc_id)
                yield doc_id, shingle_set(text or "", width).tobytes()

        return row

    # an inner join: a semi-join would be moved below the bitmap's, and all texts shuffled
    wanted = likely_members(docs.select("doc_id", "text"), nodes, "doc_id").join(nodes, "doc_id").select("doc_id", "text")
    return written(per_row(wanted, "node long, items binary", make, 256), "op7-sets", "none")


def _confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the written pairs (u, v) whose full sets are alike enough."""

    def make():
        def row(u, v, a, b):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                return
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                yield u, v

        return row

    sets = _sets(docs, pairs.select("u").union(pairs.select("v")).toDF("doc_id").distinct(), width)
    first = pairs.select("u", "v").join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u")
    linked = written(per_row(first.join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v").select("u", "v", "a", "b"), "u long, v long", make), "op7-links")
    discard(sets)
    return linked


def _with_smallest(members: DataFrame, minima: DataFrame, least: float) -> DataFrame:
    """Candidate pairs of each bucket's members with its smallest, alike by signature."""
    smallest = members.groupBy("key").agg(F.min("node").alias("u"))
    pairs = members.join(smallest, "key").filter("node != u").select("u", F.col("node").alias("v")).distinct()
    both = pairs.join(minima.select(F.col("node").alias("u"), F.col("minima").alias("a")), "u")
    both = both.join(minima.select(F.col("node").alias("v"), F.col("minima").alias("b")), "v")

    def make():
        def row(u, v, a, b):
            if _alike(np.frombuffer(a, np.uint8)[None], np.frombuffer(b, np.uint8))[0] >= least:
                yield u, v

        return row

    return per_row(both.select("u", "v", "a", "b"), "u long, v long", make)


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first ``by`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(by)])
        starts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(by)):
            yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(starts, [*starts[1:], None]):
            if start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, None if end is None else end - start))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(members: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """(key, m, p, is_probe, node, component): of buckets of several components,
    members of all but the largest one there (probes) against all, in groups of
    one block of probes (``p``) and one block of members (``m``)."""
    held = members.join(found.withColumnRenamed("component", "c"), "node", "left").withColumn("component", F.coalesce("c", "node")).drop("c")
    sizes = held.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("rows"), F.max("n").alias("most"), F.max_by("component", "n").alias("big")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / block).cast("int")
    buckets = buckets.select("key", "big", blocks(F.col("rows")).alias("all_blocks"), blocks(F.col("rows") - F.col("most")).alias("probe_blocks"))
    rows = held.join(buckets, "key").withColumn("probe", F.col("component") != F.col("big"))
    h = F.xxhash64("node")
    own_row, own_probe = F.pmod(h, F.col("all_blocks")).cast("int"), F.pmod(h, F.col("probe_blocks")).cast("int")
    as_member = F.transform(F.sequence(F.lit(0), F.col("probe_blocks") - 1), lambda p: F.struct(own_row.alias("m"), p.alias("p"), F.lit(False).alias("is_probe")))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("all_blocks") - 1), lambda m: F.struct(m.alias("m"), own_probe.alias("p"), F.lit(True).alias("is_probe")))
    sides = F.when(F.col("probe"), F.concat(as_member, as_probe)).otherwise(as_member)
    return rows.select("key", "node", "component", F.explode(sides).alias("s")).select("key", "s.m", "s.p", "s.is_probe", "node", "component")


_GROUP = ["key", "m", "p"]


def _in_groups(rows: DataFrame, schema: str, of: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    """``of`` every group of the dealt ``rows``, which begin with key, m, p."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for group in _groups(batches, len(_GROUP)):
            held += of(group) if group.num_rows > 1 else []
            if len(held) >= 4096:
                yield to_batch(held, arrow)
                held = []
        if held:
            yield to_batch(held, arrow)

    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, schema)


class _Group:
    """A group's rows as arrays, and the pairs in it that are alike by signature."""

    def __init__(self, group: pa.Table, least: float):
        self.probe, self.nodes, self.parts = (group.column(c).to_numpy() for c in ("is_probe", "node", "component"))
        self.minima = np.frombuffer(b"".join(group.column("minima").to_pylist()), np.uint8).reshape(len(self.nodes), -1)
        self.keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(self.nodes), -1)
        self.key, self.least = group.column("key")[0].as_py(), least

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each probe with the members of other components that it meets here first of all bands they share."""
        here = np.flatnonzero(~self.probe)
        for i in np.flatnonzero(self.probe):
            other = here[self.parts[here] != self.parts[i]]
            other = other[_alike(self.minima[other], self.minima[i]) >= self.least]
            if len(other):
                first = (self.keys[other] == self.keys[i]).argmax(1)
                other = other[self.keys[i][first] == self.key]
            if len(other):
                yield i, other


def _across(dealt: DataFrame, minima: DataFrame, least: float) -> DataFrame:
    """(key, m, p, u, v): the pairs alike by signature, or only the group (u and v null) if it has more of them than rows."""

    def of(group: pa.Table) -> list[tuple]:
        g, out = _Group(group, least), []
        at = tuple(group.column(c)[0].as_py() for c in _GROUP)
        for i, other in g.pairs():
            out += [(*at, int(min(g.nodes[i], n)), int(max(g.nodes[i], n))) for n in g.nodes[other]]
            if len(out) > len(g.nodes):
                return [(*at, None, None)]
        return out

    return _in_groups(dealt.join(minima, "node").select(*_GROUP, "is_probe", "node", "component", "minima", "keys"), "key long, m int, p int, u long, v long", of)


def _linked_in(dealt: DataFrame, minima: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """(u, v): links found on full sets within the groups, as few as join their components."""

    def of(group: pa.Table) -> list[tuple]:
        g, out, top = _Group(group, least), [], {}
        items = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
        sizes = np.array([len(x) for x in items])

        def root(part: int) -> int:
            while top.get(part, part) != part:
                top[part] = top.get(top[part], top[part])
                part = top[part]
            return part

        for i, other in g.pairs():
            own, n = items[i], sizes[i]
            other = other[100 * np.minimum(sizes[other], n) >= percent * np.maximum(sizes[other], n)]
            for at in range(0, len(other), 64):
                some = [j for j in other[at:at + 64] if root(g.parts[j]) != root(g.parts[i])]
                if not some:
                    continue
                every = np.concatenate([items[j] for j in some])
                place = np.minimum(np.searchsorted(own, every), n - 1)
                both = np.add.reduceat(own[place] == every, np.cumsum([0, *sizes[some][:-1]]), dtype=np.int64)
                for j, k in zip(some, both):
                    if 100 * k >= percent * (n + sizes[j] - k) and root(g.parts[j]) != root(g.parts[i]):
                        top[root(g.parts[j])] = root(g.parts[i])
                        out.append((int(min(g.nodes[i], g.nodes[j])), int(max(g.nodes[i], g.nodes[j]))))
        return out

    rows = dealt.join(minima, "node").join(sets, "node").select(*_GROUP, "is_probe", "node", "component", "minima", "keys", "items")
    return _in_groups(rows, "u long, v long", of)


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return _near(docs, width, percent, block)[0]


def _near(docs: DataFrame, width: int, percent: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``near_duplicates``, and the written stage that it reads."""
    if percent < min(BANDS):
        raise ValueError(f"bands are laid out for {min(BANDS)} percent and more")
    bands = BANDS[max(b for b in BANDS if b <= percent)]
    least = _least_alike(percent, bands)
    seen = written(sketches(docs, width, bands), "op7-sketches")
    # one row of each class: its smallest doc_id, and of that the first row
    rows = seen.filter("doc_id is not null and n_shingles > 0").groupBy("set_id", "doc_id").agg(F.min("row").alias("row"))
    classes = rows.groupBy("set_id").agg(F.min("doc_id").alias("node"))
    chosen = rows.join(classes.withColumnRenamed("node", "doc_id"), ["set_id", "doc_id"]).select("row")
    nodes = seen.join(chosen, "row", "left_semi")
    keyed = nodes.select(F.col("doc_id").alias("node"), F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("key")
    members = written(keyed.join(shared, "key").select("key", "band", "node"), "op7-members")
    minima = written(nodes.select(F.col("doc_id").alias("node"), "minima", "keys").join(members.select("node").distinct(), "node", "left_semi"), "op7-minima")

    pairs = written(_with_smallest(members.filter(F.col("band") < FIRST_BANDS), minima, least), "op7-pairs")
    links = _confirm(pairs, docs, width, percent)
    found = written(components(links), "op7-components")
    discard(pairs)
    dealt = written(_dealt(members.select("key", "node"), found, block), "op7-dealt")
    tried = written(_across(dealt, minima, least), "op7-across")
    pairs = written(tried.filter("u is not null").select("u", "v").distinct(), "op7-pairs")
    dense = written(dealt.join(tried.filter("u is null").select(*_GROUP), _GROUP, "left_semi"), "op7-dense")
    sets = _sets(docs, dense.select(F.col("node").alias("doc_id")).distinct(), width)
    inside = written(_linked_in(dense, minima, sets, least, percent), "op7-links")
    links = links.union(_confirm(pairs, docs, width, percent)).union(inside)
    found = written(components(links), "op7-components")
    discard(members, minima, dealt, tried, pairs, dense, sets)
    by_class = classes.join(found.withColumnRenamed("component", "least"), "node", "left").select("set_id", F.coalesce("least", "node").alias("component_id"))
    out = seen.select("doc_id", "n_shingles", "set_id").join(by_class, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), seen


def keep_one(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """One row of each group of near copies: of the smallest doc_id (null after
    all others), the first. Rows are linked by their own numbers, so those that
    repeat or lack a doc_id are in the groups too."""
    given = renamed_apart(docs)
    rows = numbered(given, "op7-rows")
    groups, sketched = _near(rows.select(F.col("_row").alias("doc_id"), "text"), width, percent)
    named = rows.select("doc_id", "_row").join(groups.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    kept = written(kept.select("_row"), "op7-kept")
    discard(sketched)
    free_shuffles(docs.sparkSession)
    return rows.join(kept, "_row", "left_semi").select(*given.columns).toDF(*docs.columns)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
