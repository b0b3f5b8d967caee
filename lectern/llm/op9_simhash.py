"""Operator 9: SimHash fingerprints and their search within a Hamming radius.

A fingerprint has ``BITS`` bits: the 64-bit hash of every word votes on each
with the word's weight (its length beyond ``SHORT`` characters, at least 1: the
longer a word, the more it tells texts apart); a bit is set if more weight
votes for it than against. Votes are sums over exploded words, two bits to a
long, combined per task before they are shuffled.

``within`` finds all fingerprints in a radius by permuted block tables: of
radius + 2 blocks at least two are equal, so every pair of blocks is a table's
key. Equal fingerprints are one class with a count and its smallest doc_id, so
copies don't multiply; ``links`` names what was found by class.

A document's follower is the next in ascending doc_id (after the last: the
first); documents are dealt to parts by quantiles of doc_id and of the text's
beginning, so that an id that many rows have, or lack, fills several parts.
There are ``MAX_PARTS`` at most, whatever the input. Only the first document
of each part is looked up from the one before, by an equi-join on the part's
number. DataFrame functions only.

Null and empty texts are empty: no bit is set. Rows with equal doc_id follow
each other by text (those that also begin with the same bytes are in one
part); a null doc_id comes first; a single row follows itself; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BITS = 64
SHORT = 3
RADIUS = 3
#: Rows that a window over one part of the documents holds, about.
PART_ROWS = 2000
#: Parts at most: half a megabyte of bounds on the driver and in a task.
MAX_PARTS = 1 << 16
#: Bytes of a text that tell rows of one doc_id apart when they are dealt.
FIRST_BYTES = 6
#: Documents with doc_id divisible by this are the search's queries.
QUERY_EVERY = 100

_SPLIT = r"[ \t\n\x0B\f\r]+"


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fingerprint long) of the rows (keys, text); ``keys`` name a row."""
    words = texts.select(*keys, F.explode(F.split(F.coalesce("text", F.lit("")), _SPLIT)).alias("word"))
    weight = F.when(F.col("word") == "", 0).otherwise(F.greatest(F.length("word") - SHORT, F.lit(1))).cast("long")
    hashed = words.select(*keys, F.xxhash64("word").alias("h"), weight.alias("w"))
    half = BITS // 2

    def votes(i: int) -> Column:
        low = F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1))
        high = F.shiftrightunsigned("h", i + half).bitwiseAND(F.lit(1))
        return F.sum(F.col("w") * (low + F.shiftleft(high, half))).alias(f"v{i}")

    sums = hashed.groupBy(*keys).agg(F.sum("w").alias("all"), *[votes(i) for i in range(half)])

    def bit(i: int) -> Column:
        v = F.col(f"v{i % half}")
        count = v.bitwiseAND(F.lit((1 << half) - 1)) if i < half else F.shiftrightunsigned(v, half)
        return F.when(2 * count > F.col("all"), F.lit(1 << i if i < BITS - 1 else -(1 << i)).cast("long")).otherwise(F.lit(0).cast("long"))

    out = bit(0)
    for i in range(1, BITS):
        out = out.bitwiseOR(bit(i))
    return sums.select(*keys, out.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def parts_of(docs: DataFrame, rows: int = PART_ROWS) -> Column:
    """The part of a row (doc_id, text): parts are ranges with about as many rows each."""
    count, least = docs.agg(F.count("*"), F.min("doc_id")).head()
    n = min(max(1, count // rows), MAX_PARTS)
    begin = F.substring(F.substring(F.coalesce("text", F.lit("")), 1, FIRST_BYTES).cast("binary"), 1, FIRST_BYTES)
    begin = F.conv(F.rpad(F.hex(begin), 2 * FIRST_BYTES, "0"), 16, 10).cast("double") / float(1 << 8 * FIRST_BYTES)
    # grows with (doc_id, text), a missing doc_id first; rounding keeps the order
    key = F.coalesce(F.col("doc_id").cast("double") - float(least or 0) + 1, F.lit(0.0)) + begin
    shares = [k / n for k in range(1, n)]
    bounds = sorted(set(docs.select(F.percentile_approx(key, shares, 10 * n)).head()[0] or [])) if shares else []
    if not bounds:
        return F.lit(0)
    listed = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")  # folded to a constant
    # the stretch of bounds first, then the place in it: about 2 * sqrt(n) comparisons
    wide = isqrt(len(bounds)) + 1
    ends = F.split(F.lit(",".join(map(repr, bounds[wide - 1::wide]))), ",").cast("array<double>")
    stretch = F.size(F.filter(ends, lambda b: b < key)) * wide if len(bounds) >= wide else F.lit(0)
    return stretch + F.size(F.filter(F.slice(listed, stretch + 1, F.lit(wide)), lambda b: b < key))


def with_next(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The rows with ``next_<column>`` of the following row and ``nth`` in their
    part; rows have ``part``, and parts follow each other."""
    w = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    held = rows.withColumns({"nth": F.row_number().over(w), "_next": F.lead(F.struct(*columns)).over(w)})
    least = F.min(F.struct(F.col(order[0]).isNotNull().alias("given"), F.col(order[0]).alias("least")))
    least = written(rows.groupBy("part").agg(least.alias("l")).select(F.col("part").alias("_of"), F.col("l.least").alias("_least")), "op9-first")
    heads = rows.join(least, (F.col("part") == F.col("_of")) & F.col(order[0]).eqNullSafe(F.col("_least")), "left_semi")
    first = heads.groupBy("part").agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("f")).withColumnRenamed("part", "_part")
    by_part = Window.orderBy("_of")  # part numbers alone, MAX_PARTS at most
    after = F.coalesce(F.lead("_of").over(by_part), F.first("_of").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    follow = least.select("_of", after.alias("_after")).join(first, F.col("_after") == F.col("_part")).select("_of", "f")
    joined = held.join(follow, F.col("part") == F.col("_of"))
    named = {f"next_{c}": F.when(F.col("_next").isNotNull(), F.col("_next")[c]).otherwise(F.col("f")[c]) for c in columns}
    return joined.withColumns(named).drop("_next", "_of", "f")


def classes(rows: DataFrame) -> DataFrame:
    """(fingerprint, n, class_id) of the distinct fingerprints; class_id is the smallest doc_id."""
    named = F.min("doc_id") if "doc_id" in rows.columns else F.lit(None).cast("long")
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"), named.alias("class_id"))


def within(queries: DataFrame, all_: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fingerprint, n, class_id): all fingerprints of ``all_`` in the radius
    of each distinct one of ``queries``, with how many rows have it and, if
    ``all_`` has doc_id, the smallest (else null)."""
    blocks = radius + 2
    cuts = [BITS * k // blocks for k in range(blocks + 1)]

    def keys(fp: str) -> Column:
        block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
        return F.explode(F.array(*[F.struct(F.lit(t).alias("t"), block[i].alias("a"), block[j].alias("b")) for t, (i, j) in enumerate(combinations(range(blocks), 2))]))

    entries = classes(all_)
    asked = queries.select(F.col("fingerprint").alias("query")).distinct()
    left = asked.select("query", keys("query").alias("k")).select("query", "k.*")
    right = entries.select("fingerprint", "n", "class_id", keys("fingerprint").alias("k")).select("fingerprint", "n", "class_id", "k.*")
    near = left.join(right, ["t", "a", "b"]).filter(F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint"))) <= radius)
    return near.select("query", "fingerprint", "n", "class_id").distinct()


def links(queries: DataFrame, all_: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, class_id, n, distance): for every row of ``queries`` the classes of
    equal fingerprints in the radius, its own among them. Rows are (doc_id,
    fingerprint); ``all_`` with ``classes`` tells a class's members."""
    found = within(queries, all_, radius)
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint"))).alias("distance")
    asked = queries.select("doc_id", F.col("fingerprint").alias("_asked"))
    return asked.join(found, F.col("_asked") == F.col("query")).select("doc_id", "class_id", "n", distance)


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its text with the second half
    replaced by its follower's beginning, and how alike they are."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("part", parts_of(docs.select("doc_id", "text"))), ["text"], ["doc_id", "text"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("part", "nth", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    key = ["part", "nth", "doc_id", "n_chars", "edited_sha256", "side"]
    each = rows.select("part", "nth", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), both.alias("t"))
    each = each.select(*key[:-1], "t.side", "t.text")
    prints = fingerprints(each, key).groupBy(*key[:-1]).agg(
        F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    prints = written(prints, "op9-fingerprints").withColumnRenamed("nth", "place")
    pairs = with_next(prints, ["fingerprint"], ["place"])
    return pairs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def _shown(c: str) -> Column:
    return F.lower(F.lpad(F.hex(c), BITS // 4, "0")).alias(c)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(compare(table(spark, sf_dir, "documents")), "op9-compared")
    is_query = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    queries = found.filter(is_query)
    # at most 43,745 fingerprints are within 3 of 64 bits, so a list of classes is bounded
    near = within(queries, found).groupBy("query").agg((F.sum("n") - 1).alias("n_within"), F.array_join(F.sort_array(F.collect_list("class_id")), ",").alias("near_classes"))
    member = classes(found).select(F.col("fingerprint").alias("_class"), "class_id")
    asked = queries.join(near, F.col("fingerprint") == F.col("query"), "left").drop("query")
    others = found.filter(~is_query).withColumns({"n_within": F.lit(None).cast("long"), "near_classes": F.lit(None).cast("string")})
    out = asked.unionByName(others).join(member, F.col("fingerprint") == F.col("_class"))
    return out.select("doc_id", "n_chars", "edited_sha256", _shown("fingerprint"), _shown("edited_fingerprint"), "near_edited", "near_next", "n_within", "class_id", "near_classes")
