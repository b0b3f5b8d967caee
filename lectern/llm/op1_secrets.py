"""Operator 1: secrets by fixed patterns and character Markov models.

Base spans are the leftmost non-overlapping matches of three fixed patterns.
Further spans: every run of token characters of ``MIN_RUN`` and more with a
digit and a letter in it whose log-likelihood ratio between two character bigram models,
one of random strings and one of ordinary identifiers, is high enough a
character and that overlaps no base span.

The models are trained from labelled strings. Random: what the base patterns
find in the training documents, and digests of their ids in hexadecimal and
base 64. Ordinary: the words of those documents outside base spans, and pairs
of them joined as identifiers are. The training documents are at most
``TRAIN_DOCS``, those with the smallest hash of doc_id: a documented bound of
the fit only; every document is scanned whole.

DataFrame functions only. Positions come from marking each match with two
private-use characters (first replaced in the text, one for one) and adding up
the lengths between marks.

Null and empty texts have no spans; rows with equal ids are scanned each for
itself; a null doc_id is kept and not trained on; an empty table gives no rows;
other columns are not read by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The base patterns, in the order of the kinds. A run of fewer
#: characters than its kind asks for never holds a longer one, so for the last
#: two the least length stands in the pattern.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

MIN_VALUE = 6
MIN_RUN = 16
#: Nats a character by which a run must look more random than ordinary.
MIN_RATIO = 0.8
TRAIN_DOCS = 4000
#: Random strings drawn from each training document's id.
DRAWN = 4
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_"
RUN = r"[A-Za-z0-9+/_]{%d,}" % MIN_RUN

_OPEN, _CLOSE, _NEITHER = "", "", ""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_marks(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE)), F.translate(text, _OPEN + _CLOSE, _NEITHER * 2)).otherwise(text)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) in code points, end exclusive; ``text`` has no marks."""
    marked = F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}")
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def add(acc: Column, part: Column) -> Column:
        found = F.substring_index(part, _CLOSE, 1)
        end = acc["at"] + F.length(found)
        return F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"), found.alias("match")))).alias("found"))

    def spans(parts: Column) -> Column:
        zero = F.struct(F.length(F.element_at(parts, 1)).alias("at"), none.alias("found"))
        return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), zero, add)["found"]

    return F.when(text.rlike(pattern), let(F.split(marked, _OPEN), spans)).otherwise(none)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1)) >= MIN_VALUE)
    return assign, matches(text, ACCESS), matches(text, HEX)


def found_in(docs: DataFrame) -> DataFrame:
    """The rows with ``clean`` (text without marks), assign, access, hex."""
    held = docs.withColumn("clean", without_marks(F.col("text")))
    assign, access, hex_ = base_spans(F.col("clean"))
    return held.select("*", assign.alias("assign"), access.alias("access"), hex_.alias("hex"))


def bigrams(strings: DataFrame) -> DataFrame:
    """(pair, n): in how many of the strings of column ``s`` each character pair
    is, so that no single long one decides."""
    def pairs(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1)))

    found = strings.filter(F.length("s") > 1).select(F.explode(F.array_distinct(let(F.split("s", ""), pairs))).alias("pair"))
    return found.groupBy("pair").agg(F.count("*").alias("n"))


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios of the character pairs, row by row of ``ALPHABET``."""
    keys = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    sample = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id")  # TRAIN_DOCS ids
    held = found_in(sample)
    digests = F.transform(F.sequence(F.lit(1), F.lit(DRAWN)), lambda k: F.sha2(F.concat_ws("-", F.col("doc_id"), k).cast("binary"), 256))
    drawn = F.flatten(F.transform(digests, lambda d: F.array(F.base64(F.unhex(d)), d)))
    value = F.transform("assign", lambda m: F.regexp_extract(m["match"], ASSIGN, 1))
    rest = F.transform(F.concat("access", "hex"), lambda m: m["match"])
    random = held.select(F.explode(F.concat(value, rest, drawn)).alias("s")).select(F.regexp_replace("s", "[^A-Za-z0-9+/_]", "").alias("s"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("clean", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.regexp_extract_all(plain, F.lit(r"\b[A-Za-z]{3,}\b"), F.lit(0))
    ordinary = held.select(words.alias("words")).select(F.explode(F.concat("words", F.filter(F.transform("words", lambda w, i: F.concat(
        w, F.when(i % 2 == 0, F.concat(F.lit("_"), F.lower(F.get(F.col("words"), i + 1)))).otherwise(F.initcap(F.get(F.col("words"), i + 1))))), lambda x: x.isNotNull()))).alias("s"))
    n = len(ALPHABET)
    models = []
    for strings in (random, ordinary):
        counts = [[0.5] * n for _ in range(n)]
        for r in bigrams(strings).collect():  # at most len(ALPHABET) ** 2 rows
            a, b = (ALPHABET.find(c) for c in r["pair"])
            if a >= 0 and b >= 0:
                counts[a][b] += r["n"]
        models.append([[math.log(x / sum(row)) for x in row] for row in counts])
    return [round(x - y, 6) for p, q in zip(*models) for x, y in zip(p, q)]


def ratio(run: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a run, a character pair on average."""
    table_ = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to a constant
    places = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def total(at: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(at) - 1)
        return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.element_at(table_, F.element_at(at, i) * len(ALPHABET) + F.element_at(at, i + 1) + 1))

    return let(places, total) / (F.length(run) - 1)


def scan(docs: DataFrame, model: list[float] | None = None, least: float = MIN_RATIO) -> DataFrame:
    """The rows with assign, access, hex and markov: arrays of (start, end, match)."""
    model = train(docs) if model is None else model
    held = found_in(docs)
    runs = F.when(F.col("clean").rlike(RUN), F.filter(matches(F.col("clean"), RUN), lambda m: m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]")))
    base = F.concat("assign", "access", "hex")
    free = F.filter("runs", lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    held = held.withColumn("runs", F.coalesce(runs, F.array().cast("array<struct<start:int,end:int,match:string>>")))
    markov = F.when(F.size("runs") > 0, F.filter(free, lambda m: ratio(m["match"], model) >= least)).otherwise(F.col("runs"))
    return held.withColumn("markov", markov).drop("runs", "clean")


def _listed(*kinds: str) -> Column:
    """kind:start:end, comma-joined, by start and kind."""
    def of(kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("nth"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    spans = F.concat(*map(of, kinds))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float] | None = None, with_: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced; all rows and columns are kept."""
    names = docs.columns
    inner = docs.select("doc_id", "text", F.struct(*names).alias("_row"))
    found = scan(inner, model)
    spans = F.sort_array(F.concat(*KINDS))

    def cut(acc: Column, m: Column) -> Column:
        begin = F.greatest(m["start"], acc["at"])
        piece = F.when(m["end"] > acc["at"], F.concat(acc["out"], F.substr("text", acc["at"] + 1, begin - acc["at"]), F.when(m["start"] >= acc["at"], F.lit(with_)).otherwise(F.lit("")))).otherwise(acc["out"])
        return F.struct(F.greatest(m["end"], acc["at"]).alias("at"), piece.alias("out"))

    text = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.length("text"))))
    new = F.when(F.size(spans) > 0, text).otherwise(F.col("text"))
    return found.select(*[(new if c == "text" else F.col("_row")[c]).alias(c) for c in names])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_listed(*KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
                        _listed(*KINDS).alias("spans"), n("markov"))
