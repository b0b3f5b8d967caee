"""Operator 13: spelling variants by PartEnum signatures of letter multisets.

A word is a binary vector: dimension (letter, k) is set if the letter occurs
at least k times. One inserted, deleted or replaced code point moves it by a
Hamming distance of at most ``DISTANCE`` = 2. Dimensions are dealt to
``PARTS`` = 4 parts of about equal weight; two vectors at most 2 apart differ
in at most 2 parts, so they agree on at least one pair of parts. Every choice
of ``PARTS - DISTANCE`` parts, projected and hashed, is a signature. Of two
words with one edit between them the first or the last ``END`` = 3 code points
agree (words have 6 and more), so a signature also carries one end: fewer words
share it, and no link is lost. Words are equi-joined on signatures; each pair
that meets is verified by its exact edit distance inside the join, so only
near pairs leave it.

Null and empty texts have no words; a null doc_id counts as empty text in the
planted deletions' hash; repeated rows count each; ties go to the smallest
word in code-point order; an empty table gives no rows; other columns are not
read. A run may be as long as its text; tasks hold bounded counts and one text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, table, written

MIN_LENGTH = 6
MIN_COUNT = 5
#: A run whose hash this number divides loses one code point.
TYPO_EVERY = 199
#: A form occurs at least so many times as often as its variant.
FORM_FACTOR = 5
DISTANCE = 2
PARTS = 4
END = 3
#: Occurrences of a letter whose dimensions are dealt by weight; further ones follow a rule.
WEIGHED = 4
#: Words whose counts a task holds before it hands them on.
HELD_WORDS = 300_000

#: Latin-1 bytes: A-Z to lower case, a-z and U+00C0 to U+00FF as they are, all others to a space.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters in Latin-1, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_RUNS).split()


def with_typo(run: bytes, seed: int, every: int = TYPO_EVERY) -> bytes:
    """The run, without one code point if ``every`` divides its hash; ``seed``: crc32 of what precedes it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, n) of all words, planted deletions made."""

    def make():
        held: Counter = Counter()

        def flush():
            for word, n in held.items():
                yield word.decode("latin-1"), n
            held.clear()

        def row(doc_id, text):
            seed = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            for run, n in Counter(runs(text or "")).items():
                word = with_typo(run, seed, typo_every)
                if len(word) >= min_length:
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield from flush()

        row.end = flush
        return row

    counted = per_row(docs.select("doc_id", "text"), "word string, n long", make, 16_384)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def dimensions(word: str) -> list[tuple[str, int]]:
    """The set dimensions of a word's letter multiset, in order."""
    return [(c, k) for c, n in sorted(Counter(word).items()) for k in range(1, n + 1)]


def parts_by_weight(weights: dict[tuple[str, int], int], parts: int = PARTS) -> dict[tuple[str, int], int]:
    """Part of each dimension: heaviest first to the lightest part."""
    load, out = [0] * parts, {}
    for dim, n in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        out[dim] = load.index(min(load))
        load[out[dim]] += n
    return out


def part_of(dim: tuple[str, int], dealt: dict[tuple[str, int], int], parts: int = PARTS) -> int:
    return dealt[dim] if dim in dealt else (ord(dim[0]) + dim[1]) % parts


def signatures(word: str, dealt: dict[tuple[str, int], int], parts: int = PARTS, distance: int = DISTANCE, end: int = END) -> list[int]:
    """Hashes of the projections on every ``parts - distance`` parts, with the first and with the last ``end`` code points."""
    from xxhash import xxh3_64_intdigest

    projected: list[str] = [""] * parts
    for c, k in dimensions(word):
        projected[part_of((c, k), dealt, parts)] += c
    out = []
    for n, chosen in enumerate(combinations(range(parts), parts - distance)):
        body = "\0".join(projected[p] for p in chosen)
        for side, piece in enumerate((word[:end], word[-end:])):
            out.append(xxh3_64_intdigest(f"{n}\0{side}\0{piece}\0{body}") - (1 << 63))
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b: all words (word, n) of at least 2 * ``END`` code points that one edit separates."""

    def weigh():
        seen: Counter = Counter()

        def row(word):
            seen.update(d for d in dimensions(word) if d[1] <= WEIGHED)
            return ()

        row.end = lambda: ((c, k, n) for (c, k), n in seen.items())
        return row

    weighed = per_row(words.select("word"), "letter string, k int, n long", weigh).groupBy("letter", "k").agg(F.sum("n").alias("n"))
    dealt = parts_by_weight({(r["letter"], r["k"]): r["n"] for r in weighed.collect()})  # letters x WEIGHED rows at most

    def sign():
        return lambda word, n: ((s, word, n) for s in signatures(word, dealt))

    signed = per_row(words.select("word", "n"), "sig long, word string, n long", sign, 16_384)
    a, b = (signed.select("sig", F.col("word").alias(x), F.col("n").alias(f"{x}_n"), F.length("word").alias(f"{x}_len")) for x in "ab")
    near = (a["sig"] == b["sig"]) & (a["a"] < b["b"]) & (F.abs(F.col("a_len") - F.col("b_len")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, near).select("a", "a_n", "b", "b_n").distinct()


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of all words with a form (word, form): forms followed to the last, twice as far each round."""
    at = written(links.select("word", F.col("form").alias("root")), "op13-roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "op13-roots")
        at = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return at


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY, factor: int = FORM_FACTOR) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    if min_length < 2 * END:
        raise ValueError(f"signatures need words of at least {2 * END} code points")
    words = written(word_counts(docs, min_length, min_count, typo_every), "op13-words")
    pairs = written(near_pairs(words), "op13-pairs")
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = F.min(F.struct(-F.col("other_n"), "other"))
    near = pairs.select(F.explode(both).alias("p")).select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.col1")).alias("other_n"))
    is_form = F.col("other_n") >= factor * F.col("n")
    formed = written(formed.select("word", "n", "n_near", F.when(is_form, F.col("other")).alias("form"), F.when(is_form, F.col("other_n")).alias("form_n")), "op13-forms")
    found = formed.join(roots(formed.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
