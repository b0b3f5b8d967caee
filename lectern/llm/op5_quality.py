"""Operator 5: quality rules and robust multivariate outliers.

Base statistics come from one pass over the whole texts. The verdict: per
(lang, source), the minimum-covariance-determinant estimate of location and
scatter of the transformed statistics, and rejection by Mahalanobis distance.

The MCD is found by concentration steps over all rows: distances to the
current estimate, the cut that the closest ``SUPPORT`` of a group meet, then
mean and covariance of the rows within. Statistics are fixed-point integers
and moments their exact sums, so a result doesn't depend on how rows are
dealt. Steps start from coordinate medians and MADs; the estimates (one row a
group) are solved in Arrow-batched tasks and joined back, so no group is ever
in one task: sums and exact percentiles over bounded integers combine per task.

Every group has an estimate of its own, and small ones have little to go by:
location and scatter are means of the group's own, weighted by its rows, and
its language's, weighted by ``PRIOR_ROWS``; a language's likewise of its own
and that of all rows. No size decides between estimates. The three kinds of
groups go through the same jobs, every row being part of one of each kind, so
that the driver plans few jobs, whatever the size.

Null and empty texts have no words: zero statistics, base-failed, not in any
estimate. Null lang or source is a group of its own. Rows with equal ids are
judged each for itself; an empty table gives no rows; further columns are not
read by ``quality`` and are kept by ``keep_clean``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, table, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a group's rows that its estimate rests on: the least that can be, as
#: copies or junk may hold a third of a group and more and must all stay outside.
SUPPORT = 0.5
STEPS = 4
#: Rows that the wider group's estimate counts for in a group's.
PRIOR_ROWS = 60
#: Squared distance beyond which a row is rejected. Far above the chi-square
#: quantiles of 5 dimensions (20.5 at 0.999): the statistics have long tails.
MAX_DISTANCE = 64.0
#: Fixed-point unit of the transformed statistics.
SCALE = 4096
#: Least spread of each: most texts have no symbol, repeat or equal line at
#: all, and a group's scatter there would be zero.
FLOORS = (0.08, 0.01, 0.06, 0.5, 0.08)
DIMS = len(FLOORS)
#: A group: all rows (level 0), a language's (1) or a language and source's (2).
GROUP = ["level", "lang", "source"]
_ESTIMATES = "level int, lang string, source string, rows long, m array<double>, p array<double>"

_SPACES = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(end, i)
            end = i + 3
    return total


def text_statistics(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x and x.strip(_SPACES)]
    return (len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(set(words)))


def statistics(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source and the counts."""
    return per_row(
        docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), "text"),
        "doc_id long, lang string, source string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_distinct long",
        lambda: lambda doc_id, lang, source, text_hash, text: [(doc_id, lang, source, text_hash, *text_statistics(text or ""))])


def transformed() -> list[Column]:
    """The statistics in the form that is judged, as fixed-point longs."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    values = [
        F.log(chars / n),  # mean word length
        F.col("n_symbols") / chars,
        F.col("n_repeat_words") / n,
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.log(F.greatest(F.col("n_distinct"), F.lit(1)) / n) + 0.15 * F.log(n),  # variety, allowing for length
    ]
    return [F.round(v * SCALE).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def _distance() -> Column:
    """Squared Mahalanobis distance from columns x, m (means) and p (inverse scatter, row by row)."""
    d = [(F.col(f"x{i}") / SCALE - F.col("m")[i]) for i in range(DIMS)]
    return sum(F.col("p")[i * DIMS + j] * d[i] * d[j] * (1 if i == j else 2) for i in range(DIMS) for j in range(i, DIMS))


def leveled(rows: DataFrame) -> DataFrame:
    """x0, x1, ... of every row once for each group that it is part of."""
    none = F.lit(None).cast("string")
    groups = [F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"))
              for level, (lang, source) in enumerate(((none, none), (F.col("lang"), none), (F.col("lang"), F.col("source"))))]
    return rows.select(F.explode(F.array(*groups)).alias("group"), *[f"x{i}" for i in range(DIMS)]).select("group.*", *[f"x{i}" for i in range(DIMS)])


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and MADs on the diagonal, by group."""
    half = [F.percentile(f"x{i}", 0.5).alias(f"q{i}") for i in range(DIMS)]
    medians = rows.groupBy(*GROUP).agg(*half, F.count("*").alias("rows"))
    both = _onto(rows, medians).groupBy(*GROUP).agg(
        F.max("rows").alias("rows"), *[F.max(f"q{i}").alias(f"q{i}") for i in range(DIMS)],
        *[F.percentile(F.abs(F.col(f"x{i}") - F.col(f"q{i}").cast("long")), 0.5).alias(f"s{i}") for i in range(DIMS)])
    scatter = [F.pow(F.greatest(1.4826 * F.col(f"s{i}") / SCALE, F.lit(FLOORS[i])), -2) for i in range(DIMS)]
    return both.select(*GROUP, "rows", F.array(*[F.col(f"q{i}") / SCALE for i in range(DIMS)]).alias("m"),
                       F.array(*[scatter[i] if i == j else F.lit(0.0) for i in range(DIMS) for j in range(DIMS)]).alias("p"))


def _onto(rows: DataFrame, by_group: DataFrame) -> DataFrame:
    """``rows`` with the columns of their group's row; null is a key like any other.

    ``by_group`` is written first: the planner then knows its true size and
    sends it to the rows where it is small, whatever key is hot.
    """
    renamed = written(by_group, "op5-groups").select(*[F.col(g).alias(f"_{g}") for g in GROUP], *[c for c in by_group.columns if c not in GROUP])
    on = [F.col("level") == F.col("_level"), *[F.col(g).eqNullSafe(F.col(f"_{g}")) for g in GROUP[1:]]]
    return rows.join(renamed, on).drop(*[f"_{g}" for g in GROUP])


def _solve(moments: DataFrame) -> DataFrame:
    """Means and inverse scatter of each group's sums."""
    n_group = len(GROUP)

    def make():
        def row(*v):
            keys, rows, n, sums, products = v[:n_group], v[n_group], v[n_group + 1], v[n_group + 2], v[n_group + 3]
            mean = np.array([int(s) for s in sums]) / n / SCALE
            cov = np.zeros((DIMS, DIMS))
            cov[np.triu_indices(DIMS)] = np.array([int(s) for s in products]) / n / SCALE**2
            cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
            # a subset of the closest rows has too small a scatter: brought up to the whole group's by its share
            cov = cov * _consistency(min(1.0, n / rows)) + np.diag(np.square(FLOORS))
            yield (*keys, rows, mean.tolist(), np.linalg.inv(cov).ravel().tolist())

        return row

    return per_row(moments, _ESTIMATES, make)


def _consistency(share: float) -> float:
    """share / P(chi2 with DIMS + 2 < q), q the share's chi2 quantile with DIMS degrees."""
    if share >= 0.9999:
        return 1.0
    grid = np.linspace(0, 60, 60_001)[1:]
    densities = [grid ** (k / 2 - 1) * np.exp(-grid / 2) for k in (DIMS, DIMS + 2)]
    a, b = (np.cumsum(d) / d.sum() for d in densities)
    return share / b[min(np.searchsorted(a, share), len(b) - 1)]


def estimates(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """MCD location ``m`` and inverse scatter ``p`` per group, from rows with x0, x1, ..."""
    at = _start(rows)
    for _ in range(steps):
        # distances in bounded integer steps (2 % each), so that their percentile is exact and small
        step = F.floor(F.log(_distance() + 1e-3) * 50).cast("int")
        cut = _onto(rows, at).groupBy(*GROUP).agg(F.percentile(step, support).alias("cut"), *[F.first(c).alias(c) for c in ("rows", "m", "p")])
        within = _onto(rows, cut).filter(step <= F.ceil("cut"))
        moments = within.groupBy(*GROUP).agg(
            F.max("rows").alias("rows"), F.count("*").alias("n"),
            F.array(*[F.sum(f"x{i}") for i in range(DIMS)]).alias("sums"),
            F.array(*[F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(38,0)")) for i in range(DIMS) for j in range(i, DIMS)]).alias("products"))
        at = _solve(moments)
    return written(at, "op5-estimates")


def shrunk(groups: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Estimates of each language and source, drawn to their language's, which is drawn to that of all rows."""
    def at(level, name):
        return groups.filter(F.col("level") == level).select(*[F.col(c).alias(f"{name}_{c}") for c in ("lang", "source", "rows", "m", "p")])

    own, wide, widest = at(2, "own"), at(1, "wide"), at(0, "widest")
    both = own.join(wide, F.col("own_lang").eqNullSafe(F.col("wide_lang"))).crossJoin(widest)

    def drawn(rows, m, p, wide_m, wide_p):
        w = rows / (rows + prior_rows)
        scatter = w * _inverse(p) + (1 - w) * _inverse(wide_p)
        return w * np.array(m) + (1 - w) * np.array(wide_m), np.linalg.inv(scatter).ravel()

    def make():
        def row(lang, source, rows, m, p, wide_rows, wide_m, wide_p, widest_m, widest_p):
            mean, inverse = drawn(rows, m, p, *drawn(wide_rows, wide_m, wide_p, widest_m, widest_p))
            yield (lang, source, mean.tolist(), inverse.tolist())

        return row

    columns = [f"own_{c}" for c in ("lang", "source", "rows", "m", "p")] + [f"wide_{c}" for c in ("rows", "m", "p")] + ["widest_m", "widest_p"]
    return per_row(both.select(*columns), "lang string, source string, m array<double>, p array<double>", make)


def _inverse(p: list[float]) -> np.ndarray:
    return np.linalg.inv(np.array(p).reshape(DIMS, DIMS))


def quality(docs: DataFrame, max_distance: float = MAX_DISTANCE, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Statistics, base verdict, squared distance and verdict of every document."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = written(statistics(docs), "op5-statistics")
    rows = stats.select("*", failed.alias("base_failed"), *transformed())
    sound = rows.filter(~F.col("base_failed"))
    own = shrunk(estimates(leveled(sound)), prior_rows)
    own = written(own, "op5-groups").select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "m", "p")
    judged = rows.join(own, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= max_distance, F.lit(True))
    return judged.select("doc_id", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    verdicts = quality(docs).filter("kept").select(*[F.col(c).alias(f"_kept_{c}") for c in ("doc_id", "lang", "source", "text_hash")]).distinct()
    here = {"doc_id": docs["doc_id"], "lang": docs["lang"], "source": docs["source"], "text_hash": F.xxhash64(docs["text"])}
    return docs.join(verdicts, [c.eqNullSafe(F.col(f"_kept_{k}")) for k, c in here.items()], "left_semi")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("lang", "source", "text_hash")
