"""Operator 11: toxicity by gradient-boosted trees with isotonic calibration.

Features are dense numbers of a whole text: densities of three lexicons, how
near second-person words are to hits, the thickest stretch of hits, capitals,
punctuation, symbols and obfuscated spellings. One lexicon is given
(``INSULTS``); the others are learned: beginnings of words, and whole words,
that toxic training texts have far more often than others, by log-likelihood
ratio, those beyond chance among all terms apart from weaker ones. Training
rows are in ``FOLDS`` folds: a row's features come from the lexicon of the
other folds, the probability that is calibrated from trees grown on the other
folds, so no stage trusts what an earlier one has memorised. The lexicon and
the trees that score are those of all folds.

The fit takes at most ``FIT_ROWS`` labelled rows (those of least hash; more
than that changes little and its size is the bound of a broadcast); every text
is read whole and scored. Labels are read of training rows only (crc32 of the
id as text modulo 3 is not 1). Several labels of one id count as toxic if any
is. Null and empty texts have features of zeros and are scored like others. A
null doc_id has no label and is no held-out row. Repeated rows are scored each
for itself. Without training rows of both kinds in each fold, the score is the
smoothed share of toxic training rows. An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, table, written

HOLD_OUT, HELD_OUT = 3, 1
THRESHOLD = 0.7
FIT_ROWS = 100_000
#: Terms of the learned lexicons, at most; the number of documents with a term that makes it count.
LEXICON_TERMS = 4096
LEAST_DOCS = 3
#: Code points of the word beginnings that may become terms.
STEMS = range(3, 9)
#: Nats that a weak term's log-likelihood ratio reaches; strong ones also make up for the number of terms.
WEAK_NATS = 5.0
#: Words around a hit in which a second-person word counts as near, and the length of the thickest stretch.
NEAR, STRETCH = 5, 50
FOLDS = 3
TREES, DEPTH, STEP, LEAST_ROWS = 20, 3, 0.25, 2
#: Steps of probability that calibration tells apart: its rows, whatever the corpus.
GRID = 2000
SEED = 11
#: Code points of a text that are split into words at a time, and words a worker remembers.
SEGMENT, MEMO = 1 << 18, 200_000

INSULTS = frozenset(
    # English
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool fools imbecile cretin loser losers scum trash garbage "
    "worthless pathetic disgusting clown clowns filth filthy vermin parasite pig pigs jerk bastard bitch whore slut asshole "
    "bullshit crap damn fuck fucking fucker shit shitty retard retarded freak ugly hate despicable coward liar "
    # German
    "dumm dummkopf blöd blödmann idiotin trottel arschloch scheiße scheiss schwein drecksau abschaum versager widerlich hure "
    # French
    "imbécile crétin connard connasse salaud salope merde débile ordure raté putain dégoûtant "
    # Spanish
    "idiota idiotas estúpido estúpida imbécil tonto tonta mierda basura cabrón gilipollas puta puto asqueroso perdedor escoria".split())
SECOND = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos "
                   "tú ti tus usted ustedes vosotros vuestro os".split())

#: What a word can be, as bits.
INSULT, STRONG, WEAK, YOU, HIDDEN, SHAPED, STRETCHED, CAPITAL = (1 << k for k in range(8))
HIT = INSULT | STRONG | HIDDEN

FEATURES = ("words", "insults", "strong", "weak", "hits", "distinct_hits", "hits_near_you", "you", "thickest", "hidden", "shaped",
            "stretched", "capital_words", "capitals", "exclamations", "questions", "punctuation", "symbols", "digits", "mean_length")

_LETTERS = re.compile(r"[^\W\d_]+")
_LOOKS = str.maketrans("013457@$!|", "oieastasil")
_THRICE = re.compile(r"(.)\1\1+")


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in pieces that end at white space (or, without any, where they are full)."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
        end = end + 1 if end > at else at + size
        yield text[at:end]
        at = end
    yield text[at:]


def terms(word: str) -> Iterator[str]:
    """A word's beginnings, marked open, and the whole word."""
    yield word
    for k in STEMS:
        if k <= len(word):
            yield word[:k] + "*"


class Lexicon:
    """What each word is; ``strong`` and ``weak`` are sets of terms."""

    def __init__(self, strong: frozenset = frozenset(), weak: frozenset = frozenset()):
        self.strong, self.weak, self.memo = strong, weak, {}

    def _plain(self, word: str) -> int:
        own = tuple(terms(word))
        return (INSULT * (word in INSULTS) | YOU * (word in SECOND)
                | STRONG * (not self.strong.isdisjoint(own)) | WEAK * (not self.weak.isdisjoint(own)))

    def bits(self, token: str) -> int:
        """Of a token between white space."""
        low = token.lower()
        core = low.strip(".,;:!?\"'()[]")
        if core.isalpha():
            out = self._plain(core)
        else:  # letters with something else among them, or none
            parts, out = _LETTERS.findall(low), 0
            for part in parts:
                out |= self._plain(part)
            joined = "".join(_LETTERS.findall(core.translate(_LOOKS))) if parts else ""
            if parts and len(joined) > max(map(len, parts)):
                out |= SHAPED
                if not out & (INSULT | STRONG) and self._plain(joined) & (INSULT | STRONG):
                    out |= HIDDEN
        if _THRICE.search(core):
            thrice = _THRICE.sub(r"\1", core)
            if thrice.isalpha():
                out |= STRETCHED
                if not out & (INSULT | STRONG) and self._plain(thrice) & (INSULT | STRONG):
                    out |= HIDDEN
        if len(token) > 2 and token.isupper():
            out |= CAPITAL
        return out

    def of(self, tokens: list[str]) -> bytes:
        out = list(map(self.memo.get, tokens))
        if None in out:
            for at in [at for at, b in enumerate(out) if b is None]:
                token = tokens[at]
                b = self.memo.get(token)  # it may have come up since
                if b is None:
                    b = self.bits(token)
                    if len(self.memo) < MEMO and len(token) < 64:
                        self.memo[token] = b
                out[at] = b
        return bytes(out)


#: Of a worker process: the lexicons of its last task, whose memos the next one can use.
_WORKER: dict = {}


def _lexicons(sets: list[tuple[frozenset, frozenset]]) -> list[Lexicon]:
    if _WORKER.get("sets") != sets:
        _WORKER.update(sets=sets, lexicons=[Lexicon(*x) for x in sets])
    return _WORKER["lexicons"]


def features(text: str, lexicon: Lexicon) -> list[float]:
    """``FEATURES`` of a whole text."""
    kinds, signs, hits = [], np.zeros(256, np.int64), set()
    for piece in segments(text):
        tokens = piece.split()
        kinds.append(lexicon.of(tokens))
        for k in np.flatnonzero(np.frombuffer(kinds[-1], np.uint8) & HIT):
            hits.add(hash(tokens[k].lower()))
        signs += np.bincount(np.frombuffer(piece.encode(), np.uint8), minlength=256)
    is_ = np.frombuffer(b"".join(kinds), np.uint8)
    n, chars = len(is_), max(len(text), 1)
    if not n:
        return [0.0] * len(FEATURES)

    def share(bit: int) -> float:
        return 100.0 * int(np.count_nonzero(is_ & bit)) / n

    hit, you = np.flatnonzero(is_ & HIT), np.flatnonzero(is_ & YOU)
    near, thick = 0, 0
    if len(hit):
        thick = int((np.searchsorted(hit, hit + STRETCH) - np.arange(len(hit))).max())
        if len(you):
            after = np.minimum(np.searchsorted(you, hit), len(you) - 1)
            gap = np.minimum(np.abs(you[after] - hit), np.abs(you[np.maximum(after - 1, 0)] - hit))
            near = int(np.count_nonzero(gap <= NEAR))
    sign = lambda of: 100.0 * float(signs[np.frombuffer(of, np.uint8)].sum()) / chars
    letters = float(signs[65:91].sum() + signs[97:123].sum())
    return [float(np.log1p(n)), share(INSULT), share(STRONG), share(WEAK), float(np.log1p(len(hit))), float(len(hits)), float(near), share(YOU), float(thick),
            share(HIDDEN), share(SHAPED), share(STRETCHED), share(CAPITAL), 100.0 * float(signs[65:91].sum()) / max(letters, 1.0),
            sign(b"!"), sign(b"?"), sign(b".,;:'\"-()"), sign(b"#$%&*@<>|~^_=+"), sign(b"0123456789"), chars / n]


def _id_hash() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def training_rows(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, toxic, fold) of at most ``rows`` labelled ids, none held out."""
    own = labels.select("doc_id", "toxic").filter((_id_hash() % HOLD_OUT != HELD_OUT) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    each = own.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    h = F.xxhash64("doc_id", F.lit(SEED))
    return each.select("doc_id", "toxic", F.pmod(h, F.lit(FOLDS)).cast("int").alias("fold"), h.alias("h")).orderBy("h", "doc_id").limit(rows).drop("h")


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, fold, toxic, clean): rows of each kind (text, toxic, fold) that have the term."""

    def make():
        held: dict[tuple, Counter] = {}
        memo: dict[str, tuple] = {}

        def flush() -> Iterator[tuple]:
            for (fold, kind), counts in held.items():
                for term, n in counts.items():
                    yield term, fold, n * kind, n * (not kind)
            held.clear()

        def of(word: str) -> tuple:
            out = memo.get(word)
            if out is None:
                out = tuple(terms(word))
                if len(memo) < MEMO // 4 and len(word) < 64:
                    memo[word] = out
            return out

        def row(text, toxic, fold):
            seen: set = set()
            for piece in segments(text or ""):
                seen.update(_LETTERS.findall(piece.lower()))
            held.setdefault((fold, bool(toxic)), Counter()).update(set(chain.from_iterable(map(of, seen))))
            if sum(map(len, held.values())) > 400_000:
                yield from flush()

        row.end = flush
        return row

    counted = per_row(texts.select("text", "toxic", "fold"), "term string, fold int, toxic long, clean long", make, 16_384)
    return counted.groupBy("term").agg(*[F.sum(F.when(F.col("fold") == k, F.col(kind))).alias(f"{kind}{k}") for kind in ("toxic", "clean") for k in range(FOLDS)])


def learn_lexicons(texts: DataFrame, most: int = LEXICON_TERMS) -> list[Lexicon]:
    """From rows (text, toxic, fold): for each fold the lexicon of the others, and last that of all; ``most`` terms of the highest ratio each."""
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in texts.groupBy("fold", "toxic").count().collect()}
    counts = written(term_counts(texts).na.fill(0), "op11-terms")
    beyond = WEAK_NATS + float(np.log(max(counts.count(), 1)))
    out = []
    for left_out in range(FOLDS + 1):
        folds = [k for k in range(FOLDS) if k != left_out]
        toxic_rows, clean_rows = (sum(sizes.get((k, y), 0) for k in folds) for y in (1, 0))
        if not toxic_rows or not clean_rows:
            out.append(Lexicon())
            continue
        base = toxic_rows / (toxic_rows + clean_rows)
        own = counts.select("term", *[sum(F.col(f"{kind}{k}") for k in folds).alias(kind) for kind in ("toxic", "clean")])
        rate = F.col("toxic") / (F.col("toxic") + F.col("clean"))
        other = F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - base))).otherwise(0.0)
        likely = own.filter(F.col("toxic") >= LEAST_DOCS).filter(rate >= max(0.5, base)).withColumn("nats", F.col("toxic") * F.log(rate / base) + other)
        best = likely.filter(F.col("nats") >= WEAK_NATS).orderBy(F.desc("nats"), "term").limit(most).select("term", "nats").collect()
        strong = frozenset(r["term"] for r in best if r["nats"] >= beyond)
        out.append(Lexicon(strong, frozenset(r["term"] for r in best) - strong))
    return out


def with_features(texts: DataFrame, lexicons: list[Lexicon]) -> DataFrame:
    """(doc_id, fold, features) of every row (doc_id, text, fold): by the fold's lexicon, without a fold by the last."""
    sets = [(x.strong, x.weak) for x in lexicons]

    def make():
        own = _lexicons(sets)
        return lambda doc_id, text, fold: [(doc_id, fold, features(text or "", own[-1 if fold is None else fold]))]

    return per_row(texts.select("doc_id", "text", "fold"), "doc_id long, fold int, features array<double>", make, 2048)


class Model:
    """Trees and the calibration of their probabilities."""

    def __init__(self, trees: GBTClassificationModel, steps: IsotonicRegressionModel):
        self.trees, self.steps = trees, steps

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score`` in place of ``features``."""
        return self.steps.transform(_rounded(self.trees.transform(_vectors(rows)))).drop("features", "rawPrediction", "probability", "prediction", "p").withColumnRenamed("calibrated", "score")


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector("features"))


def _rounded(scored: DataFrame) -> DataFrame:
    """With ``p``: the trees' probability to the nearest of ``GRID`` steps."""
    return scored.withColumn("p", F.round(vector_to_array("probability")[1] * GRID) / GRID)


def _grow(rows: DataFrame) -> GBTClassificationModel:
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=LEAST_ROWS, seed=SEED, checkpointInterval=-1).fit(rows.select("features", "label"))


def fit(rows: DataFrame) -> Model | None:
    """From rows (features, toxic, fold); None if a fold lacks a kind."""
    kinds = rows.select("fold", "toxic").distinct().count()
    if kinds < 2 * FOLDS:
        return None
    vectors = _vectors(rows).withColumn("label", F.col("toxic").cast("double"))
    placed = None
    for k in range(FOLDS):
        own = _rounded(_grow(vectors.filter(F.col("fold") != k)).transform(vectors.filter(F.col("fold") == k))).select("p", "label")
        placed = own if placed is None else placed.union(own)
    weighed = placed.groupBy("p", "label").agg(F.count("*").cast("double").alias("weight"))  # 2 * (GRID + 1) rows at most
    # a quarter of a row of each kind at both ends, so that no score is certain
    ends = rows.sparkSession.createDataFrame([(x, y, 0.25) for x in (0.0, 1.0) for y in (0.0, 1.0)], "p double, label double, weight double")
    steps = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(weighed.unionByName(ends))
    return Model(_grow(vectors), steps)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    texts = docs.select("doc_id", "text")
    chosen = F.broadcast(written(training_rows(labels, fit_rows), "op11-chosen"))  # ``fit_rows`` small rows at most
    learning = texts.join(chosen, "doc_id")
    lexicons = learn_lexicons(learning)
    model = fit(written(with_features(learning, lexicons).join(chosen.drop("fold"), "doc_id"), "op11-learning"))
    seen = with_features(texts.withColumn("fold", F.lit(None).cast("int")), lexicons).drop("fold")
    if model is None:
        toxic_rows, rows = chosen.agg(F.sum("toxic"), F.count("*")).head()
        scored = seen.select("doc_id", F.lit(((toxic_rows or 0) + 0.5) / (rows + 1)).alias("score"))
    else:
        scored = model.score(seen)
    held_out = _id_hash() % HOLD_OUT == HELD_OUT
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
