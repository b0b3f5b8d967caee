"""Features and lexicons against plain Python, held-out accuracy, labels kept out of scores."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm.op11_toxicity import (FEATURES, FOLDS, SEGMENT, Lexicon, features, learn_lexicons, segments, term_counts,
                                       terms, toxicity, training_rows)
from tests.conftest import SMALL

LEXICON = Lexicon(frozenset({"grol*", "zaff"}), frozenset({"mib*"}))


def named(text, lexicon=LEXICON):
    return dict(zip(FEATURES, features(text, lexicon)))


def test_words_are_told_apart():
    got = named("You IDIOT, grolling zaff mibs. plain words here")
    n = 8
    assert got["words"] == pytest.approx(math.log1p(n))
    assert got["insults"] == pytest.approx(100 / n) and got["strong"] == pytest.approx(200 / n) and got["weak"] == pytest.approx(100 / n)
    assert got["hits"] == pytest.approx(math.log1p(3)) and got["distinct_hits"] == 3 and got["hits_near_you"] == 3
    assert got["you"] == pytest.approx(100 / n) and got["thickest"] == 3 and got["capital_words"] == pytest.approx(100 / n)


@pytest.mark.parametrize("token", ["1d10t", "st*upid", "s.t.u.p.i.d", "stuuuupid", "$tupid", "id1ot!!"])
def test_obfuscated_spellings(token):
    got = named(f"that {token} thing")
    assert got["hidden"] == pytest.approx(100 / 3) and got["hits"] == pytest.approx(math.log(2))


@pytest.mark.parametrize("token", ["3rd", "rock'n'roll", "well-known", "2024", "a+b", "stupid###", "hello"])
def test_ordinary_spellings_are_not_hidden(token):
    assert named(f"that {token} thing")["hidden"] == 0


def test_proximity_and_stretch():
    far = " x" * 60
    got = named("you a b c d idiot" + far + " moron a b you" + far + " loser loser")
    assert got["hits_near_you"] == 2 and got["thickest"] == 2


def test_empty_and_long_texts():
    assert features("", LEXICON) == [0.0] * len(FEATURES) == features(" \n ", LEXICON)
    long = "word idiot " * 60_000
    got = named(long)
    assert got["words"] == pytest.approx(math.log1p(120_000)) and got["insults"] == pytest.approx(50.0) and got["thickest"] == 25
    assert "".join(segments(long)) == long and max(map(len, segments(long))) <= SEGMENT
    assert "".join(segments("x" * 700_000)) == "x" * 700_000


def labelled(n=600, seed=1):
    """Invented words; toxic texts hold words on the stem quab, with a planted known insult in some."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices(["lo", "re", "ti", "ma", "no", "se"], k=r.randint(1, 4)))
    rows = []
    for i in range(n):
        toxic = r.random() < 0.2
        words = [word() for _ in range(r.randint(5, 80))]
        if toxic:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["quab" + word(), "Quab" + word() + "!", "idiot"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_term_counts_and_lexicons_equal_plain_python(spark):
    rows = [(t, y, i % FOLDS) for i, t, y in labelled(200)] + [(None, 1, 0), ("", 0, 1)]
    given = spark.createDataFrame(rows, "text string, toxic int, fold int").repartition(3)
    want = Counter()
    for text, y, fold in rows:
        for term in {t for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for t in terms(w)}:
            want[term, fold, y] += 1
    got = Counter()
    for r in term_counts(given).na.fill(0).collect():
        for k in range(FOLDS):
            got[r.term, k, 1] += r[f"toxic{k}"]
            got[r.term, k, 0] += r[f"clean{k}"]
    assert +got == want
    found = learn_lexicons(given)
    assert len(found) == FOLDS + 1 and all("quab*" in x.strong for x in found)
    for left_out, lexicon in enumerate(found):
        folds = [k for k in range(FOLDS) if k != left_out]
        own = [(y, f) for _, y, f in rows if f in folds]
        base = sum(y for y, _ in own) / len(own)
        for term in lexicon.strong | lexicon.weak:
            t, c = (sum(want[term, k, y] for k in folds) for y in (1, 0))
            nats = t * math.log(t / (t + c) / base) + (c and c * math.log(c / (t + c) / (1 - base)))
            assert t >= 3 and t / (t + c) >= max(0.5, base) and nats >= 5 - 1e-9


def test_training_rows_keep_held_out_and_missing_labels_away(spark):
    given = [(i, i % 2) for i in range(60)] + [(4, 1), (None, 1), (6, None)]
    got = {r.doc_id: r.toxic for r in training_rows(spark.createDataFrame(given, "doc_id long, toxic int")).collect()}
    want = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert set(got) == want and (4 not in want or got[4] == 1)
    assert training_rows(spark.createDataFrame(given, "doc_id long, toxic int"), 7).count() == 7


def test_scores_ignore_held_out_labels_and_find_toxic_texts(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "x", 0.5, 3) for i, t, _ in rows] + [(None, "you idiot", "x", 0.1, 1), (1000, None, "x", 0.1, 1), (1001, "", "x", 0.1, 1), (1002, "quabre " * 9, "x", 0.1, 1), (1002, "lo re", "x", 0.1, 1)],
                                 "doc_id long, text string, lang string, score double, fold int")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = [spark.createDataFrame([(i, 1, (1 - y if flip and held(i) else y)) for i, _, y in rows], "doc_id long, quality int, toxic int") for flip in (False, True)]
    one, two = (sorted(map(tuple, toxicity(docs, x).collect()), key=str) for x in labels)
    assert one == two and len(one) == len(rows) + 5
    by_id = {r[0]: r for r in one if r[0] not in (None, 1002)}
    assert all(r[1] == (r[0] is not None and held(r[0])) and 0 <= r[2] <= 1 and r[3] == (r[2] >= 0.7) for r in one)
    truth = [(y, by_id[i][3]) for i, _, y in rows if held(i)]
    assert sum(y == p for y, p in truth) >= 0.97 * len(truth)
    assert by_id[1000][2:] == by_id[1001][2:] and by_id[1000][3] == 0
    assert sorted(r[3] for r in one if r[0] == 1002) == [0, 1]


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "idiot"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity(docs, none).collect()
    assert [r.score for r in got] == [0.5, 0.5] and [r.predicted for r in got] == [0, 0]
    assert toxicity(docs.limit(0), none).count() == 0
    toxic_only = spark.range(30).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert all(r.score > 0.9 for r in toxicity(docs, toxic_only).collect())


def test_held_out_accuracy_on_the_small_table(spark):
    from lectern.llm.op11_toxicity import op11_toxicity

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = [r for r in op11_toxicity(spark, SMALL).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = ([r.score for r in rows if labels[r.doc_id] == y] for y in (1, 0))
    area = sum((t > c) + (t == c) / 2 for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert area > 0.7
