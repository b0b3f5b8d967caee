"""Near-duplicates against all pairs compared by brute force."""

import math
import random

import pytest

from lectern.llm import op7_minhash as op7
from lectern.llm.components import components
from lectern.llm.op7_minhash import keep_one, near_duplicates

SCHEMA = "lang string, doc_id long, text string, node string"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    sets = {d: shingles(t, width) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {d: (len(sets[d]), top(d)) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(3, 120))] for _ in range(12)]
    texts = []
    for words in base:
        at = list(words)
        for _ in range(r.randint(1, 14)):  # a chain: neighbours are alike, far ones not
            texts.append(" ".join(at))
            for _ in range(r.randint(0, 2)):
                at[r.randrange(len(at))] = r.choice(vocabulary)
    texts += ["", None, " \n\t", "one", "ONE", "one two", "one  two", "x" * 50_000 + " y z", texts[0], texts[0].upper()]
    r.shuffle(texts)
    return list(enumerate(texts)) + [(None, "one two three")]


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_same_components_as_all_pairs(spark, width, percent):
    rows = corpus(width)
    docs = spark.createDataFrame([("x", d, t, "n") for d, t in rows], SCHEMA)
    got = near_duplicates(docs, width, percent).collect()
    assert len(got) == len(rows)
    want = brute(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [r.kept for r in got if r.doc_id is None] == [True]


@pytest.mark.parametrize("percent, most", [(85, 2.2e-7), (80, 5e-8)])
def test_chance_to_miss_a_pair_at_the_limit(percent, most):
    bands, p = op7.BANDS[percent], percent / 100
    n, same = bands * op7.ROWS, p + (1 - p) / 256  # a byte may agree by chance
    least = op7._least_alike(percent, bands)
    short = sum(math.comb(n, k) * same**k * (1 - same)**(n - k) for k in range(n + 1) if (k / n - 1 / 256) / (1 - 1 / 256) < least)
    assert (1 - p**op7.ROWS)**bands + short < most


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    r = random.Random(6)
    a, b, c, d = ([f"w{r.randrange(400)}" for _ in range(100)] for _ in range(4))
    near = lambda words: " ".join(words[:-1] + ["end"])
    rows = [(5, " ".join(a)), (5, " ".join(a)), (9, near(a)), (None, " ".join(a)),  # a row repeated, a copy without id
            (None, " ".join(b)), (None, " ".join(b)), (None, near(b)),  # no row with an id
            (7, " ".join(c)), (7, " ".join(d)),  # an id of two texts
            (None, None), (None, ""), (3, ""), (3, "")]  # nothing to compare
    docs = spark.createDataFrame([(str(k), i, t, "n") for k, (i, t) in enumerate(rows)], SCHEMA).coalesce(1)
    out = keep_one(docs)
    assert out.schema == docs.schema
    assert sorted(int(x.lang) for x in out.collect()) == [0, 4, 7, 8, 9, 10, 11, 12]


def test_empty_table(spark):
    assert keep_one(spark.createDataFrame([], SCHEMA)).collect() == []
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (160, 159), (160, 159)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 161)}}


@pytest.mark.parametrize("block", [3, 2048])
def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch, block):
    """Nothing is compared with the smallest first; the families make more pairs than rows."""
    monkeypatch.setattr(op7, "FIRST_BANDS", 0)
    r = random.Random(4)
    texts = []
    for _ in range(2):  # families: some alike enough, others not, all in the same buckets
        words = [f"w{r.randrange(60)}" for _ in range(80)]
        for _ in range(30):
            at = list(words)
            for _ in range(r.randint(0, 6)):
                at[r.randrange(len(at))] = f"x{r.randrange(99)}"
            texts.append(" ".join(at))
    rows = list(enumerate(texts))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85, block).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows, 3, 85)
