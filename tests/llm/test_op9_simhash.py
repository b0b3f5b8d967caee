"""Fingerprints, followers and searches against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import op9_simhash
from lectern.llm.op9_simhash import classes, compare, fingerprints, links, parts_of, with_next, within

SCHEMA = "part int, doc_id long, text string, fingerprint long"


def corpus():
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "word ", "longer ", "é😀", "\n", "  ", "\t"]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    rows = [(9 * k % 61, t) for k, t in enumerate(texts)]
    return rows + [(5, "a tie"), (5, None), (None, "no id"), (99, "x" * 30_000 + " y")]


@pytest.mark.parametrize("rows", [7, 2000])
def test_followers_and_edits(spark, monkeypatch, rows):
    monkeypatch.setattr(op9_simhash.parts_of, "__defaults__", (rows,))
    given = corpus()
    got = compare(spark.createDataFrame([(1, d, t, 2) for d, t in given], SCHEMA)).collect()
    ordered = sorted(((d, t or "") for d, t in given), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, prints = [], {r.edited_sha256: r.edited_fingerprint for r in got}
    for i, (d, t) in enumerate(ordered):
        follower, half = ordered[(i + 1) % len(ordered)][1], len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[:len(t) - half] + follower[:half]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    same = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in given} & set(prints)
    by_text = {}
    for r in got:
        if r.edited_sha256 in same and r.near_edited == 1.0:
            by_text[r.edited_sha256] = r.fingerprint
    assert all(prints[k] == v for k, v in by_text.items())


def test_equal_texts_and_votes(spark):
    texts = [(1, "alpha beta beta"), (2, "beta  alpha\nbeta"), (3, ""), (4, "gamma")]
    got = {r.k: r.fingerprint for r in fingerprints(spark.createDataFrame(texts, "k long, text string"), ["k"]).collect()}
    assert got[1] == got[2] and got[3] == 0
    hashes = {w: h for w, h in spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "w string").select("w", F.xxhash64("w")).collect()}
    assert got[4] == hashes["gamma"]
    votes = [sum(n * (1 if hashes[w] >> b & 1 else -1) for w, n in (("alpha", 2), ("beta", 2))) for b in range(64)]
    assert got[1] % (1 << 64) == sum(1 << b for b, v in enumerate(votes) if v > 0)


def test_search_finds_all_in_the_radius(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(6)]
    values = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(30)] + base * 3
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    all_ = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    asked = spark.createDataFrame([(v,) for v in signed[:40]], "fingerprint long")
    got = {(x.query, x.fingerprint): x.n for x in within(asked, all_).collect()}
    want = {(q, v): signed.count(v) for q in set(signed[:40]) for v in set(signed) if bin((q ^ v) % (1 << 64)).count("1") <= 3}
    assert got == want


def test_empty_and_single(spark):
    assert compare(spark.createDataFrame([], SCHEMA)).collect() == []
    (one,) = compare(spark.createDataFrame([(1, 4, "ab cd", 0)], SCHEMA)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and one.near_next == 1.0


def test_links_name_classes(spark):
    rows = [(1, 0b0), (2, 0b111), (3, 0b0), (4, 0b1111), (None, 0b111), (6, -1)]
    all_ = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    got = {(r.doc_id, r.class_id): (r.n, r.distance) for r in links(all_.filter("doc_id in (3, 4)"), all_).collect()}
    assert got == {(3, 1): (2, 0), (3, 2): (2, 3), (4, 4): (1, 0), (4, 2): (2, 1)}
    assert {(r.fingerprint, r.class_id, r.n) for r in classes(all_).collect()} == {(0, 1, 2), (7, 2, 2), (15, 4, 1), (-1, 6, 1)}


@pytest.mark.parametrize("hot", [None, 7])
def test_one_id_of_most_rows_fills_several_parts(spark, hot):
    r = random.Random(9)
    rows = [(hot, "".join(r.choice("abcdefgh") for _ in range(12))) for _ in range(3000)] + [(k, f"text {k}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = docs.withColumn("part", parts_of(docs, 100))
    sizes = [x["count"] for x in dealt.groupBy("part").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 300
    got = [(x.doc_id, x.text, x.next_text) for x in with_next(dealt, ["text"], ["doc_id", "text"]).collect()]
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = [(*a, b[1]) for a, b in zip(order, order[1:] + order[:1])]
    assert sorted(got, key=str) == sorted(want, key=str)
