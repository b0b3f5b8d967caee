"""Statistics against plain loops; outliers against a direct concentration."""

import random
import re

import numpy as np
import pytest

from lectern.llm import op5_quality
from lectern.llm.common import written
from lectern.llm.op5_quality import DIMS, FLOORS, MAX_DISTANCE, PRIOR_ROWS, SCALE, STEPS, SUPPORT, _consistency, keep_clean, quality, text_statistics

SCHEMA = "p double, doc_id long, text string, lang string, source string, rows int"


def slow_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(set(words))


def test_statistics():
    r = random.Random(4)
    for _ in range(400):
        text = "".join(r.choice(["a", "b ", "c\n", " ", "\n", "é", "#x ", "a b a ", "\x0b", "\x1c", "\xa0", "|"]) for _ in range(r.randint(0, 60)))
        assert text_statistics(text) == slow_statistics(text), repr(text)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def corpus():
    r = random.Random(8)
    rows = [(f"{prose(r, r.randint(60, 300))}.", "en", r.choice(["a", "a", "a", "b", None])) for _ in range(300)]
    rows += [(" ".join(w + "#$%&" for w in prose(r, 120).split()), "en", "a") for _ in range(40)]  # junk
    rows += [(prose(r, 80) + " $$$ ### *** " * 30, "xx", "lonely")]
    rows += [(None, "en", "a"), ("", None, None), ("too short", "en", "b"), ("again and again " * 40, "en", "a")]
    return [(1.0, i, t, lang, source, 3) for i, (t, lang, source) in enumerate(rows)]


def test_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows + [rows[0]], SCHEMA)
    got = quality(docs).collect()
    assert len(got) == len(rows) + 1
    by = {r.doc_id: r for r in got}
    for _, i, text, *_ in rows:
        stats = slow_statistics(text or "") if len(text or "") < 900 else text_statistics(text)
        assert (by[i].n_words, by[i].word_chars, by[i].n_symbols, by[i].n_dup_lines, by[i].n_repeat_words) == stats[:5]
        assert by[i].base_failed == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0])
    assert all(by[i].kept for i in range(300))
    assert not any(by[i].kept for i in range(300, len(rows)))
    kept = keep_clean(docs)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == sorted([0, *range(300)])


@pytest.mark.parametrize("copies", [60, 100, 130])  # 23, 33 and 39 percent of the group
def test_junk_copies_in_a_group_are_no_part_of_its_estimate(spark, copies):
    r = random.Random(3)
    texts = [prose(r, r.randint(60, 300)) for _ in range(200)]
    texts += [" ".join(w + "#$%&" for w in texts[0].split())] * copies
    docs = spark.createDataFrame([(1.0, i, t, "en", "a", 3) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(x.doc_id for x in quality(docs).filter("kept").collect()) == list(range(200))


def test_empty_table_and_only_failing_rows(spark):
    assert quality(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(1.0, 1, "short", "en", "a", 1)], SCHEMA)
    assert [(r.base_failed, r.kept) for r in quality(only).collect()] == [(True, False)]


def direct_estimate(x):
    """Location and scatter of the rows ``x`` by concentration, all in one array."""
    median = np.percentile(x, 50, axis=0)
    mad = np.percentile(np.abs(x - median.astype(int)), 50, axis=0)
    mean, scatter = median / SCALE, np.diag(np.maximum(1.4826 * mad / SCALE, FLOORS) ** 2)
    for _ in range(STEPS):
        d = x / SCALE - mean
        step = np.floor(np.log(np.einsum("ni,ij,nj->n", d, np.linalg.inv(scatter), d) + 1e-3) * 50)
        near = x[step <= np.ceil(np.percentile(step, 100 * SUPPORT))]
        mean = near.mean(0) / SCALE
        scatter = np.cov(near.T / SCALE, bias=True) * _consistency(len(near) / len(x)) + np.diag(np.square(FLOORS))
    return mean, scatter


def test_distances_equal_a_direct_estimate(spark):
    r = random.Random(12)
    rows = [(prose(r, r.randint(60, 200)) + r.choice(["", " #", " $$ %", "\nsame line\nsame line"]), lang, source)
            for lang, source, n in (("en", "a", 150), ("en", "b", 8), ("de", "a", 40), (None, "c", 1), ("de", None, 3)) for _ in range(n)]
    got = {x.doc_id: x for x in quality(spark.createDataFrame([(1.0, i, *t, 3) for i, t in enumerate(rows)], SCHEMA)).collect()}

    def statistics(text):
        n_words, chars, symbols, dups, repeats, distinct = text_statistics(text)
        v = [np.log(chars / n_words), symbols / chars, repeats / n_words, np.log1p(dups), np.log(distinct / n_words) + 0.15 * np.log(n_words)]
        return [int(np.sign(y) * np.floor(abs(y) * SCALE + 0.5)) for y in v]

    x = np.array([statistics(t) for t, *_ in rows])
    assert x.shape[1] == DIMS

    def drawn(part, wider):
        w = len(part) / (len(part) + PRIOR_ROWS)
        return [w * a + (1 - w) * b for a, b in zip(direct_estimate(part), wider)]

    of_all = direct_estimate(x)
    for lang, source in {(la, so) for _, la, so in rows}:
        of_lang = drawn(x[[k for k, t in enumerate(rows) if t[1] == lang]], of_all)
        members = [k for k, t in enumerate(rows) if t[1:] == (lang, source)]
        mean, scatter = drawn(x[members], of_lang)
        for k in members:
            d = x[k] / SCALE - mean
            want = d @ np.linalg.inv(scatter) @ d
            assert got[k].distance == pytest.approx(want, rel=1e-6, abs=1e-9)
            assert got[k].kept == (want <= MAX_DISTANCE)


def test_a_very_long_text(spark):
    r = random.Random(2)
    texts = [prose(r, 100) for _ in range(20)] + [prose(r, 200_000)]
    got = {x.doc_id: x for x in quality(spark.createDataFrame([(1.0, i, t, "en", "a", 3) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got[20].n_words == 200_000 and got[20].distance is not None


def test_all_kinds_of_groups_share_their_jobs(spark, monkeypatch):
    """Each written stage is some jobs that the driver plans and keeps: three a step would be too many."""
    stages = []
    monkeypatch.setattr(op5_quality, "written", lambda df, name: stages.append(name) or written(df, name))
    r = random.Random(5)
    rows = [(1.0, i, prose(r, 60), r.choice(["en", "de", None]), r.choice("ab"), 3) for i in range(60)]
    assert sum(x.kept for x in quality(spark.createDataFrame(rows, SCHEMA)).collect()) == 60
    assert len(stages) <= 2 * STEPS + 6
