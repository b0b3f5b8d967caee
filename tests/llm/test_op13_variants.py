"""Words, near pairs, forms and roots against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.op13_variants import near_pairs, parts_by_weight, runs, signatures, variants

SCHEMA = "part int, doc_id long, text string, sig int, word string"


def plain_counts(rows, every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def plain_variants(rows, every):
    n = plain_counts(rows, every)
    near = defaultdict(list)
    for a in n:
        near[a] = [b for b in n if one_edit(a, b)]
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def corpus():
    r = random.Random(8)
    base = ["analysis", "Çedilla", "straßeß", "colour", "xxxxxx", "ÀÉÎÕÜÿ"]
    rows = []
    for k in range(400):
        words = []
        for _ in range(25):
            w = r.choice(base)
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                p = r.randrange(len(w))
                w = r.choice([w[:p] + w[p + 1:], w[:p] + r.choice("aeé") + w[p:], w[:p] + r.choice("aeß") + w[p + 1:]])
            words.append(r.choice([w, w.upper() if w.isascii() else w]))
        rows.append((k, r.choice([" ", ", ", "1", "\n", "—", "😀"]).join(words)))
    chain = [("chainaa", 625), ("chainab", 125), ("chainbb", 25), ("chainbc", 5)]
    rows += [(1000 + k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    return rows + [(7, "again again"), (7, "again again"), (None, "colour without id"), (8, None), (9, ""), (10, "z" * 20_000)]


@pytest.mark.parametrize("every", [3, 199, 1 << 40])
def test_variants_equal_plain_python(spark, every):
    rows = corpus()
    docs = spark.createDataFrame([(1, d, t, 2, "clash") for d, t in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, variants(docs, typo_every=every).collect()))
    assert got == plain_variants(rows, every)


def test_roots_follow_the_whole_chain(spark):
    rows = [(1, "chainaa " * 625 + "chainab " * 125 + "chainbb " * 25 + "chainbc " * 5)]
    got = {r.word: (r.form, r.root, r.form_n) for r in variants(spark.createDataFrame(rows, "doc_id long, text string"), typo_every=1 << 40).collect()}
    assert got["chainbc"] == ("chainbb", "chainaa", 25) and got["chainaa"] == (None, "chainaa", None)


def test_runs_are_those_of_the_pattern():
    text = "Aé×÷ß ÿŸĀx¿Àb-c1D_e😀ſzİİKq"
    want = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert [x.decode("latin-1") for x in runs(text)] == want


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", min_size=6, max_size=14), st.integers(0, 13), st.sampled_from("abcéz"), st.sampled_from(["delete", "insert", "replace"]))
def test_one_edit_leaves_a_common_signature(word, at, letter, kind):
    at %= len(word)
    other = {"delete": word[:at] + word[at + 1:], "insert": word[:at] + letter + word[at:], "replace": word[:at] + letter + word[at + 1:]}[kind]
    dealt = parts_by_weight({(c, k): 5 - k for c in "abcé" for k in (1, 2)})
    if len(other) >= 6:
        assert set(signatures(word, dealt)) & set(signatures(other, dealt))


def test_many_words_on_one_signature(spark):
    """Anagrams with a common start: all meet, only near ones leave."""
    r = random.Random(2)
    words = sorted({"abc" + "".join(r.sample("defgh", 5)) for _ in range(300)} | {"abcdefgg", "abcdefg"})
    got = {(x.a, x.b) for x in near_pairs(spark.createDataFrame([(w, 9) for w in words], "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_empty_tables(spark):
    assert variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants(spark.createDataFrame([(1, None), (2, "short words")], "doc_id long, text string")).count() == 0
