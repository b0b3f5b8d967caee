"""Frames, cuts and outputs against plain Python, and exact round trips."""

import hashlib
import random
import re

import pytest

from lectern.llm.op12_fim import FRAME_CHARS, Frames, digests, draws, output, outputs, plan, restore, restored, store

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SCHEMA = "part int, doc_id long, text string, frames int, form string"


def plain_fim(doc_id, text):
    """(form, prefix, middle, output) as the contract words it."""
    units = UNIT.findall(text)
    h1, h2, h3, h4 = draws(doc_id)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    return ("spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", p, m, f"<P>{p}<S>{s}<M>{m}")


def corpus():
    r = random.Random(3)
    pick = ["a", "Word", " ", "\n", "é", "😀", "<", "<S", ">", "0", "ß", "[", "`", "{"]
    texts = ["".join(r.choices(pick, k=r.randint(0, 60))) for _ in range(150)]
    texts += ["", None, "x", "<P>", "a <M> b", "<", "<P", "S>", "z" * 300, "é" * 300, " " * 50]
    return [*enumerate(texts), (5, "again"), (5, "again"), (None, "no id here"), (None, None)]


def test_draws_are_the_first_groups_of_the_digest():
    h = hashlib.sha256(b"1:7").hexdigest()
    assert draws(7) == [int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)]


@pytest.mark.parametrize("size", [1, 3, 7, FRAME_CHARS])
def test_cuts_ranges_and_round_trip_at_any_frame_size(size):
    for doc_id, text in corpus():
        text = text or ""
        f = Frames.of([text], size)
        units = UNIT.findall(text)
        assert f.units[-1] == len(units) and f.chars[-1] == len(text)
        for k in range(len(units) + 1):
            assert f.cut(k) == len("".join(units[:k]))
        form, a, b = plan(doc_id, any(m in text for m in ("<P>", "<S>", "<M>")), f)
        want = plain_fim(doc_id, text)
        out = "".join(output(f, form, a, b))
        assert (form, out) == (want[0], want[3])
        assert "".join(restored(Frames.of([out], size), form)) == text


def test_only_cut_frames_are_opened_for_selection():
    text = "word and, " * 5000
    f, opened = Frames.of([text], 1000), []
    inner = f.frame
    f.frame = lambda k: opened.append(k) or inner(k)
    f.cut(7777)
    assert len(opened) <= 2


@pytest.mark.parametrize("size", [5, FRAME_CHARS])
def test_digests_outputs_and_restore_through_spark(spark, size):
    given = corpus()
    docs = spark.createDataFrame([(1, d, t, 2, "clash") for d, t in given], SCHEMA).repartition(3)
    stored = store(docs, size)
    want = []
    for d, t in given:
        form, p, m, out = plain_fim(d, t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((d, len(UNIT.findall(t or "")), form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(t or "")))
    assert sorted(map(tuple, digests(stored).collect()), key=str) == sorted(want, key=str)
    made = outputs(stored)
    assert sorted((r.doc_id, r.output) for r in made.collect() if r.doc_id is not None) == sorted((d, plain_fim(d, t or "")[3]) for d, t in given if d is not None)
    assert sorted(map(str, restore(made).collect())) == sorted(map(str, spark.createDataFrame([(d, t or "") for d, t in given], "doc_id long, text string").collect()))


def test_long_text_and_empty_table(spark):
    text = "a" * 150_000 + " b" * 100_000 + "é" * 50_000
    row = digests(store(spark.createDataFrame([(1, text)], "doc_id long, text string"))).head()
    form, p, m, out = plain_fim(1, text)
    assert (row.n, row.form, row.prefix_chars, row.middle_chars) == (250_001, form, len(p), len(m))
    assert row.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
    assert row.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert digests(store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
