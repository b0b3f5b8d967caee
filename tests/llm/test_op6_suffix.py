"""Repeated passages against a direct search of every window."""

import hashlib
import random

import pytest

from lectern.llm import op6_suffix
from lectern.llm.esa import repeats
from lectern.llm.op6_suffix import digests, without_repeats

SCHEMA = "spans string, doc_id long, text string, gram long"


def brute(rows, least=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - least + 1):
            w = data[i:i + least]
            if w in seen:
                gone[i:i + least] = b"\1" * least
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(r.randint(10, 60)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [prose(r.randint(0, 30)) for _ in range(r.randint(1, 4))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 40)
            parts.insert(r.randrange(len(parts) + 1), s[a:a + r.randint(80, 400)])
        texts.append(" ".join(parts))
    texts += [None, "", "a" * 5000, "ab" * 900, "a" * 99, "a" * 100, texts[3], texts[4], texts[3][:-5] + "zz", "é" * 300, texts[5] * 3]
    r.shuffle(texts)
    return [*enumerate(texts), (None, texts[7])]


@pytest.mark.parametrize("hot", [2000, 2])
def test_same_bytes_as_direct_search(spark, monkeypatch, hot):
    rows = corpus(hot)
    monkeypatch.setattr(op6_suffix, "HOT", hot)
    docs = spark.createDataFrame([("s", d, t, 5) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digests(docs).collect()}
    assert got == brute(rows)


def test_texts_are_cut_and_columns_kept(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([("s", 1, "x " + passage, 5), ("t", 2, passage + " y", None), ("u", 3, None, 1)], SCHEMA)
    out = without_repeats(docs)
    assert out.schema == docs.schema
    assert {r.doc_id: (r.text, r.gram) for r in out.collect()} == {1: ("x " + passage, 5), 2: (" y", None), 3: (None, 1)}


def test_rows_that_share_a_doc_id_or_have_none(spark):
    passage, other = ("".join(f" {c}{i}" for i in range(60)) for c in "pq")
    rows = [(5, "x" + passage), (5, "x" + passage), (None, "n" * 30 + other + passage), (None, "".join(f"z{i * i} " for i in range(200))),
            (None, "m" + other), (7, "first" + other)]
    docs = spark.createDataFrame([(f"s{k}", d, t, k) for k, (d, t) in enumerate(rows)], SCHEMA).coalesce(1)
    got = {r.gram: r.text for r in without_repeats(docs).collect()}
    # nulls are earlier than 5 and 7, each a text of its own; the second row of 5 repeats the first
    assert got == {0: "x", 1: "", 2: rows[2][1], 3: rows[3][1], 4: "m", 5: "first"}
    equal = spark.createDataFrame([("s", 5, "x" + passage, k) for k in range(3)] + [("s", None, "y" + other, k) for k in range(3, 5)], SCHEMA).repartition(4)
    assert sorted(r.text for r in without_repeats(equal).collect()) == ["", "", "", "x" + passage, "y" + other]
    assert sorted((r.n_bytes - r.n_removed, r.kept_sha256 == hashlib.sha256(b"").hexdigest()) for r in digests(equal).collect()) == [
        (0, True)] * 3 + [(len(passage) + 1, False)] * 2


def test_empty_table(spark):
    assert digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_maximal_repeats_of_small_fragments():
    r = random.Random(3)
    for _ in range(200):
        parts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 5))]
        least = r.randint(1, 4)
        got = {parts[o[0][0]][o[0][1]:o[0][1] + n]: sorted(o) for n, o in repeats(parts, least)}
        where: dict = {}
        for f, x in enumerate(parts):
            for i in range(len(x)):
                for j in range(i + least, len(x) + 1):
                    where.setdefault(x[i:j], []).append((f, i))
        want = {}
        for s, o in where.items():
            left = {parts[f][i - 1] if i else (f, -1) for f, i in o}
            right = {parts[f][i + len(s)] if i + len(s) < len(parts[f]) else (f, -1) for f, i in o}
            if len(o) > 1 and len(left) > 1 and len(right) > 1:
                want[s] = o
        assert got == want


def test_packets_of_fragments_are_exact_and_small():
    """Two numbers of hash, 16 bytes, and little more a fragment go through the shuffle."""
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(0, 900))) for _ in range(200)] + ["", "x" * 99]
    texts += texts[3:9]  # fragments that are there twice leave as spans
    ids = [op6_suffix.NULL_KEY, *range(5, 4 + len(texts))]
    batch = op6_suffix.pa.RecordBatch.from_arrays([op6_suffix.pa.array(ids), op6_suffix.pa.array([k + (7 << 33) for k in range(len(texts))]),
                                                   op6_suffix.pa.array([t.encode() for t in texts])], names=["doc", "row", "text"])
    got, size, parts = set(), 0, {}
    for b in op6_suffix._anchors(iter([batch]), 100, 5):
        for part, packet in zip(*(c.to_pylist() for c in b.columns)):
            size += len(packet)
            for gram, content, doc, row, anchor, lo, hi in zip(*(c.tolist() for c in op6_suffix._unpacked(packet))):
                got.add((doc, row, anchor, lo, hi) if anchor >= 0 else (row, lo, hi))
                if anchor >= 0:
                    assert parts.setdefault(gram, part) == part and 0 <= part < 5
    whole, seen, want = 0, set(), set()
    for k, (doc, text) in enumerate(zip(ids, texts)):
        data = op6_suffix.np.frombuffer(text.encode(), op6_suffix.np.uint8)
        for gram, content, anchor, lo, hi in zip(*(c.tolist() for c in op6_suffix.fragments(data))):
            whole += 1
            if (gram, content) not in seen:
                want.add((doc, k + (7 << 33), anchor, lo, hi))
            seen.add((gram, content))
    assert {x for x in got if len(x) == 5} == want
    assert {x for x in got if len(x) == 3} == {(k + (7 << 33), 0, len(texts[k])) for k in range(len(texts) - 6, len(texts)) if len(texts[k]) >= 100}
    assert len(got) < whole and size < 24 * len(want)
