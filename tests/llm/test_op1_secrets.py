"""Base spans against Python's regular expressions; what the models add."""

import hashlib
import re

from pyspark.sql import functions as F

from lectern.llm.op1_secrets import KINDS, _listed, redact, scan, train

SCHEMA = "match string, doc_id long, text string, hex int, clean string"
ASSIGN = re.compile(r"""(?i:(?a:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


WORDS = "the quick brown fox getElementById jumps over user_account_name lazy dogs while parseInputStream sleeps " * 3
TEXTS = [
    None, "", "no secret here", "password=abc token: 'abcdefgh' x", "secret=token:abcdefgh", "PassWD = \"a.b-c=d/e+f_g\"\nAPIkey:12345",
    "apikey=apikey=apikey=", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7 + "B", "xAKIAAKIA" + "Z9" * 8, "deadbeef" * 3, "g" + "0" * 24 + "g" + "0" * 23,
    "é𝒳 token='" + "f" * 40 + "' é AKIA" + "Q" * 20, "a token=abcdef b", "ſecret=abcdefg api_key  :  zzzzzzzz",
    "key x7Kd9Qz2LmP0vB3nR8tY5w end", "user_account_name_2_of_the_input_stream", WORDS, WORDS.upper(), "password=" + "a" * 100_000, "token=abcdef " * 300,
]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([("m", i if i % 7 else None, t, 1, "c") for i, t in enumerate(texts)], SCHEMA)


def test_base_spans_equal_regular_expressions(spark):
    held = docs(spark).withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "text")
    rows = scan(held).select("text", _listed(*KINDS[:3]).alias("base"), F.sha2(_listed(*KINDS[:3]).cast("binary"), 256).alias("digest")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.base == brute(r.text), r.text
        assert r.digest == hashlib.sha256(r.base.encode()).hexdigest()


def test_models_add_random_runs_and_leave_identifiers(spark):
    model = train(docs(spark, [*TEXTS, *(f"{WORDS} {k}" for k in range(200))]))
    found = {r.text: [m.match for m in r.markov] for r in scan(docs(spark).select("doc_id", "text"), model).collect() if r.text}
    assert found["key x7Kd9Qz2LmP0vB3nR8tY5w end"] == ["x7Kd9Qz2LmP0vB3nR8tY5w"]
    assert found["user_account_name_2_of_the_input_stream"] == [] and found[WORDS] == []
    assert sum(map(len, found.values())) == 1


def test_redact_replaces_spans_and_keeps_columns(spark):
    given = docs(spark)
    out = redact(given)
    assert out.schema == given.schema and out.count() == len(TEXTS)
    texts = [r.text for r in out.collect()]
    assert "a [SECRET] b" in texts and "no secret here" in texts and None in texts
    assert "[SECRET] " * 300 in texts


def test_empty_table_trains_and_scans(spark):
    none = docs(spark).limit(0)
    assert len(train(none)) == 65 * 65
    assert scan(none.select("doc_id", "text")).collect() == [] and redact(none).collect() == []
