"""Stages that number rows take input columns with their helper columns' names."""

from lectern.llm.op6_suffix import without_repeats
from lectern.llm.op7_minhash import keep_one

SCHEMA = "_row string, doc_id long, text string, _spans int, row long, node int"


def test_helper_names_in_the_input(spark):
    text = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([("a", 1, text, 5, 6, 7), ("b", 2, text, 8, 9, 10), ("c", None, None, 1, 2, 3)], SCHEMA)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == ["a", "c"]
    cut = without_repeats(docs)
    assert cut.columns == docs.columns
    assert {tuple(r) for r in cut.collect()} == {("a", 1, text, 5, 6, 7), ("b", 2, "", 8, 9, 10), ("c", None, None, 1, 2, 3)}
