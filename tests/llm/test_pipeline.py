"""The pipeline's stages on planted cases, and as a whole on the small tables."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as p
from lectern.llm.common import table

SMALL = "/root/testdata/sf0.001"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_stages_act_on_planted_cases(spark):
    r = random.Random(3)
    clean = [prose(r, 120) for _ in range(80)]
    passage = prose(r, 60)
    texts = [*clean, clean[0], clean[1] + " more", clean[2] + "\n" + passage, clean[3] + "\n" + passage, "password=abcdef123456 " + prose(r, 90), " ".join(w + "###" for w in clean[5].split()), "short", None]
    texts[82] = prose(r, 100) + "\n" + passage
    texts[83] = prose(r, 100) + "\n" + passage
    docs = spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    at = docs
    seen = {}
    for name, stage in p.STAGES[:-1]:
        at = stage(spark, at, "")
        assert at.columns == docs.columns
        at = p.written(at, "test")
        seen[name] = {x.doc_id: x for x in at.collect()}
    assert set(range(85)) == set(seen["quality_rules"])
    assert set(range(85)) - {80, 81} == set(seen["near_dedup"])
    cut = seen["suffix_dedup"]
    assert passage in cut[82].text and passage not in cut[83].text and cut[83].n_chars == len(cut[83].text)
    assert all(cut[k].text == clean[k] for k in range(80))
    assert seen["secret_scan"][84].text.startswith("[SECRET] ")
    packed = p.STAGES[-1][1](spark, at, "").collect()
    assert {x.doc_id for x in packed} == set(cut)


def test_whole_run(spark):
    out = p.run(spark, SMALL)
    rows = out.select("doc_id", "piece", "sequence_id", "offset", "length").collect()
    assert rows and len(p.STAGES) == 5
    ids = {x.doc_id for x in table(spark, SMALL, "documents").select("doc_id").collect()}
    assert {x.doc_id for x in rows} <= ids
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_near_dedup_leaves_no_sketches_and_shuffles_are_freed(spark):
    import glob
    import time

    from lectern.llm.common import free_shuffles
    from lectern.session import ensure_checkpoint_dir

    at = ensure_checkpoint_dir(spark).removeprefix("file:").rstrip("/") + "/tables/op7-sketches-*"
    before = set(glob.glob(at))
    r = random.Random(4)
    texts = [prose(r, 40) for _ in range(6)]
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate([*texts, texts[0]])], "doc_id long, text string, n_chars long")
    assert {x.doc_id for x in p.near_dedup(spark, docs, "").collect()} == set(range(6))
    assert set(glob.glob(at)) == before
    stored = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    spark.range(1000).repartition(5).write.format("noop").mode("overwrite").save()
    held, end = stored(), time.time() + 20
    free_shuffles(spark)
    while stored() >= held and time.time() < end:
        time.sleep(0.2)
    assert stored() < held
