"""From documents to packed training sequences, in five stages.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents; texts that a stage changes get their length
in ``n_chars``. A stage begins by letting go of the shuffles of those before.
Nulls, empty texts, repeated rows and empty tables are handled
as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import free_shuffles, table, written
from lectern.llm.op1_secrets import redact
from lectern.llm.op5_quality import keep_clean
from lectern.llm.op6_suffix import without_repeats
from lectern.llm.op7_minhash import keep_one
from lectern.llm.op8_packing import pack


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that it rejects go."""
    return keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near copies stays."""
    free_shuffles(spark)
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: passages that start earlier elsewhere are cut from texts."""
    free_shuffles(spark)
    return _counted(without_repeats(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets in texts are replaced by a mark."""
    free_shuffles(spark)
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: tokenised documents packed into sequences."""
    free_shuffles(spark)
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
          ("secret_scan", secret_scan), ("best_fit_packing", packing)]

#: Tokenisers and robust estimates are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
