"""Operator 3: token ids as Huffman-coded blocks in ascending doc_id order.

``write_ids`` writes a folder: ``code`` (one row: code-word lengths by id,
from the counts of all ids) and ``blocks`` (shard, block, first, n_tokens,
payload), see ``huffman``. Shards are ranges of doc_id; ``first`` counts the
ids of the shard before the block. ``read_ids`` decodes the blocks, each for
itself. Texts are moved and tokenised once: the raw ids wait as a written
stage while their counts, at most one number per vocabulary entry, are summed.

Null or empty texts are the end id alone; rows with equal doc_id stay in one
shard, in any order among themselves; a null doc_id sorts first and reads back
as null; an empty table writes no block; other columns are not read. Blocks
hold whole documents, so a very long text makes one long block.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import per_row, table, written
from .huffman import Code, code_lengths
from .tokens import library_encoder

TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 2
#: A block is closed at this many ids.
BLOCK_IDS = 1 << 18
#: Stands for a null doc_id inside a block.
NULL_KEY = -(1 << 63)


def raw_blocks(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Rows (shard, block, first, n_tokens, keys, sizes, ids, counts): tokenised documents
    in doc_id order; a shard's last block has the counts of all its ids."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def make():
        encode = library_encoder(tokenizer, dtype="<u2")  # 49,408 entries fit
        end = np.array([end_id], "<u2").tobytes()
        shard, keys, sizes, parts = TaskContext.get().partitionId(), [], [], []
        at, ready, counts = {"block": 0, "first": 0, "n": 0}, [], np.zeros(1 << 16, np.int64)

        def close():
            """The block before this one, which may be the last."""
            if keys:
                ids = b"".join(parts)
                counts[:] += np.bincount(np.frombuffer(ids, "<u2"), minlength=1 << 16)
                ready.append((shard, at["block"], at["first"], at["n"], np.array(keys, "<i8").tobytes(), np.array(sizes, "<u8").tobytes(), ids))
                at.update(block=at["block"] + 1, first=at["first"] + at["n"], n=0)
                for x in (keys, sizes, parts):
                    x.clear()
                if len(ready) > 1:
                    yield (*ready.pop(0), None)

        def end_of_shard():
            yield from close()
            if ready:
                yield (*ready.pop(), counts.tobytes())

        def row(doc_id, text):
            ids = encode(text or "") + end
            keys.append(NULL_KEY if doc_id is None else doc_id)
            sizes.append(len(ids) // 2)
            parts.append(ids)
            at["n"] += len(ids) // 2
            if at["n"] >= block_ids:
                yield from close()

        row.end = end_of_shard
        return row

    return per_row(ordered, "shard int, block int, first long, n_tokens long, keys binary, sizes binary, ids binary, counts binary", make, 8)


def id_counts(raw: DataFrame) -> DataFrame:
    """(id, n) over all blocks, from the shards' counts."""

    def make():
        def row(counts):
            n = np.frombuffer(counts, np.int64)
            return ((int(i), int(n[i])) for i in np.flatnonzero(n))

        return row

    return per_row(raw.filter("counts is not null").select("counts"), "id int, n long", make, 1 << 16).groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER_FILE, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents to the folder ``path``."""
    spark = docs.sparkSession
    raw = written(raw_blocks(docs, tokenizer, end_id, block_ids), "op3-ids")
    counts = np.zeros(1 << 16, np.int64)
    for r in id_counts(raw).collect():  # one row per vocabulary entry at most
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")

    def make():
        code = Code(lengths)

        def row(shard, block, first, n_tokens, keys, sizes, ids):
            yield shard, block, first, n_tokens, code.write(np.frombuffer(keys, "<i8"), np.frombuffer(sizes, "<u8"), np.frombuffer(ids, "<u2"))

        return row

    coded = per_row(raw.drop("counts"), "shard int, block int, first long, n_tokens long, payload binary", make, 8)
    coded.write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, in_shard, n_tokens, ids binary) of every document in the folder."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").head()["lengths"]), np.uint8)
    return _documents(spark.read.parquet(f"{path}/blocks"), lengths, "ids binary", lambda ids: ids.astype("<u4").tobytes())


def _documents(blocks: DataFrame, lengths: np.ndarray, column: str, of) -> DataFrame:
    def make():
        code = Code(lengths)

        def row(shard, first, payload):
            keys, sizes, ids = code.read(payload)
            at = 0
            for key, size in zip(keys.tolist(), sizes.tolist()):
                yield (None if key == NULL_KEY else key), shard, first + at, size, of(ids[at:at + size])
                at += size

        return row

    return per_row(blocks.select("shard", "first", "payload"), f"doc_id long, shard int, in_shard long, n_tokens long, {column}", make, 1024)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """What a folder of blocks holds, per document."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").head()["lengths"]), np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    docs = _documents(blocks, lengths, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per range of doc_id
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def op3_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "op3-coded")
    write_ids(table(spark, sf_dir, "documents"), path)
    return digests(spark, path)
