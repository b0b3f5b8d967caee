"""Operator 2: byte-level BPE encoding and decoding of whole texts.

``encode_column`` gives the ids of every text, ``decode_column`` the text of
every id list; both are Arrow-batched maps without a shuffle. Null and empty
texts have no ids and decode to the empty text; rows with equal ids or texts
are encoded alike and all kept; an empty table gives an empty table; other
columns of the input, whatever their names, are not touched or read.
"""

from __future__ import annotations

import gc
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .bpe import MergeTransducer, Utf8Stream, read_ranks
from .common import per_row, table, tokenizer_path
from .tokens import SpacedMemo

RANKS_FILE = "byte_bpe_multi_50k.tiktoken"
#: Ids decoded at a time by the streaming decoder.
DECODE_IDS = 16_384
#: Pre-tokens whose ids a worker keeps besides the chunk memo.
MEMO_PIECES = 300_000

_WORKER: dict = {}


class ByteBpe:
    """Encoder and decoder of one rank file; one per worker process."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        self.transducer = MergeTransducer(ranks)
        self.pieces = regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.known: dict[str, list[int]] = {}
        self.encode = SpacedMemo(self._many)

    def _many(self, texts) -> list[bytes]:
        find, encode, known, out = self.pieces.findall, self.transducer.encode, self.known, []
        for text in texts:
            ids: list[int] = []
            for p in find(text):
                got = known.get(p)
                if got is None:
                    got = encode(p.encode())
                    if len(known) < MEMO_PIECES:
                        known[p] = got
                ids += got
            out.append(array("I", ids).tobytes())
        return out

    def decode(self, packed: bytes) -> Iterator[str]:
        """Text of packed ids, a part at a time."""
        ids, stream, of = np.frombuffer(packed, "<u4"), Utf8Stream(), self.bytes_of.__getitem__
        for at in range(0, len(ids), DECODE_IDS):
            yield stream.feed(b"".join(map(of, ids[at:at + DECODE_IDS].tolist())))
        yield stream.feed(b"", last=True)


def codec(file: str = RANKS_FILE) -> ByteBpe:
    if file not in _WORKER:
        import public_tokenizers

        gc.set_threshold(200_000, 100, 1000)  # the caches are long-lived; scanning them often costs more than the work
        _WORKER[file] = ByteBpe(tokenizer_path(file), public_tokenizers.PATTERN)
    return _WORKER[file]


def encode_column(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str = RANKS_FILE) -> DataFrame:
    """(key, ids binary: little-endian unsigned 32-bit) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        c = codec(file)
        return lambda k, t: [(k, c.encode(t or ""))]

    return per_row(docs.select(key, text), f"`{key}` {kind}, ids binary", make, 256)


def decode_column(encoded: DataFrame, key: str = "doc_id", file: str = RANKS_FILE) -> DataFrame:
    """(key, text) of every (key, ids binary) row."""
    kind = encoded.schema[key].dataType.simpleString()

    def make():
        c = codec(file)
        return lambda k, ids: [(k, "".join(c.decode(bytes(ids or b""))))]

    return per_row(encoded.select(key, "ids"), f"`{key}` {kind}, text string", make, 256)


def digests(docs: DataFrame, file: str = RANKS_FILE) -> DataFrame:
    """Ids and decoded text of every document as digests, in one pass."""

    def make():
        c = codec(file)
        decimal = {i: str(i) for i in c.bytes_of}.__getitem__

        def row(doc_id, text):
            packed = c.encode(text or "")
            ids = np.frombuffer(packed, "<u4").tolist()
            back = hashlib.sha256()
            for part in c.decode(packed):
                back.update(part.encode())
            yield doc_id, len(ids), hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest(), back.hexdigest()

        return row

    return per_row(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
