"""Code lengths against Huffman's algorithm; files read back against the library."""

import heapq
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lectern.llm.huffman import Code, code_lengths
from lectern.llm.op3_binary import TOKENIZER_FILE, digests, read_ids, write_ids


def optimal(counts):
    heap = [c for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def test_lengths_are_optimal_limited_and_decode():
    r = np.random.default_rng(0)
    for _ in range(80):
        counts = r.integers(0, 10 ** r.integers(1, 6), r.integers(1, 60))
        if not counts.any():
            continue
        free, tight = code_lengths(counts, 20), code_lengths(counts, 6)
        assert (free * counts).sum() == optimal(counts.tolist()) and tight.max() <= 6
        for lengths in (free, tight):
            code = Code(lengths)
            ids = r.choice(np.flatnonzero(counts), r.integers(0, 1500))
            keys, sizes, back = code.read(code.write([5, -7], [len(ids), 0], ids))
            assert (back == ids).all() and keys.tolist() == [5, -7] and sizes.tolist() == [len(ids), 0]


def test_files_hold_what_the_library_gives(spark, tmp_path):
    texts = {9: "Hello  World", 2: None, 5: "", 7: "Hello  World", 1: "é日本 " * 4000, -3: "a\tB\n"}
    docs = spark.createDataFrame([(b"x", k, t, 1) for k, t in texts.items()] + [(b"x", None, "null id", 1)], "ids binary, doc_id long, text string, shard int")
    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER_FILE))
    path = str(tmp_path / "coded")
    write_ids(docs, path, block_ids=50)
    ordered = [(None, "null id"), *sorted(texts.items())]
    want, start = {}, 0
    for k, t in ordered:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in digests(spark, path).collect()} == want
    assert all(zlib.crc32(bytes(r.ids)) == want[r.doc_id][2] for r in read_ids(spark, path).collect())


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    write_ids(spark.createDataFrame([], "doc_id long, text string"), path)
    assert digests(spark, path).collect() == []
