"""The transducer against tiktoken; round trips; streaming UTF-8."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lectern.llm.bpe import MergeTransducer, Utf8Stream
from lectern.llm.op2_byte_bpe import RANKS_FILE, codec, decode_column, digests, encode_column

PIECES = ["a", "b", "the", " ", "  ", "\n", "\n\n", "\xa0", "é", "日本", "'s", "12", "!!", "\t", "\r\n", "ing", "aaaaaaa", "😀", "\x1c", "…", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(RANKS_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(library):
    r, c = random.Random(1), codec()
    for _ in range(3000):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(0, 30)))
        assert memoryview(c.encode(text)).cast("I").tolist() == library.encode_ordinary(text), repr(text)
    for _ in range(5000):
        word = "".join(r.choice("abcdefghinorst") for _ in range(r.randint(0, 40)))
        assert c.transducer.encode(word.encode()) == library.encode_ordinary(word), word


def test_any_merge_order_and_no_room_for_states():
    r = random.Random(5)
    for _ in range(60):
        tokens = {bytes([b]) for b in b"abc"} | {bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(12)}
        singles, longer = sorted(t for t in tokens if len(t) == 1), [t for t in tokens if len(t) > 1]
        r.shuffle(longer)
        ranks = {t: i for i, t in enumerate(singles + longer)}
        for room in (0, 10_000):
            t = MergeTransducer(ranks, room)
            for _ in range(60):
                word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
                parts = [word[i:i + 1] for i in range(len(word))]
                while len(parts) > 1:
                    rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                    if rank == 1 << 60:
                        break
                    parts[at:at + 2] = [parts[at] + parts[at + 1]]
                assert t.encode(word) == ([ranks[word]] if word in ranks else [ranks[p] for p in parts])


def test_utf8_in_any_cut():
    r = random.Random(2)
    text = "aé日😀" * 50
    data = text.encode()
    for _ in range(200):
        s, out, at = Utf8Stream(), "", 0
        while at < len(data):
            n = r.randint(1, 5)
            out += s.feed(data[at:at + n])
            at += n
        assert out + s.feed(b"", last=True) == text
    s = Utf8Stream()
    assert s.feed(b"a\xe6\x97") + s.feed(b"", last=True) == "a�"


def test_digests_and_round_trip(spark, library):
    texts = [None, "", "one two", "one two", " \n x\n", "é" * 40_000, "日本 " * 9]
    docs = spark.createDataFrame([(b"i", i, t) for i, t in enumerate(texts)], "ids binary, doc_id long, text string")
    got = {r.doc_id: r for r in digests(docs).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert {r.doc_id: r.text for r in decode_column(encode_column(docs)).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert digests(docs.limit(0)).collect() == []
