"""Plans and packed pieces against the library's ids and the least possible number of sequences."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lectern.llm.op8_packing import TOKENIZER_FILE, Packing, cut, pack


def check(pieces, cap):
    """pieces: (length, sequence, offset); gapless and within ``cap``."""
    by = {}
    for length, s, o in pieces:
        by.setdefault(s, []).append((o, length))
    for v in by.values():
        at = 0
        for o, length in sorted(v):
            assert o == at
            at += length
        assert at <= cap
    return len(by)


def test_plans_are_gapless_and_close_to_the_least():
    r = np.random.default_rng(1)
    for t in range(40):
        cap = int(r.integers(5, 300))
        lengths = r.integers(1, cap + 1, r.integers(0, 3000))
        counts = Counter(lengths.tolist())
        p = Packing(counts, cap)
        place = p.places()
        assert check([(x, *place(x, k)) for x, n in counts.items() for k in range(n)], cap) == p.sequences
        large = sum(n for x, n in counts.items() if 2 * x > cap)
        assert p.sequences <= max(large, 1.03 * lengths.sum() / cap + 2) * 1.12


def test_exact_fills_leave_no_gap():
    assert Packing({5: 7, 3: 7, 2: 7}, 10).sequences == 7
    assert Packing({10: 3, 4: 2, 6: 2, 1: 10}, 10).sequences == 6
    assert Packing({}, 10).sequences == 0
    assert cut(5, 5) == [(0, 5)] and cut(12, 5) == [(0, 2), (2, 5), (7, 5)] and cut(1, 5) == [(0, 1)]


def test_pieces_equal_the_library(spark):
    texts = [None, "", "one two", "one two", "x " * 7000, "Some  words\n here" * 60] + [f"text {k} " * (k * 9) for k in range(60)]
    rows = [("r", k if k != 3 else None, t, 4) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "rank string, doc_id long, text string, piece int").repartition(3)
    got = pack(docs).collect()
    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER_FILE))
    want, tokens = [], 0
    for _, k, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        tokens += len(ids)
        want += [(k, i, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for i, (s, n) in enumerate(cut(len(ids), 2048))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert check([(r.length, r.sequence_id, r.offset) for r in got], 2048) <= -(-tokens // 2048) + 1
    assert pack(docs.limit(0)).collect() == []
