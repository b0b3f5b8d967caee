"""Encoders against the tokenizers library itself."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm.tokens import LONG_RUN, library_encoder

CASES = [("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<u4"), ("word_bpe_49k.json", None, "<u2")]


def texts():
    r = random.Random(12)
    pieces = ["the", "Idiot", " ", "  ", "\n", "\t", "\u00a0", "'s", "'S", "don't", "é", "É", "ß", "e\u0301", "ﬁ", "😀", "👩‍👩‍👧", "123", "½", "x1", "_", "$$", "...", ")", "中文字", "\r\n", "\x01", "\x00",
              "<|endoftext|>", "<|startoftext|>", "\u2003", "İ", "lowei", "ſ", "K", "\u200b"]
    out = ["".join(r.choices(pieces, k=r.randint(0, 40))) for _ in range(600)]
    latin = "abcz" + "".join(chr(c) for c in range(0xAA, 0x180))
    out += [" ".join("".join(r.choices(latin, k=r.randint(1, 9))) for _ in range(30)) for _ in range(300)]
    out += ["", " ", "\n", "a" * 5000, " " * 3000, "\n" * 2500, "x y " * 2000, "ab" * 600 + " end", "\u2003" * 1200 + "z", "!" * 1500, "word " + "é" * 1100]
    return out


@pytest.mark.parametrize("file, ranks, dtype", CASES)
def test_ids_are_those_of_the_library(file, ranks, dtype):
    tok = Tokenizer.from_file(public_tokenizers.path(file))
    tok.encode_special_tokens = True
    encode = library_encoder(file, ranks, dtype)
    for _ in range(2):  # the second time from memory
        for text in texts():
            assert np.frombuffer(encode(text), dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, text[:80]


def test_ranks_are_the_vocabulary():
    """Every token of the vocabulary has its id as its rank."""
    from lectern.llm.tokens import RankEncoder
    vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).get_vocab(with_added_tokens=False)
    ranks = RankEncoder("byte_bpe_50k.tiktoken", None).ranks
    shown = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    shown |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
    assert {"".join(shown[b] for b in token): rank for token, rank in ranks._mergeable_ranks.items()} == {t: i for t, i in vocabulary.items() if t != "<|endoftext|>"}


def test_long_runs_take_no_quadratic_time():
    import time
    encode, start = library_encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), time.time()
    assert len(encode("ab" * 300_000)) and time.time() - start < 20 and LONG_RUN <= 2000
