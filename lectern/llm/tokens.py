"""Whole-text tokenisation through public tokenizers.

A vocabulary that is also given as ranks is applied to whole texts by the rank
encoder, which finds the same ids many times faster; texts with very long runs,
on which it takes quadratic time, go to the tokenizers library. Elsewhere chunks
of text that white space always separates are encoded once a worker and
remembered; a text whose white space is not of the plain kind is encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Sequence

import numpy as np

from .common import tokenizer_path

#: Chunks kept per worker. Common ones come early, so a full memo is kept as it
#: is; only after ``STALE`` times as many chunks not found it starts anew.
MEMO_CHUNKS = 600_000
STALE = 20

_WORKER: dict = {}


def _split_tail(chunk: str) -> tuple[str, str]:
    """A word and the closing punctuation after it, which both patterns cut off."""
    core = chunk.rstrip(".,;:!?)")
    return (core, chunk[len(core):]) if core and core != chunk and core[-1].lower().isalpha() else (chunk, "")  # a lower case may end in a mark, which goes with what follows


class _Learner:
    """Ids of new chunks that the tokenizer ``takes`` alone (False for others);
    ``kept`` has them while there is room."""

    def __init__(self, encode_many: Callable[[Sequence[str]], list[bytes]], limit: int, takes: Callable[[str], bool]):
        self.encode_many, self.limit, self.takes, self.missed = encode_many, limit, takes, 0
        self.endings: dict[str, bytes] = {"": b""}

    def learn(self, kept: dict, chunks: list[bytes], prefix: str) -> dict:
        """``kept`` with the new chunks, or both side by side if it is full."""
        parts = [_split_tail(c.decode()) for c in chunks]
        new: dict[bytes, bytes | bool] = {}
        cores = [c for c in dict.fromkeys(c for c, _ in parts) if c.encode() not in kept]
        good = [c for c in cores if self.takes(c)]
        new.update((c.encode(), False) for c in cores)
        new.update(zip((c.encode() for c in good), self.encode_many([prefix + c for c in good])))
        ends = [e for e in {e for _, e in parts} if e not in self.endings]
        self.endings.update(zip(ends, self.encode_many(ends)))
        for chunk, (core, end) in zip(chunks, parts):
            if end:
                key = core.encode()
                ids = new[key] if key in new else kept[key]
                new[chunk] = ids is not False and ids + self.endings[end]
        if len(self.endings) > 10_000:
            self.endings = {"": b""}
        if len(kept) < self.limit:
            kept.update(new)
            return kept
        self.missed += len(new)
        return _Both(kept, new)

    def stale(self) -> bool:
        if self.missed > STALE * self.limit:
            self.missed = 0
            return True
        return False


def _plain(chunk: str) -> bool:
    """Non-empty and without any white space."""
    return chunk.split() == [chunk]


class SpacedMemo:
    """For patterns of the kind `` ?\\p{L}+|...|\\s+(?!\\S)|\\s+``.

    A space followed by a non-space always opens a pre-token, and a single
    newline between non-spaces is one of its own.
    """

    def __init__(self, encode_many: Callable[[Sequence[str]], list[bytes]], limit: int = MEMO_CHUNKS):
        self.encode_many, self.learner = encode_many, _Learner(encode_many, limit, _plain)
        self.heads: dict[bytes, bytes | bool] = {}
        self.tails: dict[bytes, bytes | bool] = {}
        self.newline = encode_many(["\n"])[0]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        lines, out = text.encode().split(b"\n"), []
        head, tail = self.heads.get, self.tails.get
        for k, line in enumerate(lines):
            words = line.split(b" ")
            if k:
                out.append(self.newline)
            out.append(head(words[0]))
            out.extend(map(tail, words[1:]))
        if None in out:
            self._fill(out, lines)
        try:
            return b"".join(out)
        except TypeError:  # a chunk that is empty or holds other white space
            return self.encode_many([text])[0]

    def _fill(self, out: list, lines: list[bytes]) -> None:
        """Learns the chunks that ``out`` has no ids for."""
        if self.learner.stale():
            self.heads, self.tails = {}, {}
        at, first, rest = 0, [], []
        for line in lines:
            words = line.split(b" ")
            new = [i for i, x in enumerate(out[at:at + len(words)]) if x is None]
            if new:
                if new[0] == 0:
                    first.append((at, words[0]))
                rest += [(at + i, words[i]) for i in new if i]
            at += len(words) + 1
        for memo, found, prefix in ((self.heads, first, ""), (self.tails, rest, " ")):
            if found:
                ids = self.learner.learn(memo, list({w for _, w in found}), prefix)
                for i, w in found:
                    out[i] = ids[w]


class WordMemo:
    """For tokenizers that drop white space and case: words are independent."""

    def __init__(self, encode_many: Callable[[Sequence[str]], list[bytes]], limit: int = MEMO_CHUNKS):
        self.learner, self.memo = _Learner(encode_many, limit, bool), {}

    def __call__(self, text: str) -> bytes:
        data = text.encode()
        if b"\xcc" not in data and b"\xcd" not in data:  # no combining marks: the tokenizer's lower case of A-Z may come first
            data = data.lower()
        words = data.split()
        out = list(map(self.memo.get, words))
        if None in out:
            if self.learner.stale():
                self.memo = {}
            at = [i for i, x in enumerate(out) if x is None]
            ids = self.learner.learn(self.memo, list({words[i] for i in at}), "")
            for i in at:
                out[i] = ids[words[i]]
        return b"".join(out)


class _Both(dict):
    """A dict that looks further in a full memo."""

    def __init__(self, kept: dict, new: dict):
        super().__init__(new)
        self.kept = kept

    def __missing__(self, key):
        return self.kept[key]


#: Characters of a run, of white space or of other characters, that only the library takes.
LONG_RUN = 1000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_RUN)


class RankEncoder:
    """For byte-level vocabularies whose ranks are their ids; ``whole``: the library's encoder of texts."""

    def __init__(self, file: str, whole: Callable[[Sequence[str]], list[list[int]]]):
        import tiktoken

        with open(tokenizer_path(file), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        import public_tokenizers

        self.ranks = tiktoken.Encoding(file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = whole

    def __call__(self, text: str) -> bytes:
        if len(text) >= LONG_RUN and (max(map(len, text.split()), default=0) >= LONG_RUN or _LONG_SPACE.search(text)):
            return np.array(self.whole([text])[0], "<u4").tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def library_encoder(file: str, ranks: str | None = None, dtype: str = "<u4") -> Callable[[str], bytes]:
    """Text -> packed ids as by the tokenizers library, without special tokens
    (their strings in a text are ordinary text); one per worker process.
    ``ranks``: the same vocabulary's rank file; ids are then of four bytes.

    Without it, words are learned many at a time, joined by a separator that is
    a pre-token of its own and whose ids no word can produce; lower-case words
    of Latin letters (below U+0180, where every letter is its own normal form)
    are one pre-token that the normalizer leaves as it is, so the model takes
    them directly, as characters that stand for their bytes.
    """
    key = (file, ranks, dtype)
    if key not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path(file))
        tok.encode_special_tokens = True

        def whole(texts: Sequence[str]) -> list[list[int]]:
            return [e.ids for e in tok.encode_batch_fast(list(texts), add_special_tokens=False)]

        _WORKER[key] = RankEncoder(ranks, whole) if ranks else WordMemo(_word_encoder(tok.model.tokenize, whole, tok.get_vocab_size(), dtype))
    return _WORKER[key]


#: The characters above U+00FF that stand for bytes that are no printable Latin-1 characters, in order.
_BYTE_CHARS = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}


def _word_encoder(tokenize: Callable, whole: Callable[[Sequence[str]], list[list[int]]], size: int, dtype: str) -> Callable[[Sequence[str]], list[bytes]]:
    mark, between = "\x01", " \x01 "
    mark_ids = whole([mark])[0]
    assert len(mark_ids) == 1
    packed = [np.array(i, dtype).tobytes() for i in range(size)]

    def many(texts: Sequence[str]) -> list[bytes]:
        out: list = [b""] * len(texts)
        at_once, alone = [], []
        for i, t in enumerate(texts):
            if t.isalpha() and t == t.lower() and (t.isascii() or max(t) < "\u0180"):
                out[i] = b"".join([packed[x.id] for x in tokenize(t if t.isascii() else t.encode().decode("latin-1").translate(_BYTE_CHARS))])
            elif t:
                (alone if mark in t else at_once).append(i)
        joined = whole(between.join(texts[i] for i in part) for part in (at_once[k:k + 1000] for k in range(0, len(at_once), 1000)))
        n = 0
        for ids in joined:
            ids = np.array(ids, dtype)
            cuts = np.flatnonzero(ids == mark_ids[0]).tolist()
            raw, width, start = ids.tobytes(), ids.itemsize, 0
            for cut in [*cuts, len(ids)]:
                out[at_once[n]] = raw[start * width:cut * width]
                n, start = n + 1, cut + 1
        assert n == len(at_once)
        for i in alone:
            out[i] = np.array(whole([texts[i]])[0], dtype).tobytes()
        return out

    return many
