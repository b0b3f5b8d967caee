"""Operator 12: fill-in-the-middle transformation over seekable compressed frames.

``store`` keeps every text as independent zstandard frames of ``FRAME_CHARS``
code points with cumulative counts: for each frame the units that begin before
it and the code points before it. A cut after k units is where unit k begins,
so it is found in the one frame whose counts enclose k: only that frame is
decompressed. Prefix, middle and suffix are then ranges of code points, read
by decompressing the frames they touch, in order, one at a time: outputs and
their digests are streamed, and what is held is the compressed text and one
frame.

A unit is a run of A-Z and a-z or any other single code point; a run that goes
over a frame's end counts where it begins. Null texts are empty; empty texts
and those that hold a mark stay plain. A null doc_id draws as empty text.
Repeated rows are transformed each for itself; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import per_row, table, written

FRAME_CHARS = 1 << 16
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts, so many are transformed at most, and so many of those with the suffix first.
FIM_PERCENT = 90
SPM_PERCENT = 20

STORE = "doc_id long, marked boolean, units array<long>, chars array<long>, frames array<binary>"


def unit_starts(piece: str, before: str) -> np.ndarray:
    """Whether a unit begins at each code point of ``piece``; ``before``: the code point ahead of it."""
    at = np.frombuffer((before + piece).encode("utf-32-le"), np.uint32)
    low = at | np.uint32(32)
    letter = (low >= 97) & (low <= 122)
    ahead = np.concatenate([[False], letter[:-1]])
    return (~(letter & ahead))[len(before):]


class Frames:
    """A text as independent frames. ``units`` and ``chars`` have the counts
    before each frame and, last, those of the whole text."""

    def __init__(self, units: list[int], chars: list[int], frames: list[bytes]):
        self.units, self.chars, self.frames = units, chars, frames
        self.open = zstandard.ZstdDecompressor()

    @classmethod
    def of(cls, pieces: Iterable[str], size: int = FRAME_CHARS) -> "Frames":
        """Frames of the text that ``pieces`` make up."""
        packer = zstandard.ZstdCompressor(level=LEVEL)
        units, chars, frames, last, held = [0], [0], [], "", ""

        def add(piece: str) -> None:
            nonlocal last
            units.append(units[-1] + int(np.count_nonzero(unit_starts(piece, last))))
            chars.append(chars[-1] + len(piece))
            frames.append(packer.compress(piece.encode()))
            last = piece[-1]

        for piece in pieces:
            held = held + piece if held else piece
            at = 0
            while len(held) - at >= size:
                add(held[at:at + size])
                at += size
            held = held[at:]
        if held:
            add(held)
        return cls(units, chars, frames)

    def frame(self, k: int) -> str:
        return self.open.decompress(self.frames[k]).decode()

    def cut(self, k: int) -> int:
        """Code points of the first ``k`` units; one frame is decompressed for it."""
        if k >= self.units[-1]:
            return self.chars[-1]
        f = bisect_right(self.units, k) - 1
        before = self.frame(f - 1)[-1] if f else ""
        starts = np.flatnonzero(unit_starts(self.frame(f), before))
        return self.chars[f] + int(starts[k - self.units[f]])

    def read(self, start: int, end: int) -> Iterator[str]:
        """The code points from ``start`` to ``end``, a frame at a time."""
        f = max(bisect_right(self.chars, start) - 1, 0)
        while start < end:
            piece = self.frame(f)[start - self.chars[f]:end - self.chars[f]]
            yield piece
            start += len(piece)
            f += 1

    def find(self, mark: str, start: int) -> int:
        """Where ``mark`` first is, from ``start`` on."""
        held, at = "", start
        for piece in self.read(start, self.chars[-1]):
            held += piece
            found = held.find(mark)
            if found >= 0:
                return at + found
            keep = min(len(held), len(mark) - 1)
            at, held = at + len(held) - keep, held[len(held) - keep:]
        raise ValueError(f"no {mark} in the text")


def draws(doc_id: int | None) -> list[int]:
    """The four numbers of a document."""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def plan(doc_id: int | None, marked: bool, text: Frames, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[str, int, int]:
    """Form, and where the prefix and the middle end (code points)."""
    n, (h1, h2, h3, h4) = text.units[-1], draws(doc_id)
    if not n or marked or h3 % 100 >= fim_percent:
        return "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < spm_percent else "psm"), text.cut(a), text.cut(b)


def output(text: Frames, form: str, a: int, b: int) -> Iterator[str]:
    """The transformed text, piece by piece."""
    end = text.chars[-1]
    if form == "plain":
        yield from text.read(0, end)
        return
    parts = {PREFIX: (0, a), SUFFIX: (b, end), MIDDLE: (a, b)}
    for mark in (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE):
        yield mark
        yield from text.read(*parts[mark])


def restored(out: Frames, form: str) -> Iterator[str]:
    """The text again, piece by piece, from an output and its form alone."""
    end = out.chars[-1]
    if form == "plain":
        yield from out.read(0, end)
        return
    second, first = (PREFIX, SUFFIX) if form == "spm" else (SUFFIX, PREFIX)
    at = out.find(second, len(first))
    middle = out.find(MIDDLE, at + len(second))
    ranges = {first: (len(first), at), second: (at + len(second), middle), MIDDLE: (middle + len(MIDDLE), end)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from out.read(*ranges[mark])


def store(docs: DataFrame, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """One row per document with its frames and their cumulative counts."""

    def make():
        def row(doc_id, text):
            text = text or ""
            f = Frames.of((text[k:k + frame_chars] for k in range(0, len(text), frame_chars)), frame_chars)
            yield doc_id, any(m in text for m in MARKS), f.units, f.chars, f.frames

        return row

    return per_row(docs.select("doc_id", "text"), STORE, make, 64)


def _each(stored: DataFrame, schema: str, of, fim_percent: int, spm_percent: int, out_rows: int) -> DataFrame:
    def make():
        def row(doc_id, marked, units, chars, frames):
            text = Frames(units, chars, frames)
            yield of(doc_id, text, *plan(doc_id, marked, text, fim_percent, spm_percent))

        return row

    return per_row(stored, schema, make, out_rows)


def outputs(stored: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, form, output): the transformed texts of a store."""
    return _each(stored, "doc_id long, form string, output string", lambda doc_id, text, form, a, b: (doc_id, form, "".join(output(text, form, a, b))), fim_percent, spm_percent, 64)


def restore(transformed: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of rows (doc_id, form, output)."""

    def make():
        return lambda doc_id, form, out: [(doc_id, "".join(restored(Frames.of([out]), form)))]

    return per_row(transformed.select("doc_id", "form", "output"), "doc_id long, text string", make, 64)


def _digest(pieces: Iterable[str]) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p.encode())
    return h.hexdigest()


def digests(stored: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Counts and digests of the outputs of a store, and of what they restore to."""

    def of(doc_id, text, form, a, b):
        h = hashlib.sha256()

        def hashed() -> Iterator[str]:
            for piece in output(text, form, a, b):
                h.update(piece.encode())
                yield piece

        out = Frames.of(hashed())
        cut = (None, None) if form == "plain" else (a, b - a)
        return doc_id, text.units[-1], form, *cut, h.hexdigest(), _digest(restored(out, form))

    return _each(stored, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", of, fim_percent, spm_percent, 1024)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(written(store(table(spark, sf_dir, "documents")), "op12-frames", "none"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), k AS (
  SELECT doc_id, t, u, len(u) AS n,
         ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
         ('0x' || h[17:24])::BIGINT % 100 AS c3, ('0x' || h[25:32])::BIGINT % 100 AS c4
  FROM d
), p AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain'
              WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(c1, c2)], '') AS a,
         array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS b,
         array_to_string(u[greatest(c1, c2) + 1:n], '') AS c
  FROM k
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
              ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
