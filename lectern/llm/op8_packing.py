"""Operator 8: best-fit packing of documents into sequences by exact complements.

The plan depends only on how many pieces there are of each length (at most
``max_tokens`` numbers), so it is made from that histogram: for each length,
longest first, the gap it leaves is looked up among single, pair and triple
sums of the lengths still available, and a combination that fills it exactly
is used as often as all its lengths last; what remains is placed best-fit,
longest first, also by counts. The plan is a list of runs (length, ranks from,
to, first sequence, pieces a sequence, offset), a few per length. Every piece
finds its run by its rank among the pieces of its length; ranks come from
per-task counts, so no task or driver holds more than its own rows.

Null or empty texts are the end id alone; rows with equal ids are packed each
for itself; null doc_ids are kept; an empty table gives no rows; other columns
are not read. A text of any length is cut into ``max_tokens`` pieces, the
first one shorter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Mapping

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_row, table, written
from .tokens import library_encoder

#: The vocabulary, and the same as ranks.
TOKENIZER_FILE, RANKS_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
MAX_TOKENS = 2048
END_ID = 0


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n % most or most
    return [(0, min(first, n))] + [(s, most) for s in range(first, n, most)]


def token_pieces(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], end_id: int = END_ID,
                 max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, task, nth): ``nth`` counts
    the pieces of that length in the task that made them."""

    def make():
        encode, task, seen = encoder(), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()

        def row(doc_id, text):
            packed = memoryview(encode(text or "") + end)
            for piece, (start, length) in enumerate(cut(len(packed) // 4, max_tokens)):
                yield (doc_id, piece, start, length, zlib.crc32(packed[4 * start:4 * (start + length)]), task, seen[length])
                seen[length] += 1

        return row

    return per_row(docs.select("doc_id", "text"), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long", make)


class Packing:
    """Sequences planned from counts. ``runs``: (length, from rank, to rank,
    first sequence, pieces of the run in a sequence, offset of the first)."""

    def __init__(self, counts: Mapping[int, int], cap: int = MAX_TOKENS):
        if any(not 0 < x <= cap for x in counts):
            raise ValueError(f"lengths must be 1 to {cap}")
        self.cap, self.sequences = cap, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.left = np.zeros(cap + 1, np.int64)
        self.used = [0] * (cap + 1)
        for length, n in counts.items():
            self.left[length] = n
        self._exact()
        self._best_fit()

    def _take(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        """``n`` pieces go to the sequences from ``first`` on, ``each`` in one."""
        a = self.used[length]
        self.used[length] = a + n
        self.left[length] -= n
        self.runs.append((length, a, a + n, first, each, offset))

    def _pair(self, gap: int, most: int) -> tuple[int, ...] | None:
        """Two available lengths that sum to ``gap``, the larger at most ``most``."""
        low, high = (gap + 1) // 2, min(gap - 1, most)
        if low > high:
            return None
        have = (self.left[low:high + 1] > 0) & (self.left[gap - high:gap - low + 1][::-1] > 0)
        if 2 * low == gap and self.left[low] < 2:
            have[0] = False
        at = np.flatnonzero(have)
        return (low + int(at[-1]), gap - low - int(at[-1])) if len(at) else None

    def _fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to ``gap``."""
        if gap and self.left[gap]:
            return (gap,)
        pair = self._pair(gap, gap)
        if pair:
            return pair
        for x in np.flatnonzero(self.left[:max(gap - 1, 0)])[::-1].tolist():
            if 3 * x < gap:
                break
            self.left[x] -= 1
            pair = self._pair(gap - x, x)
            self.left[x] += 1
            if pair:
                return (x, *pair)
        return None

    def _exact(self) -> None:
        for length in range(self.cap, 0, -1):
            while self.left[length]:
                self.left[length] -= 1
                found = () if length == self.cap else self._fill(self.cap - length)
                self.left[length] += 1
                if found is None:
                    break
                parts = defaultdict(int)
                for x in (length, *found):
                    parts[x] += 1
                n, offset = min(int(self.left[x]) // k for x, k in parts.items()), 0
                for x, k in parts.items():
                    self._take(x, n * k, self.sequences, k, offset)
                    offset += x * k
                self.sequences += n

    def _best_fit(self) -> None:
        """Longest first into the smallest gap that takes it; ``open``: gap -> groups (first sequence, how many)."""
        open_: dict[int, list[tuple[int, int]]] = {}
        for length in range(self.cap, 0, -1):
            while self.left[length]:
                n = int(self.left[length])
                gap = min((g for g in open_ if g >= length), default=None)
                if gap is None:
                    each = self.cap // length
                    first, bins, gap = self.sequences, -(-n // each), self.cap
                    self.sequences += bins
                else:
                    first, bins = open_[gap].pop()
                    if not open_[gap]:
                        del open_[gap]
                    each = gap // length
                full = min(bins, n // each)
                if full:
                    self._take(length, full * each, first, each, self.cap - gap)
                    if gap - each * length:
                        open_.setdefault(gap - each * length, []).append((first, full))
                rest = min(n - full * each, each) if full < bins else 0
                if rest:
                    self._take(length, rest, first + full, rest, self.cap - gap)
                    if gap - rest * length:
                        open_.setdefault(gap - rest * length, []).append((first + full, 1))
                if full + bool(rest) < bins:
                    open_.setdefault(gap, []).append((first + full + bool(rest), bins - full - bool(rest)))

    def places(self) -> Callable[[int, int], tuple[int, int]]:
        """(length, rank among the pieces of that length) -> (sequence, offset)."""
        by = defaultdict(list)
        for length, a, _, first, each, offset in sorted(self.runs):
            by[length].append((a, first, each, offset))
        starts = {length: [r[0] for r in runs] for length, runs in by.items()}

        def place(length: int, rank: int) -> tuple[int, int]:
            a, first, each, offset = by[length][bisect_right(starts[length], rank) - 1]
            return first + (rank - a) // each, offset + (rank - a) % each * length

        return place


def pack(docs: DataFrame, tokenizer: str = TOKENIZER_FILE, ranks: str | None = RANKS_FILE, end_id: int = END_ID, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per piece with its sequence and place there."""
    pieces = written(token_pieces(docs, lambda: library_encoder(tokenizer, ranks), end_id, max_tokens), "op8-pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_tokens rows at most
    packing = Packing(counts, max_tokens)
    ranked = pieces.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def make():
        place = packing.places()
        return lambda doc_id, piece, start, length, crc, rank: [(doc_id, piece, start, length, crc, *place(length, rank))]

    return per_row(ranked, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", make)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
