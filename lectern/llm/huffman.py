"""Canonical length-limited Huffman code over integer ids, and its block format.

A block stands alone: ids of whole documents, the documents' keys and lengths,
the bits, and the bit offset of every ``STEP``-th id. Decoding is by table:
all stretches between two offsets advance together, one id a step.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

#: Longest code word in bits; 2 ** LIMIT table entries, and no more distinct ids than that.
LIMIT = 20
#: Ids between two bit-offset checkpoints.
STEP = 256

_HEAD = struct.Struct("<4sIIIQ")
_MAGIC = b"LHB1"


def code_lengths(counts: Sequence[int], limit: int = LIMIT) -> np.ndarray:
    """Optimal code-word lengths of at most ``limit`` bits by package merge (0: id not used)."""
    counts = np.asarray(counts, np.int64)
    ids = np.flatnonzero(counts)
    ids = ids[np.argsort(counts[ids], kind="stable")]
    out, n = np.zeros(len(counts), np.uint8), len(ids)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit in {limit} bits")
    if n < 2:
        out[ids] = 1
        return out
    weights = counts[ids].astype(np.float64)
    levels, merged = [], weights
    for _ in range(limit):  # each level: is the i-th cheapest a single id (or a package of the level below)?
        levels.append(merged)
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        levels[-1] = (order < n, levels[-1])
    # levels[k][0] tells singles of level k + 1; the lowest level has singles only
    singles = [np.ones(n, bool)] + [single for single, _ in levels[:-1]]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for single in reversed(singles):
        taken = int(single[:take].sum())
        lengths[:taken] += 1
        take = 2 * (min(take, len(single)) - taken)
    out[ids] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words in order of (length, id)."""
    lengths = np.asarray(lengths).astype(np.int64)
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        # each word's interval starts where the last one's ended
        sizes = np.uint64(1) << (np.uint64(32) - lengths[order].astype(np.uint64))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.uint64)
        codes[order] = (starts >> (np.uint64(32) - lengths[order].astype(np.uint64))).astype(np.uint32)
    return codes


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.codes = canonical(self.lengths)
        self.bits = int(self.lengths.max(initial=1))
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        spans = 1 << (self.bits - self.lengths[order].astype(np.int64))
        self.ids = np.repeat(order.astype(np.uint32), spans)  # by the next ``bits`` bits
        self.sizes = np.repeat(self.lengths[order], spans)

    def write(self, keys: Sequence[int], sizes: Sequence[int], ids: np.ndarray) -> bytes:
        """A block of the documents ``keys`` with ``sizes`` ids each."""
        n = np.asarray(ids, np.int64)
        widths = self.lengths[n].astype(np.int64)
        if len(n) and not widths.min():
            raise ValueError("an id without a code word")
        ends = np.cumsum(widths)
        starts = ends - widths
        total = int(ends[-1]) if len(n) else 0
        words = np.zeros(total // 32 + 2, np.uint64)
        # a word of at most 32 bits lies in one or two 32-bit cells
        cell, shift = starts >> 5, (64 - (starts & 31) - widths).astype(np.uint64)
        both = self.codes[n].astype(np.uint64) << shift
        if len(n):
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            words[cell[first]] += np.add.reduceat(both >> np.uint64(32), first)
            words[cell[first] + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
        marks = starts[::STEP].astype("<u8")
        return b"".join((_HEAD.pack(_MAGIC, len(sizes), STEP, len(marks), len(n)), np.asarray(keys, "<i8").tobytes(),
                         np.asarray(sizes, "<u8").tobytes(), marks.tobytes(), words.astype(">u4").tobytes()))

    def read(self, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, sizes, ids) of a block."""
        magic, docs, step, n_marks, n = _HEAD.unpack_from(block)
        if magic != _MAGIC:
            raise ValueError("not a block of this format")
        at = _HEAD.size
        keys = np.frombuffer(block, "<i8", docs, at)
        sizes = np.frombuffer(block, "<u8", docs, at + 8 * docs)
        marks = np.frombuffer(block, "<u8", n_marks, at + 16 * docs).astype(np.int64)
        cells = np.frombuffer(block, ">u4", offset=at + 16 * docs + 8 * n_marks).astype(np.uint64)
        out = np.zeros(n_marks * step, np.uint32)
        here, down = marks.copy(), np.uint64(64 - self.bits)
        mask = np.uint64((1 << self.bits) - 1)
        pair = (cells[:-1] << np.uint64(32)) | cells[1:]
        lanes = np.arange(n_marks) * step
        last = n - (n_marks - 1) * step  # ids in the last stretch
        for k in range(step if n_marks else 0):
            if k == last:
                here, lanes = here[:-1], lanes[:-1]
            window = (pair[here >> 5] >> (down - (here & 31).astype(np.uint64))) & mask
            out[lanes + k] = self.ids[window]
            here += self.sizes[window]
        return keys, sizes, out[:n]
