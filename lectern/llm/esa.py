"""Enhanced suffix array over byte fragments and its common-prefix interval tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def suffix_order(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (start, end in ``text``) in order of their first ``depth`` bytes,
    and the common prefix of each with the one before (0 for the first)."""
    width = -(-depth // 8) * 8
    lengths = np.minimum(ends - starts, depth)
    columns = np.zeros((width, len(starts)), np.uint8)
    for k in range(depth):  # a byte of every suffix at a time: nothing wider than the bytes themselves is held
        inside = np.flatnonzero(lengths > k)
        columns[k, inside] = text[starts[inside] + k]
    rows = np.ascontiguousarray(columns.T)
    del columns
    words = rows.view(">u8")
    order = np.lexsort((lengths, *(words[:, k].astype(np.uint64) for k in range(words.shape[1] - 1, -1, -1))))
    rows, lengths = rows[order], lengths[order]
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(1), differ.argmax(1), width)
        common[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return order, common


def maximal_repeats(common: Sequence[int], before: Sequence[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, from, to) of the intervals of a suffix array that are maximal repeats.

    One scan with a stack of open intervals of the common-prefix tree: an
    interval closes when the common prefix falls below its length. It is a
    maximal repeat if its suffixes aren't all preceded by the same byte;
    ``before`` has that byte, negative values for none (a start of a fragment,
    each different from all others). Its occurrences are all suffixes from..to-1.
    """
    stack: list[list[int]] = []  # [length, from, byte before, or DIVERSE]
    diverse = -1 << 40
    n = len(common)
    for i in range(1, n + 1):
        c = common[i] if i < n else 0
        c = c if c >= least else 0
        start, left = i - 1, before[i - 1]
        while stack and stack[-1][0] > c:
            length, start, mine = stack.pop()
            left = mine if mine == left else diverse
            if left == diverse:
                yield length, start, i
        if c:
            if stack and stack[-1][0] == c:
                if stack[-1][2] != left:
                    stack[-1][2] = diverse
            else:
                stack.append([c, start, left])
        # the suffix at i is met when it is looked at next, as the one before
    return


def repeats(fragments: Sequence[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of at least ``least`` bytes: (length, all occurrences as (fragment, offset))."""
    text = np.frombuffer(b"".join(fragments), np.uint8)
    sizes = np.array([len(f) for f in fragments], np.int64)
    if not len(text):
        return
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(fragments)), np.maximum(sizes - least + 1, 0))
    first = (ends - sizes)[owner]
    counts = np.maximum(sizes - least + 1, 0)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = first + within
    order, common = suffix_order(text, starts, ends[owner], int(sizes.max()))
    starts, owner, within = starts[order], owner[order], within[order]
    before = np.where(within > 0, text[np.maximum(starts - 1, 0)].astype(np.int64), -1 - starts)
    for length, a, b in maximal_repeats(common.tolist(), before.tolist(), least):
        yield length, list(zip(owner[a:b].tolist(), within[a:b].tolist()))
