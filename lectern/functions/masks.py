"""Window bitmasks: exact distinct counts over many overlapping day windows.

A set of windows (days ``lo`` .. ``hi`` after an anchor) cuts the day axis
into *atoms*: maximal runs of days that every window either fully contains
or misses. Each entity (a book, a session, an event) is reduced to the OR
of its atoms' bits over the days it occurs on; it counts for a window iff its
mask meets the window's. So one aggregation per (user, entity) replaces one
``count(distinct case ...)`` per window, and Spark never needs the ``Expand``
that multiplies every input row by the number of distinct aggregates.

A mask is as long as it has to be: bit ``i`` is bit ``i % 63`` of word
``i // 63``, and every word is a bigint column of its own, so the whole mask
stays inside generated code and needs no limit on the number of windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..config import Window

WORD_BITS = 63


def atoms(windows: Sequence[Window]) -> list[tuple[int, int]]:
    """The coarsest day runs from which every window is a union."""
    bounds = sorted({w.lo for w in windows} | {w.hi + 1 for w in windows})
    return [(bounds[i], bounds[i + 1] - 1) for i in range(len(bounds) - 1)]


def word_count(bits: int) -> int:
    return -(-bits // WORD_BITS)


def word_names(prefix: str, bits: int) -> list[str]:
    return [f"{prefix}_{k}" for k in range(word_count(bits))]


def atom_words(window: Window, runs: Sequence[tuple[int, int]]) -> list[int]:
    """The window's mask over the atoms ``runs``, word by word."""
    return _words((i for i, (lo, hi) in enumerate(runs) if lo >= window.lo and hi <= window.hi), len(runs))


def span_words(lo: int, hi: int, bits: int) -> list[int]:
    """Mask of bits ``lo`` .. ``hi``, word by word."""
    return _words(range(lo, hi + 1), bits)


def _words(positions, bits: int) -> list[int]:
    out = [0] * word_count(bits)
    for p in positions:
        out[p // WORD_BITS] |= 1 << p % WORD_BITS
    return out


def atom_bit_sql(offset: str, runs: Sequence[tuple[int, int]]) -> list[str]:
    """SQL for each word of the bit of a day offset's atom, NULL outside every run.

    A literal lookup array indexed by the offset keeps this a constant-time
    expression inside whole-stage codegen.
    """
    first, last = runs[0][0], runs[-1][1]
    index = {day: i for i, (lo, hi) in enumerate(runs) for day in range(lo, hi + 1)}
    out = []
    for k in range(word_count(len(runs))):
        bits = [1 << index[d] % WORD_BITS if index[d] // WORD_BITS == k else 0 for d in range(first, last + 1)]
        lookup = ", ".join(f"{b}L" for b in bits)
        out.append(f"CASE WHEN {offset} BETWEEN {first} AND {last} THEN element_at(array({lookup}), {offset} - {first} + 1) END")
    return out


def position_bit_sql(position: str, bits: int, where: str) -> list[str]:
    """SQL for each word of bit ``position`` (an int expression) where the condition holds, else NULL."""
    out = []
    for k in range(word_count(bits)):
        inside = f"{where} AND {position} BETWEEN {k * WORD_BITS} AND {(k + 1) * WORD_BITS - 1}"
        out.append(f"CASE WHEN {inside} THEN shiftleft(1L, {position} - {k * WORD_BITS}) END")
    return out


def meets_sql(columns: Sequence[str], words: Sequence[int]) -> str:
    """SQL condition: the mask in ``columns`` shares a bit with ``words``."""
    tests = [f"({c} & {w}L) != 0" for c, w in zip(columns, words) if w]
    return f"({' OR '.join(tests)})" if tests else "false"


def count_sql(columns: Sequence[str], words: Sequence[int]) -> str:
    """SQL for how many bits the mask in ``columns`` shares with ``words``."""
    return "(" + " + ".join(f"coalesce(bit_count({c} & {w}L), 0)" for c, w in zip(columns, words) if w) + ")"
