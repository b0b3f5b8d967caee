"""Byte-level BPE by a lazily determinised finite-state transducer.

A sequence of tokens is the BPE result of its bytes exactly when every token
alone and every adjacent pair of tokens is the BPE result of its own bytes
(merges inside a final token never look outside it). So the encoding of a
prefix ends in the one token that is compatible with the encoding before it,
and reading a byte only ever needs the last settled token and the bytes since.
Of that token only the parts of its right edge matter that some token joins with
the next byte; they and the bytes are the state. Transitions are made on first use: all chains of
tokens that a longer token could still replace are kept, and what they have
in common is emitted; once there is no room for more, states are made as needed
and not kept.
"""

from __future__ import annotations

import base64

#: States kept per worker.
MAX_STATES = 300_000

_FLUSH, _KEY, _KEPT = -1, -2, -3
_BYTES = [bytes([b]) for b in range(256)]
_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeTransducer:
    """``encode(piece)`` gives the ids of one pre-token."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.longer = {t[:k] for t in ranks for k in range(1, len(t))}  # proper prefixes: a token may go on
        self.spines: dict[bytes, tuple[list, list] | None] = {}
        #: Merges inside every token are made in order of rank, as in any trained
        #: vocabulary; otherwise pairs of tokens are tried by the merge loop.
        self.regular = True
        for token in ranks:
            self._spines(token)
        self.states: dict[tuple, dict] = {}
        self.edges: dict[tuple, tuple] = {}
        self.start = self._state(None, b"", [(0, ())], ())

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens that the merge loop joins last on the bytes of ``token``; None if it never gets there."""
        parts, ranks, last = [token[i:i + 1] for i in range(len(token))], self.ranks, -1
        while len(parts) > 2:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                return None
            self.regular &= rank >= last
            last = rank
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        self.regular &= ranks[token] >= last
        return parts[0], parts[1]

    def merge(self, piece: bytes) -> list[bytes]:
        """The defining merge loop; only for vocabularies that aren't regular."""
        parts, ranks = [piece[i:i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spines(self, token: bytes) -> tuple[list, list] | None:
        """Right and left edge of ``token`` back in time: (part, rank of the merge
        that made it, rank of the merge that uses it up). None: not a BPE result."""
        if token not in self.spines:
            rank = self.ranks.get(token)
            made = rank if len(token) > 1 else -1
            right, left = [(token, made, _NEVER)], [(token, made, _NEVER)]
            halves = self._halves(token) if rank is not None and len(token) > 1 else None
            if halves:
                for own, part, side in ((right, halves[1], 0), (left, halves[0], 1)):
                    own += [(t, m, min(u, rank)) for t, m, u in self._spines(part)[side]]
            self.spines[token] = (right, left) if rank is not None and (halves or len(token) == 1) else None
        return self.spines[token]

    def _token(self, t: bytes) -> bool:
        return t in self.ranks and self._spines(t) is not None

    def _edge(self, a: bytes | None, byte: int) -> tuple:
        """The parts on the right edge of ``a`` that some token joins with ``byte``:
        all that a following token can depend on."""
        if a is None:
            return ()
        if not self.regular:
            return (a,)
        key = (a, byte)
        if key not in self.edges:
            b = bytes([byte])
            self.edges[key] = tuple(x for x in self.spines[a][0] if x[0] + b in self.longer or x[0] + b in self.ranks)
        return self.edges[key]

    def _fits(self, edge: tuple, b: bytes) -> bool:
        """Whether no merge ever joins a part of ``edge`` with the start of ``b``:
        of two parts there at the same time, another merge uses up one before."""
        if edge and not self.regular:
            return self.merge(edge[0] + b) == [edge[0], b]
        if edge:
            ranks = self.ranks
            for y, y_made, y_used in self.spines[b][1]:
                for x, x_made, x_used in edge:
                    if y_made < x_used and x_made <= y_used:  # at equal ranks the left merge goes first
                        rank = ranks.get(x + y)
                        if rank is not None and rank < x_used and rank <= y_used:
                            return False
        return True

    def _state(self, last: bytes | None, pending: bytes, live: list[tuple[int, tuple]], edge: tuple) -> dict:
        """``live``: where in ``pending`` a token may start that goes on, and the
        tokens up to there; at the end, one may always start. Of ``last`` only
        its edge matters once a byte is pending."""
        key = (edge, pending) if pending else (last, pending)
        state = self.states.get(key)
        if state is None:
            state = {_FLUSH: [self.ranks[t] for t in live[-1][1]], _KEY: (last, pending, live, edge)}
            if len(self.states) < self.max_states:
                self.states[key] = state
                state[_KEPT] = True
        return state

    def _step(self, state: dict, byte: int) -> tuple[dict, list]:
        """The transition of ``state`` on ``byte``, kept while there is room."""
        last, pending, live, edge = state[_KEY]
        if not pending:
            edge = self._edge(last, byte)
        pending += _BYTES[byte]
        longer, ranks, on, end = self.longer, self.ranks, [], None
        for at in live:
            j, c = at
            t = pending[j:] if j else pending
            if end is None and t in ranks and self._token(t):
                e = self._edge(c[-1], t[0]) if c else edge
                if not e or self._fits(e, t):
                    end = c + (t,)
            if t in longer:
                on.append(at)
        on.append((len(pending), end))
        settled = ()
        if len(on) == 1:
            settled = end
        elif on[0][1]:
            first, common = on[0][1], 0
            while common < len(first) and all([c[common:common + 1] == first[common:common + 1] for _, c in on]):
                common += 1
            settled = first[:common]
        out = ()
        if settled:
            common, cut = len(settled), sum(map(len, settled))
            last, pending, on = settled[-1], pending[cut:], [(j - cut, c[common:]) for j, c in on]
            edge = self._edge(last, pending[0]) if pending else ()
            out = [ranks[t] for t in settled]
        to = self._state(last, pending, on, edge)
        if _KEPT in state and _KEPT in to:
            state[byte] = to, out
        return to, out

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:  # a pre-token that is itself a token is not split
            return [self.ranks[piece]]
        out: list[int] = []
        state = self.start
        for byte in piece:
            state, settled = state.get(byte) or self._step(state, byte)
            if settled:
                out += settled
        out += state[_FLUSH]
        return out


class Utf8Stream:
    """Incremental UTF-8 decoding: ``feed`` takes any cut of the bytes and
    returns the text that is complete; an unfinished character (at most three
    bytes) is the state. Invalid bytes become U+FFFD."""

    def __init__(self) -> None:
        self.rest = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.rest + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:  # a lead byte: how many bytes it wants
                if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    cut -= back
                break
            if lead < 0x80:
                break
        if last:
            cut = len(data)
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")
