"""Recompression of texts: rounds that name runs and pairs of symbols, the same way wherever the same text stands.

Each round replaces maximal runs of one symbol by one name, then splits the alphabet in two by a hash of the symbol and
joins every (left, right) pair. A name is a 64-bit hash of its parts, so all texts on all machines name equal parts
alike without asking each other. A symbol that has reached `full` characters is not joined any further: it is an anchor.

With each symbol goes the range of characters that decided it: its own parts, and the neighbours that a round had to look
at before it left the symbol alone. Wherever those characters stand, in whatever text, the anchor stands, too; so what a
span's characters decide is common to all its occurrences, and it is known for every span whether it holds an anchor.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ROUNDS = 12
#: Rounds that look for runs.
RUN_ROUNDS = frozenset((0, 2))
BARRIER = np.uint64(0)
#: Pair round after which symbols are first taken as anchors.
FIRST_FULL = 3
#: Odd, so invertible, base of the window hashes.
BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_SIDES = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * _A) | np.uint64(1)
_HALF = np.uint64(1 << 63)
_CHARS = mix(np.arange(0x3000, dtype=np.uint64) + _A)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts in one array with a barrier 0 before, between and behind them; where each text begins, and one more."""
    raw = "\0" + "\0".join(t.replace("\0", "\x01") for t in texts) + "\0"
    x = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    return x, np.concatenate([[1], 1 + np.cumsum(lengths)])


def char_names(x: np.ndarray) -> np.ndarray:
    return np.take(_CHARS, x) if x.max(initial=0) < len(_CHARS) else mix(x.astype(np.uint64) + _A)


def anchors(x: np.ndarray, full: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, lo, hi) of the anchors of `x`: symbols that reached `full` characters, each decided by x[lo:hi]."""
    sym = char_names(x)
    done = x == 0
    sym[done] = BARRIER
    start = np.arange(len(x), dtype=np.int32)
    end = np.int32(len(x))
    lo, hi = start, start + np.int32(1)  # both never fall along the text, so the outermost part decides
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for rnd in range(ROUNDS):
        if len(sym) < 3:
            break
        if rnd in RUN_ROUNDS:
            again = np.flatnonzero((sym[1:] == sym[:-1]) & ~done[1:])
            open_ = ~done
            before, behind = np.arange(len(sym), dtype=np.int32), np.arange(len(sym), dtype=np.int32)
            before -= open_
            behind += open_
            if len(again):
                head = again[np.r_[True, again[1:] != again[:-1] + 1]]
                tail = again[np.r_[again[1:] != again[:-1] + 1, True]] + 1
                sym[head] = mix(sym[head] * _B + (tail - head + 1).astype(np.uint64))
                behind[head] = tail + 1
                drop = np.zeros(len(sym) + 1, np.int8)
                drop[head + 1] = 1
                drop[tail + 1] = -1
                keep = np.flatnonzero(np.cumsum(drop[:-1], dtype=np.int8) == 0)
                sym, start, done, before, behind = sym[keep], start[keep], done[keep], before[keep], behind[keep]
            np.maximum(before, 0, out=before)
            lo, hi = lo[before], hi[behind]
        # pairs: a left symbol before a right one; one that is left alone has looked at the neighbour on its open side
        left = (sym * _SIDES[rnd] < _HALF) & ~done
        right = ~(left | done)
        joined = left[:-1] & right[1:]
        at = np.flatnonzero(joined)
        a, b = sym[at], sym[at + 1]
        sym[at] = mix(a * _A + (b ^ (b >> np.uint64(29))) * _B)
        keep = np.flatnonzero(np.r_[True, ~joined])
        lo, hi = lo[np.maximum(keep - right[keep], 0)], hi[keep + left[keep]]
        sym, start, done = sym[keep], start[keep], done[keep]
        if rnd >= FIRST_FULL:
            ready = np.flatnonzero(~done & (np.diff(np.append(start, end)) >= full))
            found.append((sym[ready], lo[ready], hi[ready]))
            done[ready] = True
    names, los, his = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    return names, los, his


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, _INVERSE)):
            row = np.full(n, np.uint64(base), np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


class Windows:
    """Hashes of windows of characters: equal windows, and in all likelihood only those, have equal values."""

    def __init__(self, x: np.ndarray):
        powers, self.inverse = _power_tables(len(x) + 1)
        self.n = len(x)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(char_names(x) * powers[: len(x)], dtype=np.uint64)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of x[begin:end] for each pair."""
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64) * _C)
