"""A suffix sort whose comparisons are by hashes: the in-task part of ``repeats``.

Prefix polynomial hashes (modulo 2^64, a random number for each byte value) give the hash
of any substring in constant time, and a binary search over lengths the common extension
of two suffixes.  A bottom-up mergesort orders suffixes with that comparison; both the
searches and the merges run over whole arrays.  Equal hashes are not trusted: strings that
they call equal are compared byte by byte before they count.
"""

from __future__ import annotations

import numpy as np

_DRAW = np.random.default_rng(20240229)
BYTE = _DRAW.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_DRAW.integers(1, 1 << 62)) * 8 + 5
#: Bytes that are compared at once.
CHUNK = 1 << 22


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % (1 << 64)), np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_POWER, _BACK = _powers(BASE, 1), _powers(BASE, 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    global _POWER, _BACK
    if len(_POWER) < n:
        _POWER, _BACK = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
    return _POWER[:n], _BACK[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of a byte array, that of the empty one first."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


class Suffixes:
    """Suffixes of one byte array, compared on their first ``length`` bytes, all of which must be there."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix, self.back = prefix_hashes(data), powers(len(data) + 1)[1]
        self.windows = np.lib.stride_tricks.sliding_window_view(data, length)

    def _same(self, p: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the hashes of the ``n`` bytes at ``p`` and at ``q`` agree."""
        return (self.prefix[p + n] - self.prefix[p]) * self.back[p] == (self.prefix[q + n] - self.prefix[q]) * self.back[q]

    def equal(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the first ``length`` bytes at ``p`` and at ``q`` are the same, byte by byte."""
        out = np.zeros(len(p), bool)
        step = max(1, CHUNK // self.length)
        for at in range(0, len(p), step):
            out[at : at + step] = (self.windows[p[at : at + step]] == self.windows[q[at : at + step]]).all(axis=1)
        return out

    def extension(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``p`` and at ``q`` have in common by their hashes, ``length`` at most."""
        found = np.full(len(p), self.length, np.int64)
        differ = np.flatnonzero(~self._same(p, q, found))
        p, q = p[differ], q[differ]
        low, high = np.zeros(len(p), np.int64), np.full(len(p), self.length - 1, np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self._same(p, q, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        found[differ] = low
        return found

    def less(self, p: np.ndarray, q: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the suffix at ``p`` comes before that at ``q`` (or is equal to it)."""
        n = self.extension(p, q)
        a, b = self.data[p + np.minimum(n, self.length - 1)], self.data[q + np.minimum(n, self.length - 1)]
        # hashes that agree by chance end the search too late: such a pair is compared by bytes
        wrong = np.flatnonzero((n < self.length) & (a == b))
        if len(wrong):
            differ = self.windows[p[wrong]] != self.windows[q[wrong]]
            n[wrong] = np.where(differ.any(axis=1), differ.argmax(axis=1), self.length)
            at = np.minimum(n[wrong], self.length - 1)
            a[wrong], b[wrong] = self.data[p[wrong] + at], self.data[q[wrong] + at]
        return np.where(n < self.length, a < b, or_equal)

    def sorted(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Positions ``at`` in the order of their group (given in ascending order), then of their suffixes."""
        at = at.copy()
        first = np.searchsorted(group, group, "left")
        size = np.searchsorted(group, group, "right") - first
        place = np.arange(len(at)) - first
        width, longest = 1, int(size.max()) if len(at) else 0
        while width < longest:
            if width == 1:
                # runs of one: a pair is in order or changes places
                left = np.flatnonzero((place % 2 == 0) & (place + 1 < size))
                swap = left[self.less(at[left + 1], at[left], or_equal=False)]
                at[swap], at[swap + 1] = at[swap + 1], at[swap]
                width = 2
                continue
            moving = np.flatnonzero(size > width)
            run, base, inside = place[moving] // width, first[moving], place[moving] % width
            other = run ^ 1
            start = np.minimum(other * width, size[moving])
            low, high = start.copy(), np.minimum(start + width, size[moving])
            left = run % 2 == 0
            # how many of the other run come before: those less, and for the right run also those equal
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                theirs, mine = at[base[open_] + middle], at[moving[open_]]
                before = np.empty(len(open_), bool)
                for side in (True, False):
                    k = np.flatnonzero(left[open_] == side)
                    before[k] = self.less(theirs[k], mine[k], or_equal=not side)
                low[open_[before]] = middle[before] + 1
                high[open_[~before]] = middle[~before]
            target = base + np.minimum(run, other) * width + inside + (low - start)
            merged = at.copy()
            merged[target] = at[moving]
            at = merged
            width *= 2
        return at


def repeated(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each position in ``at``, whether its ``length`` bytes are those of another position of its group.

    ``group`` is in ascending order.
    """
    if not len(at):
        return np.zeros(0, bool)
    suffixes = Suffixes(data, length)
    order = suffixes.sorted(at, group)
    pair = np.flatnonzero(group[1:] == group[:-1])  # the sort keeps each group's places
    equal = pair[suffixes.extension(order[pair], order[pair + 1]) == length]
    equal = equal[suffixes.equal(order[equal], order[equal + 1])]
    twice = np.zeros(len(at), bool)
    twice[equal] = twice[equal + 1] = True
    mark = np.zeros(len(data), bool)
    mark[order[twice]] = True
    return mark[at]
