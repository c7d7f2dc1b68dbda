"""The words of a batch of texts as arrays: where they lie, and a hash of each."""

import numpy as np

#: White space that separates words: space and the control characters 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes worked on at once; powers of the base are kept for so many.
_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {}


def _powers(n):
    """``_BASE ** i`` and its inverse, for ``i`` below ``n``, modulo 2 ** 64."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _POWERS:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS.clear()
        _POWERS[size] = [
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse)
        ]
    return _POWERS[size]


def scramble(x):
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordTable:
    """Words of texts that lie one behind the other in ``raw``; text ``i`` is
    ``raw[rows[i]:rows[i + 1]]``.

    ``start`` and ``stop`` of each word are positions in ``raw``, ``row`` is its
    text and ``first[i]`` the number of words before text ``i``.  ``clean`` holds
    all words, each with one space behind it; word ``w`` begins at ``at[w]``.
    """

    def __init__(self, raw, rows):
        word = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[rows] = True  # no word reaches over the end of a text
        begins = word & (edge[:-1] | np.concatenate([[True], ~word[:-1]]))
        ends = word & (edge[1:] | np.concatenate([~word[1:], [True]]))
        self.start = np.flatnonzero(begins)
        self.stop = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, rows)
        self.row = np.repeat(np.arange(len(rows) - 1), np.diff(self.first))
        self.raw, self._word = raw, word

    def __len__(self):
        return len(self.start)

    def normalise(self):
        """Fill ``clean`` and ``at``."""
        size = self.stop - self.start
        self.at = np.concatenate([[0], np.cumsum(size + 1)])
        self.clean = np.full(self.at[-1], 0x20, np.uint8)
        gap = np.ones(self.at[-1], bool)
        gap[self.at[1:] - 1] = False
        self.clean[gap] = self.raw[self._word]

    def hashes(self):
        """64 bits for each word: a polynomial of its bytes, scrambled."""
        out = np.empty(len(self), np.uint64)
        done = 0
        while done < len(self):
            base = self.start[done]
            last = max(done + 1, np.searchsorted(self.stop, base + _CHUNK, side="right"))
            part = self.raw[base : self.stop[last - 1]]
            power, inverse = _powers(len(part) + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + 1) * power[: len(part)])])
            s, e = self.start[done:last] - base, self.stop[done:last] - base
            out[done:last] = (sums[e] - sums[s]) * inverse[s]
            done = last
        return scramble(out + (self.stop - self.start).astype(np.uint64))
