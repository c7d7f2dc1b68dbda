"""Array helpers used inside retrieval and scoring tasks.

Block products run in the precision of the input, with a rigorous rounding
bound; whatever the bound leaves open is recomputed left to right in DOUBLE.
Results are therefore exact and do not depend on how rows were batched.
"""

import numpy as np

# Elements of one block product held at a time.
BLOCK_CELLS = 2_000_000
# Keys are collected up to this many, or this many values, before a product.
KEY_ROWS, KEY_VALUES = 32_768, 8_000_000
# Pairs recomputed exactly at a time.
EXACT_CHUNK = 200_000


def rounding_bound(dim, dtype):
    """Factor g with |computed - true| <= g * |a| * |b| for a dot product."""
    u = np.finfo(dtype).eps / 2
    return dim * u / (1 - dim * u) * 1.01 + 1e-15 * dim


def below(bar, dtype):
    """``bar`` in ``dtype``, rounded down."""
    return bar if dtype == np.float64 else np.nextafter(bar.astype(dtype), dtype.type(-np.inf))


def lengths_of(m):
    return np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))


def exact_dots(a_t, rows, b_t, cols):
    """Dots of the (row, col) pairs, summed left to right in DOUBLE.  Inputs
    are transposed: (D, n)."""
    out = np.empty(len(rows), dtype=np.float64)
    for s in range(0, len(rows), EXACT_CHUNK):
        r, c = rows[s : s + EXACT_CHUNK], cols[s : s + EXACT_CHUNK]
        acc = np.zeros(len(r), dtype=np.float64)
        for d in range(a_t.shape[0]):
            acc += a_t[d].take(r).astype(np.float64) * b_t[d].take(c).astype(np.float64)
        out[s : s + EXACT_CHUNK] = acc
    return out


def distinct_rows(m):
    """(first positions, inverse) of groups of equal rows.  Rows are sorted by
    a hash and compared with their neighbour; should different rows share a
    hash, equal ones may end up in several groups, which costs time only."""
    n = len(m)
    if n == 0 or m.shape[1] == 0:
        return np.zeros(min(1, n), dtype=np.int64), np.zeros(n, dtype=np.int64)
    flat = np.ascontiguousarray(m) + np.zeros((), m.dtype)  # -0.0 becomes 0.0
    words = flat.view(np.uint32).astype(np.uint64)
    odd = np.arange(1, words.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    h = (words * odd).sum(axis=1, dtype=np.uint64)
    order = np.argsort(h, kind="stable")
    near = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    same = np.zeros(n, dtype=bool)
    same[near + 1] = (flat[order[near + 1]] == flat[order[near]]).all(axis=1)
    group = np.cumsum(~same) - 1
    inverse = np.empty(n, dtype=np.int64)
    inverse[order] = group
    return order[~same], inverse


def first_copies(m, k):
    """Positions keeping, of every set of equal rows, the first ``k``.  A later
    copy ties with ``k`` earlier ones and can never be among the best ``k``."""
    first, inverse = distinct_rows(m)
    if len(first) == len(m):
        return None
    order = np.argsort(inverse, kind="stable")
    sorted_inv = inverse[order]
    starts = np.searchsorted(sorted_inv, np.arange(len(first)))
    nth = np.arange(len(m)) - starts[sorted_inv]
    return np.sort(order[nth < k])


class RunningTop:
    """The best ``k`` keys per query so far, over keys fed in tie order."""

    def __init__(self, queries, k):
        self.q = queries
        self.q_t = np.ascontiguousarray(queries.T)
        self.q_len = lengths_of(queries)
        self.g = rounding_bound(queries.shape[1], queries.dtype)
        self.k = k
        self.rows = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=np.float64)
        self.key = None
        self.floor = np.full(len(queries), -np.inf)

    def feed(self, keys, key_ids):
        keep = first_copies(keys, self.k)
        if keep is not None:
            keys, key_ids = keys[keep], key_ids[keep]
        longest = lengths_of(keys).max()
        keys_t = np.ascontiguousarray(keys.T)
        step = max(1, BLOCK_CELLS // len(keys))
        found = [
            self._block(s, min(s + step, len(self.q)), keys_t, longest)
            for s in range(0, len(self.q), step)
        ]
        rows = np.concatenate([f[0] for f in found])
        cols = np.concatenate([f[1] for f in found])
        self._merge(rows, exact_dots(self.q_t, rows, keys_t, cols), key_ids[cols])

    def _block(self, lo, hi, keys_t, longest):
        s = self.q[lo:hi] @ keys_t
        slack = self.q_len[lo:hi] * longest * self.g
        bar = self.floor[lo:hi] - slack
        if s.shape[1] > self.k and np.isneginf(bar).any():
            bar = np.maximum(bar, self._kth(s) - 2 * slack)
        hit = s >= below(bar, s.dtype)[:, None]
        if s.shape[1] > self.k and np.count_nonzero(hit) > 8 * self.k * len(s):
            bar = np.maximum(bar, self._kth(s) - 2 * slack)
            hit = s >= below(bar, s.dtype)[:, None]
        r, c = np.divmod(np.flatnonzero(hit), s.shape[1])
        return r + lo, c

    def _kth(self, s):
        at = s.shape[1] - self.k
        return np.partition(s, at, axis=1)[:, at]

    def _merge(self, rows, score, key):
        if self.key is not None:
            if len(rows) == 0:
                return
            rows = np.concatenate([self.rows, rows])
            score = np.concatenate([self.score, score])
            key = np.concatenate([self.key, key])
        # Stable, and older keys come first: ties stay in key order.
        order = np.lexsort((-score, rows))
        rows, score, key = rows[order], score[order], key[order]
        starts = np.searchsorted(rows, np.arange(len(self.q)))
        nth = np.arange(len(rows)) - starts[rows]
        kept = nth < self.k
        self.rows, self.score, self.key = rows[kept], score[kept], key[kept]
        full = nth == self.k - 1
        self.floor[rows[full]] = score[full]


class RunningRank:
    """How many keys beat a given (score, key id) bar, per query."""

    def __init__(self, queries, bar, bar_ids):
        self.q = queries
        self.q_t = np.ascontiguousarray(queries.T)
        self.q_len = lengths_of(queries)
        self.g = rounding_bound(queries.shape[1], queries.dtype)
        self.bar, self.bar_ids = bar, bar_ids
        self.better = np.zeros(len(queries), dtype=np.int64)

    def feed(self, keys, key_ids):
        """``key_ids`` ascending."""
        first, inverse = distinct_rows(keys)
        uniq = keys[first]
        copies = np.bincount(inverse, minlength=len(first))
        by_copy = np.argsort(inverse, kind="stable")
        place = inverse[by_copy] * len(keys) + by_copy
        starts = np.concatenate([[0], np.cumsum(copies)[:-1]])
        longest = lengths_of(uniq).max()
        uniq_t = np.ascontiguousarray(uniq.T)
        before = np.searchsorted(key_ids, self.bar_ids, side="left")
        weights = copies.astype(keys.dtype)
        step = max(1, BLOCK_CELLS // len(uniq))
        for lo in range(0, len(self.q), step):
            hi = min(lo + step, len(self.q))
            s = self.q[lo:hi] @ uniq_t
            slack = self.q_len[lo:hi] * longest * self.g
            sure = -below(-(self.bar[lo:hi] + slack), s.dtype)[:, None]
            open_ = below(self.bar[lo:hi] - slack, s.dtype)[:, None]
            above = s > sure
            # Whole numbers far below 2**24: the product counts exactly.
            self.better[lo:hi] += (above.astype(s.dtype) @ weights).astype(np.int64)
            r, c = np.divmod(np.flatnonzero((s >= open_) & ~above), s.shape[1])
            if not len(r):
                continue
            r = r + lo
            exact = exact_dots(self.q_t, r, uniq_t, c)
            won = exact > self.bar[r]
            np.add.at(self.better, r[won], copies[c[won]])
            tie = exact == self.bar[r]
            r, c = r[tie], c[tie]
            earlier = np.searchsorted(place, c * len(keys) + before[r], side="left") - starts[c]
            np.add.at(self.better, r, earlier)


class KeyBuffer:
    """Collect small batches of keys for ``sink.feed``."""

    def __init__(self, sink):
        self.sink = sink
        self.keys, self.ids, self.rows = [], [], 0

    def add(self, keys, ids):
        self.keys.append(keys)
        self.ids.append(ids)
        self.rows += len(keys)
        if self.rows >= KEY_ROWS or self.rows * keys.shape[1] >= KEY_VALUES:
            self.flush()

    def flush(self):
        if self.rows:
            one = len(self.keys) == 1
            self.sink.feed(
                self.keys[0] if one else np.concatenate(self.keys),
                self.ids[0] if one else np.concatenate(self.ids),
            )
        self.keys, self.ids, self.rows = [], [], 0
