import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairscreen.operators import dot_kernels as dk


def sequential(a, b):
    acc = np.zeros(len(a))
    for d in range(a.shape[1]):
        acc += a[:, d].astype(float) * b[:, d].astype(float)
    return acc


def brute(q, k, top):
    out = []
    for i in range(len(q)):
        s = sequential(np.repeat(q[i : i + 1], len(k), 0), k)
        order = np.lexsort((np.arange(len(k)), -s))[:top]
        out += [(i, int(j), s[j]) for j in order]
    return out


def feed(q, k, top, cut):
    run = dk.RunningTop(q, top)
    for s in range(0, len(k), cut):
        run.feed(k[s : s + cut], np.arange(len(k))[s : s + cut])
    return list(zip(run.rows.tolist(), run.key.tolist(), run.score.tolist()))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.integers(1, 60), st.integers(1, 9), st.integers(1, 25), st.integers(0, 9999))
def test_top_is_brute_force(nq, nk, top, cut, seed):
    rng = np.random.default_rng(seed)
    # Few distinct values, so that ties and copies abound.
    q = rng.integers(-2, 3, (nq, 6)).astype(np.float32)
    k = rng.integers(-1, 2, (nk, 6)).astype(np.float32)
    assert feed(q, k, top, cut) == brute(q, k, top)


@pytest.mark.parametrize("dtype", [np.float32, np.float64])
def test_top_is_exact_beyond_single_precision(dtype):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(64)
    k = (base + 1e-7 * rng.standard_normal((300, 64))).astype(dtype)  # all but equal
    q = rng.standard_normal((5, 64)).astype(dtype)
    assert feed(q, k, 7, 50) == brute(q, k, 7)


def test_hot_copies_keep_the_first_ones():
    rng = np.random.default_rng(2)
    k = rng.standard_normal((900, 8)).astype(np.float32)
    k[::3] = k[0]
    q = np.stack([k[0], -k[0], k[1]])
    assert feed(q, k, 11, 100) == brute(q, k, 11)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(1, 60), st.integers(1, 25), st.integers(0, 9999))
def test_rank_counts_what_comes_before(nq, nk, cut, seed):
    rng = np.random.default_rng(seed)
    q = rng.integers(-2, 3, (nq, 5)).astype(np.float32)
    k = rng.integers(-1, 2, (nk, 5)).astype(np.float32)
    bar_id = rng.integers(0, nk, nq)
    bar = sequential(q, k[bar_id])
    run = dk.RunningRank(q, bar, bar_id)
    for s in range(0, nk, cut):
        run.feed(k[s : s + cut], np.arange(nk)[s : s + cut])
    for i in range(nq):
        s = sequential(np.repeat(q[i : i + 1], nk, 0), k)
        before = (s > bar[i]) | ((s == bar[i]) & (np.arange(nk) < bar_id[i]))
        assert run.better[i] == before.sum()


def test_small_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    q, k = (rng.standard_normal((40, 16)).astype(np.float32) for _ in range(2))
    want = feed(q, k, 5, 40)
    monkeypatch.setattr(dk, "BLOCK_CELLS", 64)
    monkeypatch.setattr(dk, "EXACT_CHUNK", 10)
    assert feed(q, k, 5, 7) == want
