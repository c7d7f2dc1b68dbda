"""What moves when two sides meet in tiles."""

import numpy as np
import pytest

from pairscreen.operators import retrieval, tiles


@pytest.mark.parametrize("ratio", [0.25, 1])
@pytest.mark.parametrize("slots", [12, 200])
def test_copies_follow_the_root_of_the_slots(slots, ratio):
    moved = []
    for n in (10_000, 100_000, 600_000):
        left = int(n * ratio)
        cut, _ = tiles._cut([(0, left, n)], slots, 100_000, 4_000_000, (1, 1))
        n_lb, n_rb = cut[0][1:3]
        assert n_lb >= -(-left // 100_000) and n_lb * n_rb <= 2 * slots
        moved.append((left * n_rb + n * n_lb) / (left + n))
    assert max(moved) <= 2.5 * slots**0.5 + 1
    # Ten times the rows: the copies of a row grow by far less.
    assert moved[1] <= 5 * moved[0] and moved[2] <= 2.5 * moved[1]


def test_both_sides_are_cut_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(tiles, "ROWS_PER_TILE", 16)
    monkeypatch.setattr(tiles, "MIN_BLOCK", 8)
    rng = np.random.default_rng(3)
    m = rng.integers(-3, 4, (300, 6)).astype(float)  # many ties
    rows = [(i, int(i % 3), m[i].tolist()) for i in range(300)]
    q = spark.createDataFrame(rows, "q_id long, space long, vec array<double>")
    k = q.withColumnRenamed("q_id", "c_id")
    plan = retrieval._plan(*retrieval._sides(q, k, "q_id", "vec", "c_id", "vec", None, None), 5, None, None, None)
    assert min(plan.pieces) > 1
    order = [sorted(range(300), key=lambda j: (-float(s[j]), j)) for s in m @ m.T]
    got = {(r.q_id, r["rank"]): r.c_id for r in retrieval.topk_by_space(q, k, 5).collect()}
    assert got == {(i, r + 1): order[i][r] for i in range(300) for r in range(5)}
    own = {(r.q_id, r["rank"]): r.c_id for r in retrieval.topk_by_space(q, k, 4, q_space="space", k_space="space").collect()}
    assert own == {(i, r + 1): [j for j in order[i] if j % 3 == i % 3][r] for i in range(300) for r in range(4)}
    each = retrieval.topk_by_space(q, k, 2, per="space")
    got = {(r.q_id, r.space, r["rank"]): r.c_id for r in each.collect()}
    assert got == {(i, s, r + 1): [j for j in order[i] if j % 3 == s][r] for i in range(300) for s in range(3) for r in range(2)}
