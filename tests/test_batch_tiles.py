"""Tiles of a batch: how many, and the best cells of a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscreen.operators import in_batch


def test_copies_do_not_grow_with_the_batch(spark):
    rows = spark.range(3_000).select(F.lit(0).alias("batch_id"), F.col("id").alias("idx"))
    for n, most in ((100, 2), (1_000, 16), (3_000, 16)):
        sized = in_batch._blocked(rows.where(F.col("idx") < n), 64)
        assert {r.blocks for r in sized.select("blocks").distinct().collect()} == {most}


@pytest.mark.parametrize("n", [1, 3, 12])
def test_first_best_is_the_sorted_order(n):
    rng = np.random.default_rng(n)
    for s in (rng.integers(-2, 3, (40, 30)).astype(float), np.where(rng.random((40, 30)) < 0.9, -np.inf, 1.0)):
        order = np.argsort(-s, axis=1, kind="stable")[:, :n]
        cols, best = in_batch._first_best(s, n)
        assert (cols == order).all() and (best == np.take_along_axis(s, order, axis=1)).all()


def test_similarity_is_summed_left_to_right():
    rng = np.random.default_rng(5)
    q, k = rng.standard_normal((70, 9)), rng.standard_normal((1_100, 9))
    want = np.zeros((70, 1_100))
    for d in range(9):
        want += q[:, d][:, None] * k[:, d][None, :]
    assert (in_batch._similarity(q, k) == want).all()


def test_near_best_cells_are_exact():
    rng = np.random.default_rng(6)
    q, k = rng.standard_normal((300, 24)), np.repeat(rng.standard_normal((150, 24)), 2, axis=0)  # ties
    want = in_batch._similarity(q, k)
    sim, near = in_batch._product(q, k)
    for n in (1, 3):
        cols, best = in_batch._first_best(near(sim.copy(), n), n)
        order = np.argsort(-want, axis=1, kind="stable")[:, :n]
        assert (cols == order).all() and (best == np.take_along_axis(want, order, axis=1)).all()
