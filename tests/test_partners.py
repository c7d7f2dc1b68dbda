"""Best key of a partner cluster against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscreen.operators import metrics
from pairscreen.operators.partners import RelatedBest, best_partner


def frames(spark, q, k, c1, c2, ids=int):
    kind = "long" if ids is int else "string"
    qs = [(ids(i), v.tolist(), c) for i, (v, c) in enumerate(zip(q, c1))]
    ks = [(ids(i), v.tolist(), c) for i, (v, c) in enumerate(zip(k, c2))]
    return (
        spark.createDataFrame(qs, f"q_id {kind}, vec array<double>, cluster string"),
        spark.createDataFrame(ks, f"c_id {kind}, vec array<double>, cluster string"),
    )


def plain(q, k, c1, c2, known, ids=int):
    out = {}
    for i in range(len(q)):
        valid = [(-float(q[i] @ k[j]), ids(j)) for j in range(len(k)) if (c1[i], c2[j]) in known]
        if valid:
            out[ids(i)] = min(valid)
    return out


def found(rows):
    out = {}
    for r in rows:
        out[r.q_id] = min(out.get(r.q_id, (np.inf, r.c_id)), (-r.ip, r.c_id))
    return out


@pytest.mark.parametrize("ids", [int, lambda i: f"p{i}"])
@pytest.mark.parametrize("block, shard", [(None, None), (16, 17), (400, 13), (9, 400)])
def test_best_partner(spark, ids, block, shard):
    """A hub cluster holds a third of both sides and goes with every other cluster."""
    rng = np.random.default_rng(5)
    n = 240
    q, k = rng.integers(-2, 3, (n, 4)).astype(float), rng.integers(-2, 3, (n, 4)).astype(float)
    c1 = ["hub" if i % 3 == 0 else f"c{rng.integers(40)}" for i in range(n)]
    c2 = ["hub" if i % 3 == 1 else f"c{rng.integers(40)}" for i in range(n)]
    c1[7] = c2[9] = None
    known = {("hub", f"c{i}") for i in range(40)} | {("c1", "hub"), ("c2", "c2"), ("c3", "nobody"), ("nobody", "c4")}
    qs, ks = frames(spark, q, k, c1, c2, ids)
    pairs = spark.createDataFrame(sorted(known), "c1 string, c2 string")
    got = found(best_partner(qs, ks, pairs, query_block=block, key_shard=shard).collect())
    assert got == plain(q, k, c1, c2, known, ids)


def test_queries_travel_once_per_shard(spark):
    """One query cluster with 200 partner clusters: in one shard its rows go in once."""
    rng = np.random.default_rng(6)
    q, k = rng.normal(size=(50, 4)), rng.normal(size=(200, 4))
    qs, ks = frames(spark, q, k, ["hub"] * 50, [f"c{j}" for j in range(200)])
    pairs = spark.createDataFrame([("hub", f"c{j}") for j in range(200)], "c1 string, c2 string")
    got = best_partner(qs, ks, pairs, query_block=25, key_shard=50).collect()
    per_query = max(sum(r.q_id == i for r in got) for i in range(50))
    assert per_query <= 4  # one row from each of 200 / 50 shards, not one from each partner cluster
    best = (q @ k.T).argmax(axis=1)
    assert {i: c for i, (_, c) in found(got).items()} == dict(enumerate(best.tolist()))


def test_nothing_related_or_empty(spark):
    q = np.eye(3)
    qs, ks = frames(spark, q, q, ["a", "b", None], ["x", "y", "z"])
    pairs = spark.createDataFrame([("a", "q"), ("p", "x")], "c1 string, c2 string")
    assert best_partner(qs, ks, pairs).count() == 0
    assert best_partner(qs, ks, pairs.limit(0)).count() == 0
    assert best_partner(qs.limit(0), ks, pairs).count() == 0
    ranks = metrics.first_valid_rank(qs, ks, pairs, own=False)
    assert {r["rank"] for r in ranks.collect()} == {4}


def test_keys_in_any_pieces_give_the_same():
    rng = np.random.default_rng(7)
    q, k = rng.integers(-2, 3, (60, 3)).astype(np.float32), rng.integers(-2, 3, (90, 3)).astype(np.float32)
    c1, c2 = rng.integers(0, 6, 60).astype(str).astype(object), np.sort(rng.integers(0, 9, 90).astype(str)).astype(object)
    left, right = np.array(["0", "1", "1", "5"], dtype=object), np.array(["3", "0", "8", "3"], dtype=object)
    want = plain(q, k, c1, c2, set(zip(left, right)))
    for size in (1, 7, 90):
        best = RelatedBest(q, c1)
        for s in range(0, 90, size):
            best.feed(k[s : s + size], np.arange(s, min(s + size, 90)), c2[s : s + size], left, right)
        got = {i: (-best.score[i], best.key[i]) for i in range(60) if best.score[i] > -np.inf}
        assert got == want
