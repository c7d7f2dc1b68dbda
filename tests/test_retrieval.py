import numpy as np
import pandas as pd
import pytest

from pairscreen.functions import inner_product
from pairscreen.operators import retrieval, tiles
from test_kernels import brute


def frames(spark, q, k=None):
    k = q if k is None else k
    as_rows = lambda m: [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return (
        spark.createDataFrame(as_rows(q), "q_id long, vec array<float>"),
        spark.createDataFrame(as_rows(k), "c_id long, vec array<float>"),
    )


def triples(df):
    return sorted((r.q_id, r.c_id, r.ip) for r in df.collect())


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    m = rng.standard_normal((200, 8)).astype(np.float32)
    m[::3] = m[0]  # copies hold a third
    m[7] = 0
    return m


def test_blocks_and_shards_change_nothing(spark, points):
    q, k = frames(spark, points)
    want = sorted(brute(points, points, 6))
    for block, shard in ((None, None), (30, 40), (7, 500), (1000, 9)):
        got = retrieval.topk_by_space(q, k, 6, query_block=block, key_shard=shard)
        assert triples(got) == want
        ranks = got.groupBy("q_id").agg({"rank": "sum", "*": "count"}).toPandas()
        assert (ranks["sum(rank)"] == 21).all() and (ranks["count(1)"] == 6).all()


def test_self_is_ranked_then_dropped(spark, points):
    q, k = frames(spark, points)
    got = retrieval.topk_inner_product(q, k, 5).toPandas()
    assert (got.q_id != got.c_id).all()
    n = got.groupby("q_id").size()
    # The zero vector and late copies do not find themselves: k + 1 remain.
    assert set(n) == {5, 6} and n[7] == 6


def test_more_neighbours_than_keys(spark):
    q, k = frames(spark, np.eye(3, dtype=np.float32))
    assert retrieval.topk_inner_product(q, k, 100).count() == 6


def test_single_vector_has_no_candidates(spark):
    q, k = frames(spark, np.ones((1, 4), dtype=np.float32))
    assert retrieval.topk_inner_product(q, k, 10).count() == 0


def test_empty_sides(spark):
    q, k = frames(spark, np.ones((2, 4), dtype=np.float32))
    assert retrieval.topk_by_space(q, k.limit(0), 3).count() == 0
    assert retrieval.topk_by_space(q.limit(0), k, 3).count() == 0


def test_lengths_must_agree(spark):
    k = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "c_id long, vec array<float>")
    q = spark.createDataFrame([(0, [1.0, 2.0])], "q_id long, vec array<float>")
    with pytest.raises(Exception, match="differ in length"):
        retrieval.topk_by_space(q, k, 3).collect()


def test_bulk_and_expression_give_the_same_bits(spark, points):
    q, k = frames(spark, points)
    top = retrieval.topk_by_space(q, k, 4)
    both = top.join(q.withColumnRenamed("vec", "qv"), "q_id").join(k.withColumnRenamed("vec", "kv"), "c_id")
    assert both.where(inner_product("qv", "kv") != both.ip).count() == 0


def space_frames(spark, points):
    spaces = np.where(np.arange(len(points)) % 3 == 0, "big", np.where(np.arange(len(points)) % 2, "a", "b"))
    rows = [(i, str(s), [float(x) for x in v]) for i, (s, v) in enumerate(zip(spaces, points))]
    df = spark.createDataFrame(rows, "id long, space string, vec array<float>")
    return spaces, df.withColumnRenamed("id", "q_id"), df.withColumnRenamed("id", "c_id")


@pytest.mark.parametrize("local", [True, False])
def test_spaces_are_searched_apart(spark, points, monkeypatch, local):
    if not local:
        monkeypatch.setattr(tiles, "MAX_LOCAL_SPACES", 1)
        monkeypatch.setattr(tiles, "MAX_PARTITIONS", 5)
    spaces, q, k = space_frames(spark, points)
    got = triples(
        retrieval.topk_by_space(
            q, k, 4, q_space="space", k_space="space", query_block=10, key_shard=20
        )
    )
    want = []
    for s in set(spaces):
        at = np.flatnonzero(spaces == s)
        want += [(int(at[i]), int(at[j]), v) for i, j, v in brute(points[at], points[at], 4)]
    assert got == sorted(want)


@pytest.mark.parametrize("shard", [None, 13])
def test_best_per_key_group(spark, points, shard):
    spaces, q, k = space_frames(spark, points)
    got = retrieval.topk_by_space(q, k, 3, per="space", key_shard=shard)
    got = sorted((r.q_id, r.space, r.c_id, r.ip) for r in got.collect())
    want = []
    for s in set(spaces):
        at = np.flatnonzero(spaces == s)
        want += [(i, str(s), int(at[j]), v) for i, j, v in brute(points, points[at], 3)]
    assert got == sorted(want)


def test_string_ids(spark):
    q = spark.createDataFrame([("x", [1.0, 0.0])], "q_id string, vec array<float>")
    k = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], "c_id string, vec array<float>")
    assert [r.c_id for r in retrieval.topk_by_space(q, k, 1).collect()] == ["a"]


def test_union_is_the_top_of_both_sides(spark, points):
    host, viral = points[:120], points[120:]
    hosts = np.where(np.arange(120) % 3 == 0, "h0", "h1")
    own = np.where(np.arange(len(viral)) % 2, "v0", "v1")
    hk = spark.createDataFrame(
        [(i, str(h), [float(x) for x in v]) for i, (h, v) in enumerate(zip(hosts, host))],
        "c_id long, host_proteome string, vec array<float>",
    )
    rows = [(1000 + i, str(o), [float(x) for x in v]) for i, (o, v) in enumerate(zip(own, viral))]
    q = spark.createDataFrame(rows, "q_id long, viral_proteome string, vec array<float>")
    got = retrieval.topk_union(q, hk, q.withColumnRenamed("q_id", "c_id"), 5)
    got = sorted((r.q_id, r.host_proteome, r.c_id, r.is_host, r["rank"], r.ip) for r in got.collect())
    want = []
    for h in ("h0", "h1"):
        for o in ("v0", "v1"):
            hi, vi = np.flatnonzero(hosts == h), np.flatnonzero(own == o)
            keys = np.concatenate([host[hi], viral[vi]])
            ids = [int(x) for x in hi] + [1000 + int(x) for x in vi]
            pos = {}
            for i, j, v in brute(viral[vi], keys, 6):
                pos[i] = pos.get(i, 0) + 1
                if ids[j] != 1000 + int(vi[i]):
                    want.append((1000 + int(vi[i]), h, ids[j], j < len(hi), pos[i], v))
    assert got == sorted(want)


def test_rank_against_any_bar(spark, points):
    q, k = frames(spark, points)
    top = retrieval.topk_by_space(q, k, 9)
    barred = top.where("rank = 9 or rank = 4 and q_id % 2 = 0").orderBy("rank").dropDuplicates(["q_id"])
    bars = q.join(barred.selectExpr("q_id", "ip bar", "c_id bar_id", "rank want"), "q_id")
    got = retrieval.rank_against(bars, k, query_block=40, key_shard=33).join(bars.select("q_id", "want"), "q_id")
    assert got.count() == len(points) and got.where("rank <> want").count() == 0


def test_no_product_in_the_plan(spark, points):
    q, k = frames(spark, points)
    plan = retrieval.topk_inner_product(q, k, 5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
