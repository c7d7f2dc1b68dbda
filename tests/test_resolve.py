import pytest

from pairscreen.operators import resolve
from pairscreen.operators.retrieval import topk_rank


def dedupe(spark, rows):
    df = spark.createDataFrame(rows, "q_id long, c_id long, contact_score double")
    return sorted(tuple(r) for r in resolve.dedupe_unordered(df).collect())


def test_dedupe_keeps_the_best_orientation(spark):
    assert dedupe(spark, [(1, 2, 0.6), (2, 1, 0.9), (3, 1, 0.7)]) == [(2, 1, 0.9), (3, 1, 0.7)]


def test_dedupe_tie_keeps_the_first(spark):
    assert dedupe(spark, [(2, 1, 0.9), (1, 2, 0.9)]) == [(1, 2, 0.9)]


def test_dedupe_is_idempotent_and_keeps_self_pairs(spark):
    once = dedupe(spark, [(1, 1, 0.6), (1, 1, 0.8), (1, 2, 0.5)])
    assert once == [(1, 1, 0.8), (1, 2, 0.5)] and dedupe(spark, once) == once


def test_dedupe_of_a_hot_pair(spark):
    df = spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 1 else id end q_id", "2L c_id", "id / 3000.0 contact_score"
    )
    got = resolve.dedupe_unordered(df.withColumn("contact_score", df.contact_score.cast("double")))
    assert got.count() == 2000 and got.where("q_id = 1").first().contact_score == pytest.approx(2997 / 3000)


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, 0.4), (2, 0.4000001)], "id long, contact_score double")
    assert [r.id for r in resolve.keep_above(df, 0.4).collect()] == [2]


def best(spark, rows, threshold=0.4):
    df = spark.createDataFrame(
        rows, "q_id long, c_id long, contact_score double, rank int, is_host boolean"
    )
    return [tuple(r) for r in resolve.best_host(df, threshold).orderBy("q_id").collect()]


def test_best_host_and_flag(spark):
    rows = [
        (1, 10, 0.5, 1, True), (1, 11, 0.7, 2, True), (1, 90, 0.6, 3, False),
        (2, 10, 0.5, 2, True), (2, 91, 0.8, 1, False),
        (3, 92, 0.9, 1, False),  # no host candidate
        (4, 10, 0.4, 1, True),  # equal to the threshold
    ]
    assert best(spark, rows) == [(1, 11, 0.7, True), (2, 10, 0.5, False)]


def test_ties_go_to_retrieval_order(spark):
    rows = [(1, 10, 0.7, 3, True), (1, 11, 0.7, 2, True), (1, 90, 0.7, 1, False)]
    assert best(spark, rows) == [(1, 11, 0.7, False)]
    rows = [(1, 10, 0.7, 1, True), (1, 90, 0.7, 2, False)]
    assert best(spark, rows) == [(1, 10, 0.7, True)]


def test_order_and_argmax(spark):
    df = spark.createDataFrame([(1, 5, 0.1, 2), (1, 6, 0.1, 1), (2, 7, 0.3, 1)], "q long, c long, s double, r int")
    assert {(r.q, r.c) for r in resolve.argmax_first(df, "q", "s", "r").collect()} == {(1, 6), (2, 7)}
    assert [r.c for r in resolve.order_results(df, "s", ["c"]).collect()] == [7, 5, 6]
    assert [r.c for r in resolve.order_by_rank(df, "q", "r").collect()] == [6, 5, 7]
    names = spark.createDataFrame([(5, "five"), (6, "six"), (7, "seven")], "id long, protein_id string")
    assert {r.name for r in resolve.with_ids(df, names, "c", "name").collect()} == {"five", "six", "seven"}


def test_ranks_are_cut_before_the_shuffle(spark):
    """A hot group sends its best rows of each partition, not all of them."""
    df = spark.range(1000).selectExpr("id div 5000 as q", "id as c", "id % 7 as s")
    for ranked in (topk_rank(df, "q", "s", "c", 3), resolve.argmax_first(df, "q", "s", "c")):
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("Exchange hashpartitioning") :]
        assert "WindowGroupLimit" in below
    assert [r.c for r in topk_rank(df, "q", "s", "c", 3).orderBy("rank").collect()] == [6, 13, 20]
