import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pairscreen.operators import indexing


def skewed(spark, n=700):
    rng = np.random.default_rng(0)
    # One group holds a third of the rows; the order column repeats.
    g = np.where(np.arange(n) % 3 == 0, "hot", rng.choice(list("abcd"), n))
    pdf = pd.DataFrame({"g": g, "o": rng.integers(0, 40, n), "id": np.arange(n), "len": rng.integers(0, 9, n)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_positions_match_a_single_window(spark):
    pdf, df = skewed(spark)
    want = pdf.sort_values(["g", "o", "id"]).copy()
    want["pos"] = want.groupby("g").cumcount()
    for slices in (1, 3, 16):
        got = indexing.with_position(df, ["o", "id"], ["g"], slices=slices).toPandas()
        m = got.merge(want, on=["g", "o", "id"], suffixes=("", "_w"))
        assert len(m) == len(pdf) and (m.pos == m.pos_w).all()


def test_global_position_is_dense(spark):
    pdf, df = skewed(spark)
    got = indexing.with_position(df, ["o", "id"]).toPandas().sort_values("pos")
    assert list(got.pos) == list(range(len(pdf)))
    assert list(got.id) == list(pdf.sort_values(["o", "id"]).id)


def test_offsets_are_exclusive_sums(spark):
    pdf, df = skewed(spark)
    got = indexing.with_offsets(df, ["o", "id"], "len", ["g"], slices=5).toPandas()
    want = pdf.sort_values(["g", "o", "id"]).copy()
    want["offset"] = want.groupby("g")["len"].cumsum() - want["len"]
    m = got.merge(want, on="id", suffixes=("", "_w"))
    assert (m.offset == m.offset_w).all()


def test_batches_are_full_but_for_the_last(spark):
    _, df = skewed(spark)
    sizes = indexing.with_batch_id(df, 64, ["id"]).groupBy("batch_id").count().toPandas()
    assert sorted(sizes["count"]) == [60] + [64] * 10


def test_take_examples_is_the_head_of_the_shuffle(spark):
    _, df = skewed(spark)
    shuffled = [r.id for r in indexing.seeded_shuffle(df.select("id"), "id", 7).collect()]
    taken = {r.id for r in indexing.take_examples(df, 50, "id", 7).collect()}
    assert taken == set(shuffled[:50])
    assert indexing.take_examples(df, 0, "id", 7).count() == 700
    assert shuffled != [r.id for r in indexing.seeded_shuffle(df.select("id"), "id", 8).collect()]


def test_more_slices_than_rows_and_than_before(spark):
    """No bound on the number of slices; empty ones count for nothing."""
    df = spark.range(40).withColumnRenamed("id", "o").withColumn("o", F.col("o") * 7)
    got = indexing.with_position(df, ["o"], slices=300).collect()
    assert sorted((r.o, r.pos) for r in got) == [(7 * i, i) for i in range(40)]
    assert got[0].asDict().keys() == {"o", "pos"}


def test_offsets_of_null_lengths(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (3, 0), (4, 5)], "id int, len int")
    got = {r.id: r.offset for r in indexing.with_offsets(df, ["id"], "len", slices=3).collect()}
    assert got == {1: 0, 2: 0, 3: 3, 4: 3}


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, o int, id int")
    assert indexing.with_position(df, ["o", "id"], ["g"]).count() == 0


def test_null_order_values_come_first(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (1, 3), (None, 4), (9, 5)], "o int, id int")
    got = indexing.with_position(df, ["o", "id"], slices=4).orderBy("pos").collect()
    assert [r.id for r in got] == [1, 4, 3, 2, 5]


def test_cyclic_partner(spark):
    df = spark.range(5).withColumnRenamed("id", "pos")
    got = {(r.pos, r["shift"]): r.partner for r in indexing.cyclic_partner(df, [1, 2], 5).collect()}
    assert got[(4, 1)] == 0 and got[(3, 2)] == 0 and len(got) == 10
