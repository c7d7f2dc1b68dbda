"""Whitening against numpy."""

import numpy as np
import pytest

from pairscreen.llm import whitening


def plain(ids, vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return ((n * x - total) ** 2).sum(axis=1), centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(got, vectors, k):
    deviation, white, share = plain(range(len(vectors)), vectors, k)
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((table * white).sum(axis=0))
    assert np.allclose(table, white * sign, atol=1e-8)
    assert got.drop_duplicates("vec_id").sort_values("vec_id")["deviation"].tolist() == deviation.tolist()
    assert np.allclose(got.drop_duplicates("component").sort_values("component")["explained"], share)
    assert (got["n"] == len(vectors)).all() and got["identity_error"].max() < 1e-9


@pytest.mark.parametrize("blocks", [1_024, 7])
def test_given_vectors(spark, monkeypatch, blocks):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", blocks)
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(5)
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.collect())
    got = whitening.whiten(table).toPandas()
    assert [i for i, _ in rows] == list(range(len(rows))) and len(got) == 32 * len(rows)
    check(got, [v for _, v in rows], 32)


def test_awkward_rows(spark):
    rng = np.random.default_rng(0)
    good = rng.normal(size=(40, 3)).astype(np.float32).astype(float).tolist()
    rows = [(i, v, 1) for i, v in enumerate(good)]
    bad = [(90, None, 1), (91, [1.0, None, 2.0], 1), (92, [1.0, float("nan"), 2.0], 1), (93, [float("inf"), 1.0, 1.0], 1), (94, [], 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, component int")
    check(whitening.whiten(table).toPandas(), good, 3)
    assert whitening.whiten(table.where("vec_id >= 90")).count() == 0
    assert whitening.whiten(table.limit(0)).columns[:2] == ["vec_id", "component"]
    twice = spark.createDataFrame([(None, v, 1) for v in good] + [(7, v, 1) for v in good], table.schema)
    assert whitening.whiten(twice).where("vec_id IS NULL").count() == 120


def test_axes_without_variance(spark):
    rows = [(i, [float(i), 1.0, 2.0 * i]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert (got.loc[got["component"] > 1, "whitened"] == 0).all()
    assert got.loc[got["component"] == 1, "explained"].round(12).eq(1).all() and got["identity_error"].max() < 1e-9
    one = whitening.whiten(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")).toPandas()
    assert (one["whitened"] == 0).all() and (one["explained"] == 0).all() and (one["deviation"] == 0).all()


def test_vectors_of_two_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))
