"""The proteins of one proteome never meet in one task of the store's joins."""

import pytest
from pyspark.sql import functions as F

from pairscreen.operators.encode import HashedKmerEncoder
from pairscreen.sources.store import EncodedStore, of_proteomes

N = 4_000


@pytest.fixture
def rows(spark):
    return spark.range(N).select(
        F.when(F.col("id") % 40 == 0, "small").otherwise("large").alias("proteome_id"),
        F.col("id").cast("int").alias("seq_idx"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("protein_id"),
        F.lit("ACDE").alias("sequence"),
    )


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle, each partition as dealt."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_missing_deals_a_large_proteome_out(spark, tmp_path, rows, shuffled):
    left = EncodedStore(spark, str(tmp_path / "store"), HashedKmerEncoder(dim=4)).missing(rows)
    assert left.columns == [*rows.columns, "content_hash", "encoder_version", "max_len"]
    assert left.count() == N
    assert _largest(left) < N / 8


def test_read_deals_a_large_proteome_out(spark, tmp_path, rows, shuffled):
    store = EncodedStore(spark, str(tmp_path / "store"), HashedKmerEncoder(dim=4))
    whole = store.ensure(rows)
    assert whole.columns == store.read().columns
    assert whole.count() == N
    assert _largest(whole) < N / 8
    assert store.missing(rows).count() == 0
    assert store.read(rows.where("proteome_id = 'small'")).count() == N // 40


def test_parts_keep_nulls_and_copies(spark):
    schema = "proteome_id string, seq_idx int, protein_id string, sequence string"
    rows = spark.createDataFrame(
        [("a", None, None, "X"), ("a", None, None, "X"), ("a", 1, "p", None), ("b", 1, "p", "Y"), (None, 1, "p", "Z")], schema
    )
    found = spark.createDataFrame([("a",), ("c",), (None,)], "proteome_id string")
    got = of_proteomes(rows, found)
    assert got.columns == rows.columns
    want = rows.where("proteome_id = 'a'").collect()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want))
