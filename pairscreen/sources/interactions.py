"""Labelled interaction data sets."""

from pyspark.sql import functions as F

from pairscreen.operators.knowns import UNKNOWN
from pairscreen.schemas import INTERACTIONS


def read_interactions(spark, path, split=None):
    """All splits, or one of them: the table is partitioned by ``split``, so
    the others are not read.  "all" means all splits."""
    df = spark.read.schema(INTERACTIONS).parquet(path)
    return df if split in (None, "all") else df.where(F.col("split") == split)


def write_interactions(df, path, mode="overwrite"):
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_ddi(spark, path, split="train"):
    """A data set without clusters: both set to unknown."""
    unknown = F.lit(UNKNOWN).cast("bigint")
    return read_interactions(spark, path, split).withColumns(
        {"seq1_cluster": unknown, "seq2_cluster": unknown}
    )
