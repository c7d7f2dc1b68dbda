"""The given Parquet tables."""


def load(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")
