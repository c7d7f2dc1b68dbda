"""What text is like is counted over every row, not over a sample."""

from pyspark.sql import functions as F

from pairscreen.llm import secret_scan


def test_steps_of_all_texts_are_counted(spark):
    n = 6_000
    docs = spark.range(n).select(F.concat(F.lit("ab "), F.col("id").cast("string")).alias("text"))
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(None,), ("",)], "text string"))
    got = secret_scan.background(twice)
    assert got["a", "b"] == n
    digits = sum(len(str(i)) - 1 for i in range(n))
    assert sum(got.values()) == n + digits


def test_a_rare_word_anywhere_counts(spark):
    docs = spark.range(9_000).select(
        F.when(F.col("id") % 3_000 == 7, "quartz-QZ").otherwise(F.concat(F.lit("plain "), F.col("id").cast("string"))).alias("text")
    )
    assert secret_scan.background(docs)["Q", "Z"] == 1
