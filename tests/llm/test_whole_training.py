"""Languages are learned from every labelled row, not from a sample."""

import numpy as np
from pyspark.sql import functions as F

from pairscreen.llm import languages


def _grams(text):
    out = np.zeros(1 << languages.TABLE_BITS, np.int64)
    gram, n = languages.grams(text)
    out[gram] += n
    return out


def test_grams_of_all_rows_are_counted(spark):
    docs = spark.range(18_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "aa").otherwise("bb").alias("lang"),
        F.when(F.col("id") % 3 == 0, "lorem").otherwise("ipsum").alias("text"),
    )
    rows = docs.unionByName(spark.createDataFrame([(-1, None, "none"), (-2, "aa", None), (-3, "cc", "")], "doc_id long, lang string, text string"))
    names, counts = languages.train(rows)
    assert names == ["aa", "bb", "cc"]
    learned = docs.where(~languages.is_held_out("doc_id")).groupBy("lang").count().collect()
    times = {r["lang"]: r["count"] for r in learned}
    assert min(times.values()) > 4_000
    assert (counts == np.stack([_grams("lorem") * times["aa"], _grams("ipsum") * times["bb"], _grams("") * 0])).all()


def test_a_rare_word_of_a_language_is_learned(spark):
    rare = 7_001
    docs = spark.range(9_000).select(
        F.col("id").alias("doc_id"),
        F.lit("aa").alias("lang"),
        F.when(F.col("id") == rare, "xylq").otherwise("lorem").alias("text"),
    )
    assert not docs.where((F.col("id") == rare) & languages.is_held_out("id")).count()
    counts = languages.train(docs)[1]
    assert (counts[0][languages.grams("xylq")[0]] > 0).all()
