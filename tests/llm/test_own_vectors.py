from pyspark.sql import functions as F

from pairscreen.llm import neighbours


def test_an_id_with_many_vectors_has_k_neighbours(spark):
    rows = [(0, [1.0, 0.001 * i]) for i in range(12)] + [(i, [1.0, 0.1 * i]) for i in range(1, 9)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(v, F.col("id") == 0, k=5, tables=2, probes=4).collect()
    assert len(got) == 12 * 5 and {r["vec_id"] for r in got} == {1, 2, 3, 4, 5}
