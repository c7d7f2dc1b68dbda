"""How the given tables stand in for proteins, proteomes and interactions.

Vectors are ``embeddings``; a proteome is a label, 0-7 hosts and 8-9 viral.
Residues are the vectors regrouped: protein floor(sqrt(id)), position the rest.
Interactions are ``lineitem`` rows, with no clusters where l_returnflag = 'R'.
"""

from pyspark.sql import functions as F

from pairscreen.operators.pooling import gather_residues, mean_pool
from pairscreen.sources.tables import load

DIM = 64


def vectors(spark, d):
    return load(spark, d, "embeddings").select(
        F.col("vec_id"), F.col("embedding").alias("vec"), "label"
    )


def as_queries(df):
    return df.withColumnRenamed("vec_id", "q_id")


def as_keys(df):
    return df.withColumnRenamed("vec_id", "c_id")


def residues_long(spark, d):
    protein = F.floor(F.sqrt(F.col("vec_id").cast("double"))).cast("bigint")
    return vectors(spark, d).select(
        protein.alias("protein"), (F.col("vec_id") - protein * protein).alias("pos"), "vec"
    )


def residues(spark, d):
    return gather_residues(residues_long(spark, d), "protein", "pos", "vec")


def pooled(spark, d):
    return mean_pool(residues_long(spark, d), "protein", dim=DIM)


def batched_pairs(spark, d):
    """Vector 2i as query with vector 2i + 1 as its key, 25 pairs to a batch;
    ``idx`` counts inside the batch and ``pair`` over the table."""
    v = vectors(spark, d)
    pair = F.floor(F.col("vec_id") / 2).cast("bigint")
    even = v.where("vec_id % 2 = 0").select(
        pair.alias("pair"), F.col("vec").alias("q"), F.col("label").cast("bigint").alias("c1")
    )
    odd = v.where("vec_id % 2 = 1").select(
        pair.alias("pair"), F.col("vec").alias("k"), F.col("label").cast("bigint").alias("c2")
    )
    return even.join(odd, "pair").select(
        F.floor(F.col("pair") / 25).cast("bigint").alias("batch_id"),
        (F.col("pair") % 25).alias("idx"),
        "pair",
        "q",
        "k",
        "c1",
        "c2",
    )


def whole_batch(spark, d):
    """The same pairs as one batch."""
    return batched_pairs(spark, d).withColumns({"batch_id": F.lit(0).cast("bigint"), "idx": F.col("pair")})


def same_label(spark, d):
    """Known partners: a label with itself."""
    label = F.col("label").cast("bigint")
    return vectors(spark, d).select(label.alias("c1"), label.alias("c2")).distinct()


def interactions(spark, d):
    known = F.col("l_returnflag") != "R"
    return load(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
        F.when(known, F.col("l_partkey")).alias("seq1_cluster"),
        F.when(known, F.col("l_suppkey")).alias("seq2_cluster"),
    )


# The same as SQL, for WITH clauses.
SQL_RESIDUES = """
res AS (SELECT floor(sqrt(vec_id))::BIGINT AS protein,
               vec_id - floor(sqrt(vec_id))::BIGINT * floor(sqrt(vec_id))::BIGINT AS pos,
               embedding::DOUBLE[] AS vec FROM embeddings)"""

SQL_POOLED = """
cells AS (SELECT protein, generate_subscripts(vec, 1) AS dim, unnest(vec) AS x FROM res),
dims AS (SELECT protein, dim, avg(x) AS m FROM cells GROUP BY protein, dim),
pooled AS (SELECT protein, list(m ORDER BY dim) AS v FROM dims GROUP BY protein)"""

SQL_PAIRS = """
pairs AS (SELECT e.vec_id // 50 AS batch_id, (e.vec_id // 2) % 25 AS idx, e.vec_id // 2 AS pair,
                 e.embedding::DOUBLE[] AS q, o.embedding::DOUBLE[] AS k,
                 e.label::BIGINT AS c1, o.label::BIGINT AS c2
          FROM embeddings e JOIN embeddings o ON o.vec_id = e.vec_id + 1 WHERE e.vec_id % 2 = 0)"""

SQL_WHOLE = SQL_PAIRS.replace(
    "e.vec_id // 50 AS batch_id, (e.vec_id // 2) % 25 AS idx", "0::BIGINT AS batch_id, e.vec_id // 2 AS idx"
)

SQL_INTERACTIONS = """
inter AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag,
                 CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS seq1_cluster,
                 CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS seq2_cluster FROM lineitem)"""
