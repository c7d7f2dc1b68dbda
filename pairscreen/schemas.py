"""Explicit schemas of the tables the operators read and write (never inferred)."""

from pyspark.sql import types as T

_vec = T.ArrayType(T.FloatType())

CONTACTS = T.ArrayType(
    T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())])
)

PROTEINS = T.StructType(
    [
        T.StructField("proteome_id", T.StringType()),
        T.StructField("seq_idx", T.IntegerType()),
        T.StructField("protein_id", T.StringType()),
        T.StructField("sequence", T.StringType()),
        T.StructField("length", T.IntegerType()),
    ]
)

ENCODED = T.StructType(
    [
        T.StructField("proteome_id", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("encoder_version", T.StringType()),
        T.StructField("max_len", T.IntegerType()),
        T.StructField("seq_idx", T.IntegerType()),
        T.StructField("protein_id", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("q", _vec),
        T.StructField("k", _vec),
        T.StructField("residues", T.ArrayType(_vec)),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("match_id", T.StringType()),
        T.StructField("contact_score", T.DoubleType()),
    ]
)

CROSS_RESULTS = T.StructType(
    [
        T.StructField("viral_id", T.StringType()),
        T.StructField("host_id", T.StringType()),
        T.StructField("contact_score", T.DoubleType()),
        T.StructField("host_is_best_contact", T.BooleanType()),
    ]
)

PAIR_STATUS = T.StructType(
    [
        T.StructField("host_proteome", T.StringType()),
        T.StructField("viral_proteome", T.StringType()),
        T.StructField("n_candidates", T.LongType()),
        T.StructField("n_results", T.LongType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("run_id", T.StringType()),
    ]
)

INTERACTIONS = T.StructType(
    [
        T.StructField("complex_id", T.StringType()),
        T.StructField("seq1", T.StringType()),
        T.StructField("seq2", T.StringType()),
        T.StructField("seq1_cluster", T.LongType()),
        T.StructField("seq2_cluster", T.LongType()),
        T.StructField("contacts", CONTACTS),
        T.StructField("split", T.StringType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
