"""Sequence-side operators over ``documents`` and ``pages``."""

from pyspark.sql import functions as F

from pairscreen.functions import basename
from pairscreen.operators import indexing, training
from pairscreen.operators.encode import HashedKmerEncoder, encode
from pairscreen.session import scratch
from pairscreen.sources.store import EncodedStore
from pairscreen.sources.tables import load

BATCH = 64
SAMPLE = 300
SMALL = HashedKmerEncoder(dim=4)


def _docs(spark, d):
    return load(spark, d, "documents")


def proteins(spark, d):
    """Documents as proteins, languages as proteomes; texts are kept whole."""
    return _docs(spark, d).select(
        F.col("lang").alias("proteome_id"),
        F.col("doc_id").cast("int").alias("seq_idx"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("protein_id"),
        F.col("text").alias("sequence"),
    )


def truncate_lengths(spark, d):
    docs = _docs(spark, d).select("doc_id", F.col("text").alias("sequence"))
    plain = training.truncate(docs, 1024).select("doc_id", "length")
    special = training.truncate(docs, 1024, special=2).select(
        "doc_id", F.col("length").alias("length_special")
    )
    return plain.join(special, "doc_id")


def residue_rows(spark, d):
    """Every residue of every text, then summed up per language and symbol."""
    docs = _docs(spark, d).select("lang", F.col("text").alias("sequence"))
    return (
        training.residue_rows(docs)
        .groupBy("lang", "residue")
        .agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"))
    )


def length_buckets(spark, d):
    docs = _docs(spark, d).select("lang", F.length("text").alias("length"))
    return (
        indexing.bucket_by_length(docs, "length", width=256)
        .groupBy("lang", "bucket_length")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ragged_offsets(spark, d):
    docs = _docs(spark, d).select("lang", "doc_id", F.length("text").alias("length"))
    return indexing.with_offsets(docs, ["doc_id"], "length", by=["lang"])


def batch_ids(spark, d):
    return indexing.with_batch_id(_docs(spark, d).select("doc_id"), BATCH, ["doc_id"])


def seeded_sample(spark, d):
    docs = _docs(spark, d).select("doc_id", "lang")
    return indexing.take_examples(docs, SAMPLE, "doc_id", 42)


def url_basename(spark, d):
    return load(spark, d, "pages").select(
        "page_id",
        basename("url", strip_extension=False).alias("file"),
        basename("url").alias("stem"),
    )


def encode_documents(spark, d):
    """Whole texts through the default encoder: one query and one key vector."""
    made = encode(proteins(spark, d), ["protein_id"], max_len=None, residues=False)
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return made.select(
        "protein_id",
        F.col("length").alias("n_residues"),
        F.size("q").alias("q_dim"),
        F.size("k").alias("k_dim"),
        F.round(norm, 4).alias("q_norm"),
    )


def encode_missing(spark, d):
    """The store holds one language and an outdated version of another; what
    is still to do is everything but the first."""
    store = EncodedStore(spark, scratch(spark, "store"), SMALL, max_len=None)
    rows = proteins(spark, d)
    stale = rows.where("proteome_id = 'fr'").withColumn("sequence", F.concat("sequence", F.lit("x")))
    store.write(store.encode(store.missing(rows.where("proteome_id = 'en'"))))
    store.write(store.encode(store.missing(stale)))
    return store.missing(rows).select("proteome_id", "protein_id", F.length("sequence").alias("length"))


QUERIES = {
    "truncate_lengths": truncate_lengths,
    "residue_rows": residue_rows,
    "length_buckets": length_buckets,
    "ragged_offsets": ragged_offsets,
    "batch_ids": batch_ids,
    "seeded_sample": seeded_sample,
    "url_basename": url_basename,
    "encode_documents": encode_documents,
    "encode_missing": encode_missing,
}

SQL = {
    "truncate_lengths": """
        SELECT doc_id, least(length(text), 1024)::INTEGER AS length,
               least(length(text), 1022)::INTEGER AS length_special FROM documents""",
    "residue_rows": """
        WITH r AS (SELECT lang, unnest(regexp_extract_all(text, '(?s).')) AS residue,
                          generate_subscripts(regexp_extract_all(text, '(?s).'), 1) - 1 AS pos FROM documents)
        SELECT lang, residue, count(*) AS n, max(pos)::INTEGER AS last_pos FROM r GROUP BY lang, residue""",
    "length_buckets": """
        SELECT lang, length(text) // 256 AS bucket_length, count(*) AS n FROM documents GROUP BY ALL""",
    "ragged_offsets": """
        SELECT lang, doc_id, length(text)::INTEGER AS length,
               coalesce(sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM documents""",
    "batch_ids": f"""
        SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch_id FROM documents""",
    "seeded_sample": f"""
        SELECT doc_id, lang FROM documents
        ORDER BY ('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT, doc_id LIMIT {SAMPLE}""",
    "url_basename": """
        SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS file,
               CASE WHEN regexp_matches(regexp_extract(url, '([^/]*)$', 1), '[^.]\\.[^.]*$')
                    THEN regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '')
                    ELSE regexp_extract(url, '([^/]*)$', 1) END AS stem FROM pages""",
    "encode_documents": """
        SELECT 'd' || doc_id AS protein_id, length(text)::INTEGER AS n_residues, 64 AS q_dim, 64 AS k_dim,
               1.0::DOUBLE AS q_norm FROM documents""",
    "encode_missing": """
        SELECT lang AS proteome_id, 'd' || doc_id AS protein_id, length(text)::INTEGER AS length
        FROM documents WHERE lang <> 'en'""",
}
