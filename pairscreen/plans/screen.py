"""All-vs-all screen of one set of proteins."""

from pyspark.sql import functions as F

from pairscreen.operators.contacts import contact_scores
from pairscreen.operators.resolve import dedupe_unordered, keep_above
from pairscreen.operators.retrieval import topk_inner_product
from pairscreen.operators.training import require_min
from pairscreen.session import materialise


def screen(encoded, top_k=100, threshold=0.5, scorer=None, id_col="protein_id", by_id=False):
    """``(query_id, match_id, contact_score)``, one row per unordered pair above
    the threshold.

    ``encoded`` has ``id_col``, ``q``, ``k``, ``residues``, ``length`` and ``row_id``, a
    unique BIGINT in input order.  Pairs are told apart by ``row_id``; with
    ``by_id`` by their external ids, so that repeated ids collapse.
    """
    require_min(encoded, 2)
    queries = encoded.select(F.col("row_id").alias("q_id"), F.col("q").alias("vec"))
    keys = encoded.select(F.col("row_id").alias("c_id"), F.col("k").alias("vec"))
    candidates = materialise(topk_inner_product(queries, keys, top_k), "candidates")
    res = encoded.select("row_id", "length", "residues")
    scored = contact_scores(
        candidates,
        res.withColumnRenamed("row_id", "q_id"),
        res.withColumnRenamed("row_id", "c_id"),
        scorer,
    )
    kept = keep_above(scored, threshold).join(candidates, ["q_id", "c_id"])
    names = encoded.select("row_id", id_col)
    named = kept.join(
        names.select(F.col("row_id").alias("q_id"), F.col(id_col).alias("query_id")), "q_id"
    ).join(names.select(F.col("row_id").alias("c_id"), F.col(id_col).alias("match_id")), "c_id")
    order = ["q_id", "rank"]
    a, b = ("query_id", "match_id") if by_id else ("q_id", "c_id")
    return dedupe_unordered(named, a, b, order=order).select("query_id", "match_id", "contact_score")
