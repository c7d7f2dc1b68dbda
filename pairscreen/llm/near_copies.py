"""Groups of documents whose sets of five-word shingles have a Jaccard index of 0.8
or more: SimHash links and rare shared shingles propose, the sets themselves decide."""

from pyspark.sql import functions as F

from pairscreen.llm import bottom_k, simhash
from pairscreen.llm.shared import keep_first, keyed
from pairscreen.session import materialise


def _simhash_links(rows, marked, size):
    """Edges between the nodes whose fingerprints of ``size`` words link, n - 1 for n
    that are connected by them."""
    fps = simhash.fingerprints(rows.select("k1", "k2", "text"), "text", size)
    met = marked.where("node IS NOT NULL").select("k1", "k2", "node").join(fps, ["k1", "k2"])
    met = materialise(met.select("fp", "node").distinct(), "fingerprints")
    least = met.groupBy("fp").agg(F.min("node").alias("low"))
    same = met.join(least, "fp").where("node != low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    near = simhash.links(met.select("fp").distinct())
    for side in ("a", "b"):
        own = least.select(F.col("fp").alias(side), F.col("low").alias(f"node_{side}"))
        near = near.join(own, side)
    near = near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return materialise(same.union(near).where("a != b").distinct(), "simhash-links")


def keep_one(docs, id_col="doc_id", text_col="text", size=5, share=(4, 5)):
    """``docs`` with one row of each group that pairs of a Jaccard index of at least
    ``share`` (two whole numbers) connect: that of the smallest id (none is the
    largest), and of several with this id one of them.  All columns are kept as they
    are, whatever their names.

    A-Z count as a-z, words are runs of characters other than white space, and a
    text of fewer words than ``size`` is one shingle.  Texts of equal sets, such as
    copies, are one node and never compared.  Blank and null texts are copies of each
    other.  Fingerprints of ``size`` words that differ in at most 3 bits link most near
    copies but not all, so whoever may reach ``share`` by the inverted lists of
    ``bottom_k`` is proposed as well.  Every link is tested on whole sets; see
    ``bottom_k.near_duplicates`` for what may be missed.
    """
    rows = keyed(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")), "id", "text")
    marked = materialise(bottom_k.sketches(rows, size), "sketches")
    found = bottom_k.roots(marked, rows, size, share, _simhash_links(rows, marked, size))
    rooted = marked.select("id", "k1", "k2", "node").join(found, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node", F.lit(0).cast("long")))
    return keep_first(docs, rooted, id_col, text_col)
