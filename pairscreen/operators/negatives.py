"""Negative pairs by position inside a batch.

Rows carry ``batch_id`` and a dense ``idx`` from 0; the whole table may be one
batch.  Results are ``(batch_id, idx1, idx2)``: query side of ``idx1`` with key
side of ``idx2``.  Pairs whose clusters are known partners are left out.
"""

from pyspark.sql import functions as F

from pairscreen.operators.in_batch import hard_negatives
from pairscreen.operators.knowns import mark_known

DEFAULT_RATIOS = {"random": 1.0, "self": 1.0, "hard": 0.0}


def _sized(df, ratio, batch):
    """Rows with ``b``, the batch size, and ``n``, the negatives asked for."""
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("b"))
    n = F.floor(F.col("b") * F.lit(float(ratio))).cast("bigint")
    return df.join(sizes.withColumn("n", n), batch)


def _unknown(pairs, known, batch):
    if known is not None:
        pairs = mark_known(pairs, known, "c1", "c2", how="anti")
    return pairs.select(F.col(batch).alias("batch_id"), "idx1", "idx2")


def random_negatives(
    df, ratio=1.0, known=None, batch="batch_id", idx="idx", c1="c1", c2="c2", keep_wraps=False
):
    """Cyclic shifts: row i with row i + s for s = 1, 2, ... until
    ``int(b * ratio)`` pairs; the last shift covers the first rows only.  A
    shift that wraps onto the row itself is no negative unless asked for."""
    rows = _sized(df.select(batch, idx, c1), ratio, batch).where("b > 1 and n > 0")
    shifts = F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("n") / F.col("b")).cast("bigint"))
    pairs = (
        rows.withColumn("s", F.explode(shifts))
        .where(F.col(idx) < F.col("n") - (F.col("s") - 1) * F.col("b"))
        .select(
            batch,
            F.col(idx).cast("bigint").alias("idx1"),
            F.pmod(F.col(idx) + F.col("s"), F.col("b")).cast("bigint").alias("idx2"),
            F.col(c1).alias("c1"),
        )
    )
    if not keep_wraps:
        pairs = pairs.where("idx1 <> idx2")
    if known is not None:
        other = df.select(batch, F.col(idx).cast("bigint").alias("idx2"), F.col(c2).alias("c2"))
        pairs = pairs.join(other, [batch, "idx2"])
    return _unknown(pairs, known, batch)


def self_negatives(df, ratio=1.0, known=None, batch="batch_id", idx="idx", c1="c1", c2="c2"):
    """The first ``int(b * ratio)`` rows, each with itself."""
    pairs = (
        _sized(df.select(batch, idx, c1, c2), ratio, batch)
        .where(F.col(idx) < F.least("b", "n"))
        .select(
            batch,
            F.col(idx).cast("bigint").alias("idx1"),
            F.col(idx).cast("bigint").alias("idx2"),
            F.col(c1).alias("c1"),
            F.col(c2).alias("c2"),
        )
    )
    return _unknown(pairs, known, batch)


def all_negatives(df, ratios=None, known=None, q="q", k="k", **names):
    """Random, self and hard negatives together, with their ``source``; a kind
    with ratio 0 adds nothing."""
    ratios = {**DEFAULT_RATIOS, **(ratios or {})}
    parts = [
        random_negatives(df, ratios["random"], known, **names).withColumn("source", F.lit("random")),
        self_negatives(df, ratios["self"], known, **names).withColumn("source", F.lit("self")),
    ]
    if ratios["hard"] > 0:
        hard = hard_negatives(df, ratios["hard"], known, q=q, k=k, **names)
        parts.append(hard.withColumn("source", F.lit("hard")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
