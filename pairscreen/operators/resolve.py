"""From scored candidates to results."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairscreen.functions import pair_key


def keep_above(df, threshold, score="contact_score"):
    """Strictly above: a score equal to the threshold is dropped."""
    return df.where(F.col(score) > F.lit(float(threshold)))


def dedupe_unordered(df, a="q_id", b="c_id", score="contact_score", order=None):
    """One row per unordered pair: the highest score, in its original
    orientation; ties go to the first row in ``order`` (by default the smaller
    ``a``).  An aggregate rather than a window, so rows are combined before
    the shuffle and a hot pair is no hot task."""
    order = [a, b] if order is None else list(order)
    rest = [c for c in df.columns if c not in order]
    best = F.struct((-F.col(score)).alias("__neg"), *order, *rest)
    return (
        df.groupBy(pair_key(a, b).alias("__key"))
        .agg(F.min(best).alias("__best"))
        .select(*[F.col(f"__best.{c}").alias(c) for c in df.columns])
    )


def best_host(
    scored,
    threshold=0.4,
    by=("q_id",),
    c_id="c_id",
    score="contact_score",
    rank="rank",
    is_host="is_host",
):
    """The best host candidate per query, if above the threshold, with the flag
    whether no candidate of either side came before it.  First in retrieval
    order wins ties.  One aggregation gives both answers."""
    by = list(by)
    entry = F.struct(
        (-F.col(score)).alias("neg"), F.col(rank).alias("rank"), F.col(c_id), F.col(is_host)
    )
    return (
        scored.groupBy(*by)
        .agg(
            F.min(F.when(F.col(is_host), entry)).alias("h"),
            F.min(entry).alias("top"),
        )
        .where(F.col("h").isNotNull() & (-F.col("h.neg") > F.lit(float(threshold))))
        .select(
            *by,
            F.col(f"h.{c_id}").alias("host_id"),
            (-F.col("h.neg")).alias("contact_score"),
            F.col(f"top.{is_host}").alias("host_is_best_contact"),
        )
    )


def argmax_first(df, by, score, rank):
    """The whole first row of the best score of each group."""
    by = [by] if isinstance(by, str) else list(by)
    best = Window.partitionBy(*by).orderBy(F.desc(score), rank)
    return df.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn")


def order_results(df, score="contact_score", ids=()):
    return df.orderBy(F.desc(score), *ids)


def order_by_rank(df, by, rank="rank"):
    by = [by] if isinstance(by, str) else list(by)
    return df.orderBy(*by, rank)


def with_ids(df, names, key, out, id_col="protein_id", name_key="id"):
    """Swap a row number for its external id."""
    lookup = names.select(F.col(name_key).alias(key), F.col(id_col).alias(out))
    return df.join(lookup, key)
