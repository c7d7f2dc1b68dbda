"""Known interactions between clusters, and the examples behind a cluster.

A cluster of -1 is unknown and never part of a known pair.
"""

from pyspark.sql import functions as F

from pairscreen.functions.numbers import KEY_MULTIPLIER, composite_key

UNKNOWN = -1


def normalise_clusters(df, cols=("seq1_cluster", "seq2_cluster")):
    return df.withColumns({c: F.coalesce(F.col(c).cast("bigint"), F.lit(UNKNOWN).cast("bigint")) for c in cols})


def valid_clusters(df, c1="seq1_cluster", c2="seq2_cluster"):
    return df.where((F.col(c1) != UNKNOWN) & (F.col(c2) != UNKNOWN))


def interaction_keys(*frames, c1="seq1_cluster", c2="seq2_cluster", multiplier=None, unique=True):
    """Distinct known cluster pairs of all frames, in both directions, as
    ``(c1, c2)``; with a ``multiplier`` also as one BIGINT ``key``, which fails
    on clusters it cannot hold, unless it need not be ``unique``: pairs are told apart by
    their two columns.  Pairs are made distinct without regard to
    direction and doubled afterwards: one shuffle."""
    every = None
    for frame in frames:
        part = normalise_clusters(frame.select(F.col(c1).alias("c1"), F.col(c2).alias("c2")), ("c1", "c2"))
        every = part if every is None else every.unionByName(part)
    pairs = (
        valid_clusters(every, "c1", "c2")
        .select(F.least("c1", "c2").alias("lo"), F.greatest("c1", "c2").alias("hi"))
        .distinct()
    )
    ways = [
        F.struct(F.col(a).alias("c1"), F.col(b).alias("c2")) for a, b in (("lo", "hi"), ("hi", "lo"))
    ]
    keys = pairs.select(F.inline(F.array_distinct(F.array(*ways))))
    if multiplier is None:
        return keys
    return keys.withColumn("key", composite_key("c1", "c2", multiplier, unique))


def check_multiplier(df, c1="seq1_cluster", c2="seq2_cluster", multiplier=KEY_MULTIPLIER):
    """Fail early if a cluster id reaches the multiplier; the largest id, or
    ``None`` when no pair is known (known-pair masking then does nothing).  Without a
    multiplier the id is only reported, so that one can be chosen."""
    top = valid_clusters(normalise_clusters(df, (c1, c2)), c1, c2).agg(
        F.max(F.greatest(c1, c2))
    ).first()[0]
    if None not in (top, multiplier) and top >= multiplier:
        raise ValueError(f"cluster id {top} reaches the key multiplier {multiplier}")
    return top


def mark_known(pairs, known, c1="c1", c2="c2", out="known", how="flag"):
    """Is the cluster pair known?  ``how``: "flag" adds a column, "semi" keeps
    the known rows, "anti" the others.  ``known`` is distinct on (c1, c2)."""
    lookup = known.select(F.col("c1").alias(c1), F.col("c2").alias(c2))
    if how == "flag":
        marked = pairs.join(lookup.withColumn(out, F.lit(True)), [c1, c2], "left")
        return marked.withColumn(out, F.coalesce(out, F.lit(False)))
    return pairs.join(lookup, [c1, c2], f"left_{how}")


def cluster_members(df, example, c1="seq1_cluster", c2="seq2_cluster"):
    """Cluster to example as rows ``(cluster, example...)``: each example once
    under each of its clusters, once if both are the same.  Rows, not sets: a
    cluster may hold a large part of the table."""
    example = [example] if isinstance(example, str) else list(example)
    known = valid_clusters(normalise_clusters(df, (c1, c2)), c1, c2)
    return known.select(
        F.explode(F.array_distinct(F.array(F.col(c1), F.col(c2)))).alias("cluster"), *example
    )


def cluster_index(df, example, c1="seq1_cluster", c2="seq2_cluster"):
    """``cluster_members`` summed up: examples per cluster."""
    return (
        cluster_members(df, example, c1, c2)
        .groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("n_examples"))
    )


def dataset_summary(df, c1="seq1_cluster", c2="seq2_cluster"):
    """Examples, examples without clusters, and distinct clusters, as one row.
    Distinct clusters are counted after a distributed distinct."""
    rows = normalise_clusters(df.select(c1, c2), (c1, c2))
    has = (F.col(c1) != UNKNOWN) & (F.col(c2) != UNKNOWN)
    none = F.lit(None).cast("bigint")
    totals = rows.agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.count(F.when(~has, F.lit(1))).alias("n_without_clusters"),
        none.alias("n_clusters"),
    )
    clusters = (
        rows.where(has)
        .select(F.explode(F.array(c1, c2)).alias("c"))
        .distinct()
        .agg(F.count(F.lit(1)).alias("n_clusters"))
        .select(none.alias("n_examples"), none.alias("n_without_clusters"), "n_clusters")
    )
    return totals.unionByName(clusters).agg(*[F.max(c).alias(c) for c in totals.columns])
