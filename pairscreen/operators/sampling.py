"""Cluster-weighted sampling with replacement, reproducible and distributed."""

from pyspark.sql import functions as F

from pairscreen.functions import hash_uniform
from pairscreen.operators.indexing import with_position
from pairscreen.operators.knowns import UNKNOWN, cluster_members, normalise_clusters


def _pick(u, n):
    return F.least(F.floor(u * n), F.col(n) - 1 if isinstance(n, str) else F.lit(n - 1)).cast("bigint")


def cluster_sample(
    df, example, n=None, p=0.5, seed=42, epoch=0, c1="seq1_cluster", c2="seq2_cluster"
):
    """``n`` draws (default: as many as rows) as ``(draw, cluster, example...)``.

    With probability ``p`` a draw takes one of the examples without clusters,
    otherwise a cluster uniformly and then one of its examples uniformly; when
    one kind is missing the other serves every draw.  Three uniforms per draw
    are hashed from seed, epoch and draw number.  Clusters and slots are
    numbered densely, so every draw is one equi-join on unique keys, however
    large a cluster is.
    """
    example = [example] if isinstance(example, str) else list(example)
    rows = normalise_clusters(df.select(*example, c1, c2), (c1, c2))
    loose = (F.col(c1) == UNKNOWN) | (F.col(c2) == UNKNOWN)
    singles = with_position(rows.where(loose).select(*example), example, out="slot")
    belonging = cluster_members(rows, example, c1, c2)
    members = with_position(belonging, example, by=["cluster"], out="slot")
    sizes = belonging.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_members"))
    clusters = with_position(sizes, ["cluster"], out="cluster_idx")

    counts = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(loose, F.lit(1))).alias("loose")
    ).first()
    n = counts["rows"] if n is None else n
    n_loose = counts["loose"]
    n_clusters = sizes.count() if n_loose < counts["rows"] else 0
    u = [hash_uniform(seed, "draw", F.lit(tag), epoch=epoch) for tag in ("side", "cluster", "slot")]
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    draws = draws.select("draw", *[x.alias(f"u{i}") for i, x in enumerate(u)])
    if n_loose and n_clusters:
        from_loose, from_cluster = draws.where(F.col("u0") < p), draws.where(F.col("u0") >= p)
    else:
        from_loose = draws if n_loose else draws.where(F.lit(False))
        from_cluster = draws if n_clusters else draws.where(F.lit(False))

    picked = (
        from_loose.withColumn("slot", _pick(F.col("u2"), max(n_loose, 1)))
        .join(singles, "slot")
        .select("draw", F.lit(UNKNOWN).cast("bigint").alias("cluster"), *example)
    )
    via = (
        from_cluster.withColumn("cluster_idx", _pick(F.col("u1"), max(n_clusters, 1)))
        .join(clusters, "cluster_idx")
        .withColumn("slot", F.least(F.floor(F.col("u2") * F.col("n_members")), F.col("n_members") - 1))
        .join(members, ["cluster", "slot"])
        .select("draw", "cluster", *example)
    )
    return picked.unionByName(via)
