"""Retrieval metrics over whole tables, without storing any ranking.

The rank of a query's first valid match is one more than the number of keys
before its best valid key.  So: find the best valid key, then count.
"""

from pyspark.sql import functions as F

from pairscreen.functions import inner_product
from pairscreen.operators.indexing import with_offsets
from pairscreen.operators.knowns import UNKNOWN
from pairscreen.operators.partners import best_partner
from pairscreen.operators.retrieval import rank_against
from pairscreen.session import materialise

KS = (1, 5, 10)


def best_valid(queries, keys, known=None, own=True, **blocks):
    """Best valid key of each query as ``(q_id, bar, bar_id)``.  Valid are keys
    with the query's own id (``own``) and keys whose cluster is a known partner
    of the query's.  Frames: ``q_id``/``c_id``, ``vec`` and ``cluster``; ``known``: distinct."""
    parts = []
    if own:
        pairs = queries.select("q_id", F.col("vec").alias("qv")).join(
            keys.select(F.col("c_id").alias("q_id"), F.col("vec").alias("kv")), "q_id"
        )
        parts.append(
            pairs.select("q_id", F.col("q_id").alias("bar_id"), inner_product("qv", "kv").alias("bar"))
        )
    if known is not None:
        has = F.col("cluster").cast("string") != str(UNKNOWN)
        found = best_partner(queries.where(has), keys.where(has), known, **blocks)
        parts.append(found.select("q_id", F.col("c_id").alias("bar_id"), F.col("ip").alias("bar")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    first = F.min(F.struct((-F.col("bar")).alias("neg"), F.col("bar_id"))).alias("b")
    return every.groupBy("q_id").agg(first).select("q_id", (-F.col("b.neg")).alias("bar"), "b.bar_id")


def first_valid_rank(queries, keys, known=None, own=True, space=None, **blocks):
    """``(q_id, rank)`` of the first valid match in the full ranking; one more
    than the number of keys where there is none.  With a ``space`` column on
    both sides, a query is ranked against the keys of its space only."""
    # Read by the count and by the ranking; a few numbers per query.
    bars = materialise(best_valid(queries, keys, known, own, **blocks), "bars")
    kept = [c for c in ("vec", space) if c]
    ranks = rank_against(
        queries.select("q_id", *kept).join(bars, "q_id"),
        keys.select("c_id", *kept),
        q_space=space,
        k_space=space,
        **blocks,
    )
    if own:
        return ranks
    by = [space] if space else []
    sizes = keys.groupBy(*by).agg((F.count(F.lit(1)) + 1).alias("worst"))
    asked = queries.select("q_id", *by)
    asked = asked.join(sizes, by) if by else asked.withColumn("worst", F.lit(sizes.first()[0]))
    return asked.join(ranks, "q_id", "left").select("q_id", F.coalesce("rank", "worst").alias("rank"))


def exact_floor_median(df, col, by=()):
    """``floor(median)`` by counting, as ``(by..., value)``: rows are summed per
    value first, so nothing grows with the table on one task."""
    by = list(by)
    counts = df.groupBy(*by, F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "counts")
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    placed = with_offsets(counts, ["v"], "n", by, out="before")
    placed = placed.join(totals, by) if by else placed.withColumn("total", F.lit(totals.first()[0]))

    def holds(at):
        return (F.col("before") <= at) & (F.col("before") + F.col("n") > at)

    middle = holds(F.floor((F.col("total") - 1) / 2)) | holds(F.floor(F.col("total") / 2))
    value = F.floor((F.min("v") + F.max("v")) / 2).cast("double").alias("value")
    return placed.where(middle).groupBy(*by).agg(value)


def rank_metrics(ranks, prefix):
    """Mean and floored median rank and recall at k, as ``(metric, value)``.
    ``prefix``: a name, or a column that names the group of each row."""
    group = F.lit(prefix) if isinstance(prefix, str) else prefix
    # Read four times, costly to count again.
    ranks = materialise(ranks.select(group.alias("name"), "rank"), "ranks")
    hits = [F.avg((F.col("rank") <= k).cast("double")).alias(f"R@{k}") for k in KS]
    flat = ranks.groupBy("name").agg(F.avg("rank").alias("mean_rank"), *hits)
    cells = [
        F.struct(F.concat("name", F.lit(f"_{n}")).alias("metric"), F.col(n).alias("value"))
        for n in ("mean_rank", *[f"R@{k}" for k in KS])
    ]
    median = exact_floor_median(ranks, "rank", ["name"]).select(
        F.concat("name", F.lit("_median_rank")).alias("metric"), "value"
    )
    return flat.select(F.inline(F.array(*cells))).unionByName(median)


def retrieval_metrics(pairs, known=None, idx="idx", q="q", k="k", c1="c1", c2="c2", **blocks):
    """Both directions over a table of pairs: ``idx`` (a whole number), the two
    vectors and, with ``known``, the two clusters.  The directions are two
    spaces of one search, with ids, clusters and known pairs told apart."""
    ways = ((0, "f", q, k, c1, c2), (1, "b", k, q, c2, c1))

    def code(way, c):
        if known is None:
            return F.lit(None).cast("string")
        return F.when(F.col(c) != UNKNOWN, F.concat(F.lit(f"{way}:"), F.col(c).cast("string")))

    def side(id_name, vec_at, cluster_at):
        rows = [
            F.struct(
                (F.col(idx).cast("bigint") * 2 + w[0]).alias(id_name),
                F.lit(w[1]).alias("way"),
                F.col(w[vec_at]).alias("vec"),
                code(w[1], w[cluster_at]).alias("cluster"),
            )
            for w in ways
        ]
        return pairs.select(F.inline(F.array(*rows)))

    both = None
    if known is not None:
        rows = [
            F.struct(code("f", "c1").alias("c1"), code("f", "c2").alias("c2")),
            F.struct(code("b", "c2").alias("c1"), code("b", "c1").alias("c2")),
        ]
        both = known.select(F.inline(F.array(*rows)))
    ranks = first_valid_rank(
        side("q_id", 2, 4), side("c_id", 3, 5), both, space="way", **blocks
    )
    name = F.when(F.col("q_id") % 2 == 0, "seq1_to_seq2").otherwise("seq2_to_seq1")
    return rank_metrics(ranks, name)


def metrics_long(metrics, step, prefix="eval"):
    """Prefixed metric rows of one step, ready for the sink."""
    return metrics.select(
        F.lit(step).cast("bigint").alias("step"),
        F.concat(F.lit(f"{prefix}/"), "metric").alias("metric"),
        F.col("value").cast("double").alias("value"),
    )
