"""Connected components of an edge table."""

from pyspark.sql import functions as F

from pairscreen.session import materialise


def _lowest(edges):
    """Each ``u`` with its least ``v``, beside every edge.  The minimum is taken
    before the shuffle; a hub's edges may be split when they meet it."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    return edges.join(low, "u")


def _large_star(edges):
    """Every larger neighbour of a node hangs on the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _lowest(both).where(F.col("v") > F.col("u"))
    return near.select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()


def _small_star(edges):
    """Every smaller neighbour of a node, and the node, hang on the least of them."""
    near = _lowest(edges)
    rest = near.where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return rest.union(near.select("u", F.col("low").alias("v"))).distinct()


def components(edges):
    """``(node, root)`` for every node of ``edges`` (two columns of longs): the
    root is the least node that can be reached.  Alternates large and small stars,
    which needs a logarithmic number of rounds; each round is a written table, so
    a lost executor costs one round at most.  Nothing but two numbers per round
    reaches the driver.  Self edges are ignored; nodes without edges have no row.
    """
    a, b = edges.columns
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = materialise(edges.where(F.col(a) != F.col(b)).select(u, v).distinct(), "edges")
    state = None
    while True:
        n, mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, mark) == state or n == 0:
            break
        state = (n, mark)
        now = materialise(_small_star(_large_star(now)), "stars")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(now.select("v", "v").distinct())
