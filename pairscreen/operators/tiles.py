"""Bring blocks of two tables together without building their product.

Rows of the left side are cut into blocks that one task can hold, rows of the
right side into shards that are streamed.  A tile is one (space, block, shard);
its rows meet in one partition through a single shuffle.  Pieces are dealt by
hash of the row id, so no value can make one tile larger than the others, and
a space that holds most rows is simply cut into more pieces.
"""

import math

from pyspark.sql import functions as F

from pairscreen.session import parallelism

HELD_BYTES = 256 << 20  # what one task may hold of the left side
LEFT_BLOCK = (4_096, 131_072)  # fewest and most rows of a block
RIGHT_SHARD = 4_000_000
MIN_BLOCK = 128  # below this a smaller block buys no parallelism
MAX_PARTITIONS = 100_000
MAX_LOCAL_SPACES = 10_000
PAIRS_PER_TASK = 1 << 30
ROWS_PER_TILE = 512  # a tile for so many rows (of the geometric mean of both sides), up to the slots

TILE = ["space", "lb", "rb"]


def block_rows(row_bytes):
    """Rows per block: the larger, the fewer copies of the right side travel."""
    low, high = LEFT_BLOCK
    return max(low, min(high, HELD_BYTES // max(1, row_bytes)))


class TilePlan:
    """How many pieces each space is cut into: ``n_lb``, ``n_rb`` and ``base``,
    the number of its first tile.  One space gives literals, and ``rows`` of both sides.  Several give a
    frame, broadcast only when their number was checked to be small."""

    def __init__(self, partitions, single_shard, pieces=None, frame=None, rows=None):
        self.partitions = partitions
        self.single_shard = single_shard
        self.pieces = pieces
        self.frame = frame
        self.rows = rows

    def attach(self, side):
        if self.frame is not None:
            return side.join(self.frame, "space")
        n_lb, n_rb = self.pieces
        return side.select(
            "*",
            F.lit(n_lb).alias("n_lb"),
            F.lit(n_rb).alias("n_rb"),
            F.lit(0).cast("bigint").alias("base"),
        )


def plan(left, right, one_space, left_block, right_shard=None, costs=None):
    """``left`` and ``right`` carry ``space``.  One pruned count over both.
    ``left_block`` is a number of rows or a function that finds it, called only
    if some space is larger than the smallest block.  ``costs`` finds what moves for a
    left row in each shard and for a right row in each block; called only if there is
    something to cut."""
    spark = left.sparkSession
    slots = parallelism(spark)
    right_shard = right_shard or RIGHT_SHARD

    def block(n_left):
        if not callable(left_block):
            return left_block
        return left_block() if n_left > LEFT_BLOCK[0] else LEFT_BLOCK[0]

    both = left.select("space", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("space", F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("l", "n_left"), ("r", "n_right"))]
    if one_space:
        n_left, n_right = both.agg(*totals).first()
        cut, partitions = _cut([(0, n_left, n_right)], slots, block(n_left), right_shard, costs)
        _, n_lb, n_rb, _ = cut[0]
        return TilePlan(partitions, n_rb == 1, pieces=(n_lb, n_rb), rows=(n_left, n_right))
    sizes = both.groupBy("space").agg(*totals).where("space is not null and n_left > 0 and n_right > 0")
    rows = sizes.limit(MAX_LOCAL_SPACES + 1).collect()
    many = len(rows) > MAX_LOCAL_SPACES
    left_block = block(math.inf if many else max((r.n_left for r in rows), default=0))
    pieces = sizes.select(
        "space",
        F.ceil(F.col("n_left") / left_block).cast("int").alias("n_lb"),
        F.ceil(F.col("n_right") / right_shard).cast("int").alias("n_rb"),
        F.shiftright(F.xxhash64("space"), 2).alias("base"),
    )
    if many:
        return TilePlan(MAX_PARTITIONS, False, frame=pieces)
    cut, partitions = _cut([tuple(r) for r in rows], slots, left_block, right_shard, costs)
    small = spark.createDataFrame(cut, pieces.schema)
    return TilePlan(partitions, all(c[2] == 1 for c in cut), frame=F.broadcast(small))


def _cut(counts, slots, left_block, right_shard, costs=None):
    """(space, blocks, shards, first tile) per space and the partition count.
    Blocks and shards bound memory; larger inputs get more of them, to fill the slots.  Every block costs a copy of the right side and every shard one of the
    left side and of its results, so both sides are cut, where that moves least: the
    copies grow with the root of the slots, not with the rows."""
    pairs = sum(n_left * n_right for _, n_left, n_right in counts) or 1
    cut, base = [], 0
    for space, n_left, n_right in counts:
        own = n_left * n_right
        share = max(1, min(round(slots * own / pairs), math.ceil(math.sqrt(own) / ROWS_PER_TILE)))
        n_lb, n_rb = max(1, -(-n_left // left_block)), max(1, -(-n_right // right_shard))
        if share > n_lb * n_rb:
            costs = (costs() if callable(costs) else costs) or (1, 1)
            even = round(math.sqrt(share * n_right * costs[1] / (n_left * costs[0])))
            n_rb = max(n_rb, min(even, share, n_right // MIN_BLOCK), 1)
            n_lb = max(n_lb, min(-(-share // n_rb), n_left // MIN_BLOCK))
        cut.append((space, n_lb, n_rb, base))
        base += n_lb * n_rb
    return cut, min(max(base, 1), max(slots, min(MAX_PARTITIONS, pairs // PAIRS_PER_TASK)))


def place(side, tile_plan, row_id, is_left):
    """One copy of each row per opposite piece, with its tile columns."""
    own, other = ("lb", "rb") if is_left else ("rb", "lb")
    placed = (
        tile_plan.attach(side)
        .withColumn(own, F.pmod(F.xxhash64(row_id), F.col(f"n_{own}")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
    )
    number = F.col("base") + F.col("lb") * F.col("n_rb") + F.col("rb")
    return placed.withColumn("tile", number).drop("base", "n_lb", "n_rb")


def meet(sides, tile_plan, within):
    """Shuffle the sides of every tile together, sorted by tile then ``within``."""
    both = sides[0]
    for side in sides[1:]:
        both = both.unionByName(side, allowMissingColumns=True)
    part = F.pmod(F.col("tile"), F.lit(tile_plan.partitions)).cast("int")
    return (
        both.repartitionById(tile_plan.partitions, part)
        .drop("tile")
        .sortWithinPartitions(*TILE, *within)
    )
