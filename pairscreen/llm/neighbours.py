"""Approximate nearest neighbours by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a Hadamard transform; its
bucket is the signed axis that it comes nearest to.  Several tables with their own
signs are kept; a query looks into the buckets of its nearest axes in each, and
what it meets there is ranked by the exact cosine.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairscreen.session import materialise

#: Rows of one bucket that a tile holds, on either side.
TILE = 4_096


def hadamard(x):
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n = x.shape[1]
    step = 1
    while step < n:
        x = x.reshape(-1, n // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        step *= 2
    return x / np.sqrt(n)


def rotate(x, seed):
    """Pseudo-rotation of each row, filled up with zeros to a power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def unit(x):
    """Rows over their largest component, then over their length, so that no
    square is too large or too small to hold."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(x, tables, probes, seed):
    """Signed axes by nearness, (rows, tables, probes): ``a`` for +axis a and
    ``width + a`` for -axis a."""
    out = []
    for t in range(tables):
        y = rotate(x, [seed, t])
        both = np.concatenate([y, -y], axis=1)
        out.append(np.argsort(-both, axis=1, kind="stable")[:, : min(probes, both.shape[1])])
    return np.stack(out, axis=1)


def _matrices(column, dim):
    """Rows of a list column by their length: (row numbers, matrix)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(dim)])
    for d in np.unique(dim):
        rows = np.flatnonzero(dim == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def _hashed(tables, probes, seed, side):
    """Task from (rep, low, vec) to one row per table and probe."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                dim = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
                for rows, x in _matrices(batch.column("vec"), dim):
                    found = axes(unit(x), tables, probes, seed)
                    n, t, p = found.shape
                    take = np.repeat(np.arange(n), t * p)
                    bucket = found + (np.arange(t) * 2**20)[None, :, None]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n * t * p, side, np.int8)),
                            pa.array(np.full(n * t * p, x.shape[1], np.int32)),
                            pa.array(bucket.reshape(-1)),
                            *(batch.column(c).take(pa.array(rows[take])) for c in ("rep", "low", "vec")),
                        ],
                        names=["side", "dim", "bucket", "rep", "low", "vec"],
                    )

    return run


_POINTS = "side tinyint, dim int, bucket long, rep long, low long, vec array<double>"


def cosines(a, b):
    """Cosine of each row of ``a`` with the same row of ``b``, summed the same way
    wherever it is taken."""
    scale_a, scale_b = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    safe = (scale_a < 1e100) & (scale_a > 1e-100) & (scale_b < 1e100) & (scale_b > 1e-100)
    a, b = np.where(safe, a, a / scale_a), np.where(safe, b, b / scale_b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _nearest(k):
    """Task over tiles, queries (side 0) before points: the k nearest points of the
    tile for each query by exact cosine, ties to the smaller ``low``."""

    def merge(queries, best, low, rep, x):
        """Products are only a filter, with room for their rounding; what passes it
        is compared exactly with what was found before."""
        ids, q = queries
        close = unit(q) @ unit(x).T
        for i in range(len(ids)):
            old_low, old_rep, old = best[i]
            score = np.concatenate([old, close[i]])
            use = np.arange(len(x))
            if len(score) > k:
                floor = np.partition(score, len(score) - k)[len(score) - k]
                use = np.flatnonzero(close[i] >= floor - 1e-9)
            exact = cosines(np.repeat(q[i : i + 1], len(use), axis=0), x[use])
            lows, reps = np.concatenate([old_low, low[use]]), np.concatenate([old_rep, rep[use]])
            score = np.concatenate([old, exact])
            first = np.lexsort((lows, -score))[:k]
            best[i] = (lows[first], reps[first], score[first])

    def emit(out):
        q, c, s = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], names=["query", "rep", "score"])

    def run(batches):
        key, queries, best, out = None, None, [], []

        def close_tile():
            for i, (_, rep, score) in enumerate(best):
                out.append((np.full(len(rep), queries[0][i]), rep, score))

        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                batch = whole.slice(at, TILE)
                tile, low, rep = (
                    np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)
                    for names in (("dim", "bucket", "part", "side"), ("low",), ("rep",))
                )
                low, rep = low[:, 0], rep[:, 0]
                cuts = np.concatenate([[0], np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1, [len(tile)]])
                for s, e in zip(cuts[:-1], cuts[1:]):
                    if tuple(tile[s, :3]) != key:
                        close_tile()
                        key, queries, best = tuple(tile[s, :3]), None, []
                    if tile[s, 3] == 1 and queries is None:
                        continue  # nobody asks in this tile
                    x = batch.column("vec").slice(s, e - s).flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
                    if tile[s, 3] == 1:
                        merge(queries, best, low[s:e], rep[s:e], x)
                        continue
                    old = queries or (rep[:0], x[:0])
                    queries = (np.concatenate([old[0], rep[s:e]]), np.concatenate([old[1], x]))
                    best += [(low[:0], rep[:0], np.zeros(0))] * (e - s)
            if out:
                yield emit(out)
                out.clear()
        close_tile()
        if out:
            yield emit(out)

    return run


def _tiles(points, queries, k):
    """Meet queries and points of equal (dim, bucket): hot buckets are cut into
    parts on both sides, each part of the queries with each of the points.  The
    number of parts follows the bucket's own counts; there are as many buckets as
    tables and axes, whatever the number of rows."""

    def parts(rows, name):
        return rows.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(name))

    sizes = parts(points, "np").join(parts(queries, "nq"), ["dim", "bucket"])
    mine = F.pmod(F.xxhash64("rep"), F.col("np")), F.pmod(F.xxhash64("rep"), F.col("nq"))

    def dealt(rows, own, other):
        return rows.join(F.broadcast(sizes), ["dim", "bucket"]).select(
            "side", "dim", "bucket", "rep", "low", "vec", own.alias("own"),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"), "nq",
        )

    points = dealt(points, mine[0], "nq").withColumn("part", F.col("own") * F.col("nq") + F.col("other"))
    queries = dealt(queries, mine[1], "np").withColumn("part", F.col("other") * F.col("nq") + F.col("own"))
    both = points.union(queries).drop("own", "other", "nq")
    tiles = both.repartition("dim", "bucket", "part").sortWithinPartitions("dim", "bucket", "part", "side")
    return tiles.mapInArrow(_nearest(k), "query long, rep long, score double")


def _valid(vectors, id_col, vec_col):
    vec = vectors[vec_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vec.alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0)
    ).distinct()


def nearest(vectors, is_query, k=5, id_col="vec_id", vec_col="embedding", tables=6, probes=24, seed=1):
    """The ``k`` nearest other vectors by cosine of every row for which
    ``is_query`` (a condition on the column ``id``) holds: ``query_id``, ``rank``
    from 1, ``id_col``, ``score``; ties go to the smaller id.

    Equal vectors are one point with its ``k + 1`` smallest ids, which is all that a
    result can show of them, so a vector with a third of all rows is hashed and
    compared once.  Distinct vectors are hashed into ``tables`` tables; a query
    probes ``probes`` axes of each.  A query that meets fewer than ``k`` others
    there is compared with all points, in blocks, so that every query has ``k``
    rows if there are so many.  Scores come from the original vectors in double
    precision.

    Vectors that are null, empty, all zero, or have a null or non-finite component
    take no part, nor do rows without id.  Vectors of different lengths never meet.
    A row that is repeated counts once; an id with several vectors is several
    points, none of which is a neighbour of its own id.  Other columns are ignored.
    """
    rows = materialise(_valid(vectors, id_col, vec_col), "vectors")
    order = Window.partitionBy("vec").orderBy("id")
    some = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    points = materialise(
        some.groupBy("vec").agg(F.min("id").alias("low"), F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("rep", F.xxhash64("low", "vec")),
        "points",
    )
    asked = rows.where(is_query)
    owners = asked.join(points.select("vec", "rep"), "vec").select(F.col("id").alias("query_id"), F.col("rep").alias("query"))
    owners = materialise(owners, "queries")
    probing = points.join(owners.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi")

    # Some may be of the query's own id: as many as it has vectors.
    own = asked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    take = k + (own or 1)
    index = points.select("rep", "low", "vec").mapInArrow(_hashed(tables, 1, seed, 1), _POINTS)
    probes_of = probing.select("rep", "low", "vec").mapInArrow(_hashed(tables, probes, seed, 0), _POINTS)
    near = _tiles(index, probes_of, take).dropDuplicates(["query", "rep"])
    found = materialise(_ranked(near, points, owners, take, k), "near")

    # Too few: all points, dealt into blocks.
    few = owners.join(
        found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k), "query_id", "left_anti"
    )
    if few.isEmpty():
        return _named(found, id_col)
    block = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(max(1, points.count() // TILE)))
    all_points = points.select(
        F.lit(1).cast("tinyint").alias("side"), F.size("vec").alias("dim"), block.cast("long").alias("bucket"), "rep", "low", "vec"
    )
    blocks = all_points.select("dim", "bucket").distinct()
    asking = points.join(few.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi")
    asking = asking.select(F.lit(0).cast("tinyint").alias("side"), F.size("vec").alias("dim"), "rep", "low", "vec")
    asking = asking.join(blocks, "dim").select("side", "dim", "bucket", "rep", "low", "vec")
    rest = _ranked(_tiles(all_points, asking, take), points, few, take, k)
    return _named(found.join(few.select("query_id").distinct(), "query_id", "left_anti").union(rest), id_col)


def _ranked(near, points, owners, take, k):
    """The k nearest rows of each query from the nearest points of its vector."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ids = near.join(points.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("id"))
    top = ids.withColumn("n", F.row_number().over(best)).where(F.col("n") <= take)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("top"))
    each = owners.join(lists, "query").select(
        "query_id", F.slice(F.filter("top", lambda x: x["id"] != F.col("query_id")), 1, k).alias("top")
    )
    return each.select("query_id", F.posexplode("top").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("id"), (-F.col("hit.minus")).alias("score")
    )


def _named(found, id_col):
    return found.withColumnRenamed("id", id_col)
