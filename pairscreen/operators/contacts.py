"""Late-interaction scoring of candidate pairs.

A candidate pair is scored by the largest logit between any residue of one
side and any residue of the other.  Residue matrices are large, so they are
never joined to every pair: pairs and residues are dealt to (query block,
candidate block) tiles, and each matrix travels once per tile that needs it
instead of once per pair.  A candidate that a third of all queries share is
spread over all query blocks.
"""

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairscreen.functions import sigmoid
from pairscreen.operators.arrow_runs import ids, ragged, runs, table
from pairscreen.operators.dot_kernels import exact_dots, lengths_of, rounding_bound
from pairscreen.session import parallelism

# Residue bytes one side may hold in a task.
SIDE_BYTES = 128 << 20
MAX_PARTITIONS = 20_000
CELLS = 4_000_000
# Pairs, and values of their matrices, that a task sorts by length at once.
HELD_PAIRS = 8_192
HELD_VALUES = 16 << 20

_TILE = ["qb", "cb"]


class MultiHeadDot:
    """Default scorer: weighted, scaled dot products per head, plus a bias.
    The head weights fold into the query side, which leaves one product."""

    separable = True

    def __init__(self, weights=None, bias=-3.0, heads=8):
        self.weights = np.full(heads, 1.0 / heads) if weights is None else np.asarray(weights, float)
        self.bias = float(bias)

    def fold(self, r1):
        d = r1.shape[1] // len(self.weights)
        return r1.astype(np.float64) * np.repeat(self.weights / np.sqrt(d), d)

    def logits(self, r1, r2):
        return self.fold(r1) @ r2.astype(np.float64).T + self.bias

    def best(self, r1, others):
        """Largest logit against each of ``others``, the same to the last bit
        however the others are grouped."""
        q = self.fold(r1)
        k = np.concatenate(others).astype(np.float64)
        ends = np.cumsum([len(o) for o in others])
        starts = np.concatenate([[0], ends[:-1]])
        cells = q @ k.T
        per_column = cells.max(axis=0)
        top = np.maximum.reduceat(per_column, starts)
        slack = 2 * lengths_of(q).max() * lengths_of(k).max() * rounding_bound(q.shape[1], q.dtype)
        bar = np.repeat(top - slack, np.diff(np.append(starts, ends[-1])))
        # Few columns come near the top; only those are looked at again.
        near = np.flatnonzero(per_column >= bar)
        r, c = np.nonzero(cells[:, near] >= bar[near])
        c = near[c]
        exact = exact_dots(np.ascontiguousarray(q.T), r, np.ascontiguousarray(k.T), c)
        out = np.full(len(others), -np.inf)
        np.maximum.at(out, np.searchsorted(ends, c, side="right"), exact)
        return out + self.bias


class Dot(MultiHeadDot):
    """Plain inner product of residues."""

    def __init__(self):
        super().__init__(weights=[1.0], bias=0.0)

    def fold(self, r1):
        return r1.astype(np.float64)


class PaddedDot(MultiHeadDot):
    """The default scorer as a model that takes padded batches: ``batch`` gets two
    stacks of matrices, filled up with zeros, and where they are real."""

    separable = False

    def batch(self, r1, r2, real1, real2):
        return np.matmul(self.fold(r1.reshape(-1, r1.shape[2])).reshape(r1.shape), r2.astype(np.float64).transpose(0, 2, 1)) + self.bias


def _loaded(scorer):
    """The scorer of a task: ``load`` is called once, where there is one, and may return
    the scorer to use."""
    return (scorer.load() if hasattr(scorer, "load") else None) or scorer


def _stack(mats):
    """Matrices as one array of the longest one's length, and which rows are real."""
    longest = max(map(len, mats))
    out = np.zeros((len(mats), longest, mats[0].shape[1]), mats[0].dtype)
    for held, m in zip(out, mats):
        held[: len(m)] = m
    return out, np.arange(longest) < np.array([len(m) for m in mats])[:, None]


def length_batches(shapes, cells):
    """Cut pairs with these shapes into batches of like lengths, whose padded maps have
    at most ``cells`` cells together (a larger map alone): lists of pair numbers."""
    order = sorted(range(len(shapes)), key=lambda n: (max(shapes[n]), shapes[n], n))
    now, rows, columns = [], 0, 0
    for n in order:
        rows, columns = max(rows, shapes[n][0]), max(columns, shapes[n][1])
        if now and (len(now) + 1) * rows * columns > cells:
            yield now
            now, (rows, columns) = [], shapes[n]
        now.append(n)
    if now:
        yield now


def batched_best(scorer, pairs, cells):
    """Largest logit of each of ``pairs`` (two matrices); padding never wins."""
    out = np.empty(len(pairs))
    for some in length_batches([(len(a), len(b)) for a, b in pairs], cells):
        (r1, real1), (r2, real2) = (_stack([pairs[n][side] for n in some]) for side in (0, 1))
        logits = np.asarray(scorer.batch(r1, r2, real1, real2), dtype=np.float64)
        logits = np.where(real1[:, :, None] & real2[:, None, :], logits, -np.inf)
        out[some] = logits.max(axis=(1, 2))
    return out


def _held(pairs, most):
    """Pairs (query, candidate, two matrices) in lists whose matrices have about ``most``
    values together: what a task holds to sort by length."""
    held, seen, size = [], set(), 0
    for pair in pairs:
        held.append(pair)
        for m in pair[2:]:
            if id(m) not in seen:
                seen.add(id(m))
                size += m.size
        if size > most or len(held) >= HELD_PAIRS:
            yield held
            held, seen, size = [], set(), 0
    if held:
        yield held


def _best(scorer, r1, others):
    if getattr(scorer, "separable", False):
        return scorer.best(r1, others)
    return np.array([scorer.logits(r1, o).max() for o in others])


def residue_bytes(residues, residue_col):
    """Volume of all residue vectors.  With a ``length`` column the vectors
    themselves are not read, but for one row."""
    if "length" not in residues.columns:
        width = F.coalesce(F.size(F.get(residue_col, F.lit(0))), F.lit(0))
        cells = F.size(residue_col).cast("bigint") * width
        return residues.agg(F.coalesce(F.sum(cells), F.lit(0))).first()[0] * 4
    row = residues.where("length > 0").select(F.size(F.get(residue_col, F.lit(0)))).first()
    total = residues.agg(F.coalesce(F.sum(F.col("length").cast("bigint")), F.lit(0))).first()[0]
    return total * 4 * (row[0] if row else 0)


def tile_counts(q_bytes, c_bytes, slots, side_bytes):
    """How many blocks to cut queries and candidates into.  At least as many as
    keep a block below ``side_bytes`` and give every slot two tiles; within that,
    the larger side gets more blocks, because every query block may be sent to
    every candidate block and the other way round."""
    wanted = 2 * slots
    least_q, least_c = max(1, -(-q_bytes // side_bytes)), max(1, -(-c_bytes // side_bytes))
    balanced = round(math.sqrt(wanted * max(q_bytes, 1) / max(c_bytes, 1)))
    n_qb = max(least_q, min(wanted, max(1, balanced)))
    return n_qb, max(least_c, -(-wanted // n_qb))


def _tiles(pairs, q_res, c_res, q_id, c_id, residue_col, side_bytes):
    """Rows of every tile in one partition: query residues, then candidate
    residues, then the pairs, the pairs in order of query."""
    slots = parallelism(pairs.sparkSession)
    q_bytes = residue_bytes(q_res, residue_col)
    c_bytes = residue_bytes(c_res, residue_col)
    n_qb, n_cb = tile_counts(q_bytes, c_bytes, slots, side_bytes)
    parts = min(n_qb * n_cb, MAX_PARTITIONS)

    def block(col, n):
        return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")

    dealt = pairs.select(
        F.col(q_id).alias("q_id"),
        F.col(c_id).alias("c_id"),
        block(q_id, n_qb).alias("qb"),
        block(c_id, n_cb).alias("cb"),
    )
    flat = F.flatten(residue_col).cast("array<float>").alias("flat")
    width = F.coalesce(F.size(F.get(F.col(residue_col), F.lit(0))), F.lit(0)).alias("dim")
    own = q_res.select(F.col(q_id).alias("q_id"), flat, width)
    other = c_res.select(F.col(c_id).alias("c_id"), flat, width)
    # Each matrix goes only to the tiles that hold a pair of it.
    q_side = dealt.select("q_id", "qb", "cb").distinct().join(own, "q_id")
    c_side = dealt.select("c_id", "qb", "cb").distinct().join(other, "c_id")
    both = (
        q_side.withColumn("kind", F.lit(0))
        .unionByName(c_side.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(dealt.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    )
    tile = F.pmod(F.col("qb") * n_cb + F.col("cb"), F.lit(parts)).cast("int")
    return both.repartitionById(parts, tile).sortWithinPartitions(*_TILE, "kind", "q_id", "c_id")


def _tile_pairs(batches):
    """Yield (query id, query matrix, candidate ids, their matrices) per run of
    pairs with the same query."""
    tile, q_held, c_held = None, {}, {}
    for key, part in runs(batches, [*_TILE, "kind", "q_id"]):
        if key[:2] != tile:
            tile, q_held, c_held = key[:2], {}, {}
        if key[2] == 2:
            q, wanted = q_held.get(key[3]), ids(part, "c_id")
            if q is not None:
                known = [(c, c_held[c]) for c in wanted if c in c_held]
                if known:
                    yield key[3], q, [c for c, _ in known], [m for _, m in known]
            continue
        name, held = ("q_id", q_held) if key[2] == 0 else ("c_id", c_held)
        for i, m in zip(ids(part, name), ragged(part, "flat", ids(part, "dim"))):
            if len(m):
                held[i] = np.array(m)


def _chunks(q, c_ids, mats):
    """Cut one query's candidates so that a block of logits stays small."""
    start, cells = 0, 0
    for n, m in enumerate(mats):
        if n > start and (cells + len(m)) * len(q) > CELLS:
            yield c_ids[start:n], mats[start:n]
            start, cells = n, 0
        cells += len(m)
    yield c_ids[start:], mats[start:]


def _types(pairs, q_id, c_id):
    return [
        T.StructField("q_id", pairs.schema[q_id].dataType),
        T.StructField("c_id", pairs.schema[c_id].dataType),
    ]


def contact_scores(
    pairs,
    q_res,
    c_res,
    scorer=None,
    q_id="q_id",
    c_id="c_id",
    residue_col="residues",
    side_bytes=SIDE_BYTES,
    cells=CELLS,
):
    """``(q_id, c_id, max_logit, contact_score)`` of every distinct pair whose
    two proteins have residues.  ``q_res`` carries ``q_id`` and ``c_res``
    carries ``c_id``, each with an ARRAY<ARRAY<FLOAT>> column.  Orientation
    counts: (a, b) and (b, a) are different pairs.

    A scorer with ``batch`` is called with padded batches of pairs of like lengths, of
    at most ``cells`` cells; one without takes a pair at a time by ``logits``.  Its
    ``load`` is called once in each task.  Batches do not change the scores.
    """
    scorer = scorer or MultiHeadDot()
    out = T.StructType([*_types(pairs, q_id, c_id), T.StructField("max_logit", T.DoubleType())])
    schema = to_arrow_schema(out)

    def task(batches):
        model = _loaded(scorer)
        if hasattr(model, "batch"):
            flat = ((q, c, q_mat, m) for q, q_mat, c_ids, mats in _tile_pairs(batches) for c, m in zip(c_ids, mats))
            for held in _held(flat, HELD_VALUES):
                best = batched_best(model, [(a, b) for _, _, a, b in held], cells)
                yield table(schema, q_id=[p[0] for p in held], c_id=[p[1] for p in held], max_logit=best)
            return
        for q, q_mat, c_ids, mats in _tile_pairs(batches):
            for some, some_mats in _chunks(q_mat, c_ids, mats):
                best = _best(model, q_mat, some_mats)
                yield table(schema, q_id=[q] * len(some), c_id=some, max_logit=best)

    distinct = pairs.select(q_id, c_id).distinct()
    laid = _tiles(distinct, q_res, c_res, q_id, c_id, residue_col, side_bytes)
    return laid.mapInArrow(task, out).withColumn("contact_score", sigmoid("max_logit"))


def contact_map(
    pairs,
    q_res,
    c_res,
    scorer=None,
    q_id="q_id",
    c_id="c_id",
    residue_col="residues",
    side_bytes=SIDE_BYTES,
):
    """Every cell of every pair's map as ``(q_id, c_id, i, j, logit, prob)``,
    real positions only.  Rows of the map leave the task as arrays and are
    exploded in the JVM."""
    scorer = scorer or MultiHeadDot()
    out = T.StructType(
        [
            *_types(pairs, q_id, c_id),
            T.StructField("i", T.IntegerType()),
            T.StructField("row", T.ArrayType(T.DoubleType())),
        ]
    )
    schema = to_arrow_schema(out)

    def task(batches):
        model = _loaded(scorer)
        for q, q_mat, c_ids, mats in _tile_pairs(batches):
            for c, m in zip(c_ids, mats):
                cells = model.logits(q_mat, m)
                n = len(cells)
                yield table(
                    schema,
                    q_id=[q] * n,
                    c_id=[c] * n,
                    i=np.arange(n, dtype=np.int32),
                    row=list(cells),
                )

    distinct = pairs.select(q_id, c_id).distinct()
    laid = _tiles(distinct, q_res, c_res, q_id, c_id, residue_col, side_bytes)
    return (
        laid.mapInArrow(task, out)
        .select("q_id", "c_id", "i", F.posexplode("row").alias("j", "logit"))
        .withColumn("prob", sigmoid("logit"))
    )


def candidate_residues(pairs, lengths, q_id="q_id", c_id="c_id", length="length"):
    """Residue counts of both sides of each pair: the shape of its map, looked
    up without moving the residues themselves.  ``lengths``: ``(id, length)``."""
    one = lengths.select(F.col("id").alias(q_id), F.col(length).alias("len_q"))
    two = lengths.select(F.col("id").alias(c_id), F.col(length).alias("len_c"))
    return (
        pairs.join(one, q_id)
        .join(two, c_id)
        .withColumn("cells", F.col("len_q").cast("bigint") * F.col("len_c"))
    )
