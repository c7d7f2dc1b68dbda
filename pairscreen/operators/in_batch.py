"""Statistics of the similarity matrix inside batches of any size.

The matrix of a batch is cut into tiles of about ``TILE`` rows and columns, one to a
task; a batch of fewer rows is one tile.  ``tile`` sets a smaller size, for batches of up to
``SIDE`` tiles a side: beyond that they grow, up to ``TILE``, or each row would be copied to
a number of tiles that grows with the batch.  Only results per row and per column of a tile
leave it, and are merged: the best by their order, sums of exponentials by a running
maximum (log-sum-exp), so no matrix is ever put together.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairscreen.operators.arrow_runs import matrix, table
from pairscreen.operators.dot_kernels import exact_dots, lengths_of, rounding_bound
from pairscreen.operators.knowns import UNKNOWN

#: Rows and columns of a tile, on average.
TILE = 2048
#: A batch is cut into more blocks only if they would be larger than ``TILE``.
SIDE = 16
#: Cells of a product that are added up at a time: they stay in the cache.
CELLS = 32_768
#: Up to so many best cells of a row are picked one after another.
FEW_BEST = 8
FEW_PARTNERS = 32
MASKED = -1e4  # logit of a known pair off the diagonal


def known_in_batch(rows, known, batch="batch_id", c1="c1", c2="c2", block=None):
    """Known cluster pairs that can occur in each batch; codes only, no vectors.  With
    a ``block`` column, in each tile: also the blocks ``i`` of ``c1`` and ``j`` of ``c2``.

    A cluster with few partners lists them and asks which are in the batch.  A
    hub, with more partners than a batch has rows, is asked the other way
    round: which clusters of the batch are its partners.  Either way a row
    leads to at most ``FEW_PARTNERS`` or batch size many."""
    degrees = known.groupBy("c1").agg(F.count(F.lit(1)).alias("n_partners"))
    here, there = ([F.col(block).alias("i")], [F.col(block).alias("j")]) if block else ([], [])
    one = rows.where(F.col(c1) != UNKNOWN).select(batch, *here, F.col(c1).alias("c1")).distinct()
    two = rows.where(F.col(c2) != UNKNOWN).select(batch, *there, F.col(c2).alias("c2")).distinct()
    one = one.join(degrees, "c1")
    few = one.where(F.col("n_partners") <= FEW_PARTNERS).join(known, "c1")
    hubs = one.where(F.col("n_partners") > FEW_PARTNERS).join(two, batch)
    out = [batch, *(["i", "j"] if block else []), "c1", "c2"]
    few = few.join(two, [batch, "c2"]).select(*out)
    return few.unionByName(hubs.join(known, ["c1", "c2"], "left_semi").select(*out))


def _similarity(q, k):
    """All dots, each summed left to right: independent of the batch's shape."""
    out = np.zeros((len(q), len(k)))
    k_t = np.ascontiguousarray(k.T)
    step = max(1, CELLS // max(1, len(k)))
    term = np.empty((step, len(k)))
    for at in range(0, len(q), step):
        part, some = out[at : at + step], q[at : at + step]
        held = term[: len(some)]
        for d in range(q.shape[1]):
            part += np.multiply(some[:, d, None], k_t[d], out=held)
    return out


def _product(q, k):
    """All dots, and ``near(scores, n)``, which sets those that may be among the ``n`` best
    of their row to the sum left to right, so that order and ties do not depend on the
    batch's shape.  Cells of ``scores`` that are -inf are left out."""
    if len(q) * len(k) <= CELLS or not (np.isfinite(q).all() and np.isfinite(k).all()):
        return _similarity(q, k), lambda scores, n: scores
    slack = 2 * lengths_of(q) * lengths_of(k).max() * rounding_bound(q.shape[1], q.dtype)

    def near(scores, n):
        at = max(0, scores.shape[1] - n)
        top = scores.max(axis=1) if n == 1 else np.partition(scores, at, axis=1)[:, at]
        r, c = np.divmod(np.flatnonzero((scores >= (top - slack)[:, None]) & (scores > -np.inf)), scores.shape[1])
        scores[r, c] = exact_dots(np.ascontiguousarray(q.T), r, np.ascontiguousarray(k.T), c)
        return scores

    return q @ k.T, near


def _known_cells(c1, c2, pairs):
    mask = np.zeros((len(c1), len(c2)), dtype=bool)
    known = {}
    for a, b in pairs:
        known.setdefault(a, []).append(b)
    for a, partners in known.items():
        mask[np.ix_(c1 == a, np.isin(c2, partners))] = True
    return mask


def _blocked(rows, tile):
    """``rows`` with the ``block`` of each and the number of ``blocks`` of its batch."""
    n = F.count(F.lit(1))
    blocks = F.least(F.ceil(n / (tile or TILE)), F.greatest(F.ceil(n / max(tile or TILE, TILE)), F.lit(SIDE)))
    sizes = rows.groupBy(F.col("batch_id").alias("of")).agg(blocks.cast("int").alias("blocks"))
    sized = rows.join(sizes, rows["batch_id"].eqNullSafe(sizes["of"])).drop("of")
    return sized.withColumn("block", F.pmod(F.xxhash64("idx"), F.col("blocks")).cast("int"))


def _per_tile(df, known, fold, out_fields, batch, idx, q, k, c1, c2, tile):
    """Run ``fold(row idx, column idx, similarity, known mask, near) -> columns`` for each
    tile; both are in order of ``idx``, ``near`` is that of ``_product``."""
    codes = known is not None
    cols = [F.col(batch).alias("batch_id"), F.col(idx).cast("bigint").alias("idx")]
    cols += [F.col(q).alias("q"), F.col(k).alias("k")]
    cols += [F.col(c1).alias("c1"), F.col(c2).alias("c2")] if codes else [F.lit(0).alias("c1"), F.lit(0).alias("c2")]
    rows = _blocked(df.select(*cols), tile)
    out = T.StructType([rows.schema["batch_id"], *out_fields])
    schema = to_arrow_schema(out)
    across = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    here = F.col("block")
    left = rows.select("batch_id", here.alias("i"), across.alias("j"), F.lit(0).alias("side"), "idx", F.col("q").alias("v"), F.col("c1").alias("c"))
    right = rows.select("batch_id", across.alias("i"), here.alias("j"), F.lit(1).alias("side"), "idx", F.col("k").alias("v"), F.col("c2").alias("c"))
    sides = left.unionByName(right)

    def run(tab, pairs):
        tab = tab.sort_by([("side", "ascending"), ("idx", "ascending")]).combine_chunks()
        cut = int(np.count_nonzero(tab.column("side").to_numpy() == 0))
        if cut in (0, tab.num_rows):  # a block without rows
            return schema.empty_table()
        one, two = tab.slice(0, cut).combine_chunks(), tab.slice(cut).combine_chunks()
        a, b = (matrix(t.to_batches()[0], "v").astype(np.float64) for t in (one, two))
        sim, near = _product(a, b)
        mask = np.zeros(sim.shape, dtype=bool)
        if codes and pairs:
            mask = _known_cells(one.column("c").to_numpy(), two.column("c").to_numpy(), pairs)
        cells = fold(one.column("idx").to_numpy(), two.column("idx").to_numpy(), sim, mask, near)
        n = len(next(iter(cells.values())))
        value = tab.column("batch_id")[0].as_py()
        return pa.Table.from_batches([table(schema, batch_id=[value] * n, **cells)])

    tiles = sides.groupBy("batch_id", "i", "j")
    if not codes:
        return tiles.applyInArrow(lambda t: run(t, []), out)

    def with_known(left, right):
        if left.num_rows == 0:
            return schema.empty_table()
        return run(left, list(zip(right.column("c1").to_pylist(), right.column("c2").to_pylist())))

    inside = known_in_batch(rows, known, block="block")
    inside = inside.select(F.col("batch_id").alias("known_batch"), F.col("i").alias("known_i"), F.col("j").alias("known_j"), "c1", "c2")
    return tiles.cogroup(inside.groupBy("known_batch", "known_i", "known_j")).applyInArrow(with_known, out)


def _foremost(found, row, score, other, n):
    """The ``n`` best of each row over all tiles, the smaller column on ties."""
    order = Window.partitionBy("batch_id", row).orderBy(F.desc(score), other)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def _long(name):
    return T.StructField(name, T.LongType())


def _double(name):
    return T.StructField(name, T.DoubleType())


def _first_best(scores, n):
    """Columns of the ``n`` largest cells per row, the smaller column on ties."""
    if n <= FEW_BEST:
        left, at = scores.copy(), np.arange(len(scores))
        cols, best = np.empty((len(scores), n), np.int64), np.empty((len(scores), n))
        for i in range(n):
            cols[:, i] = left.argmax(axis=1)
            best[:, i] = left[at, cols[:, i]]
            left[at, cols[:, i]] = -np.inf
        if np.isfinite(best).all():
            return cols, best
    order = np.argsort(-scores, axis=1, kind="stable")[:, :n]
    return order, np.take_along_axis(scores, order, axis=1)


def in_batch_topk(df, top, batch="batch_id", idx="idx", q="q", k="k", tile=None):
    """The ``top`` most similar keys of each query inside its batch."""

    def fold(rows, columns, sim, _, near):
        n = min(top, sim.shape[1])
        cols, score = _first_best(near(sim, n), n)
        return {"idx": np.repeat(rows, cols.shape[1]), "match": columns[cols].ravel(), "sim": score.ravel()}

    fields = [_long("idx"), _long("match"), _double("sim")]
    found = _per_tile(df, None, fold, fields, batch, idx, q, k, None, None, tile)
    return _foremost(found, "idx", "sim", "match", top)


def in_batch_losses(
    df, scale, known=None, batch="batch_id", idx="idx", q="q", k="k", c1="c1", c2="c2", tile=None
):
    """Per row: cross-entropy of its row and of its column of the scaled
    similarities, and the arg-max of its row.  Known pairs off the diagonal
    are masked."""

    def fold(rows, columns, sim, mask, near):
        own = rows[:, None] == columns[None, :]
        known_pair = mask & ~own
        sim[known_pair] = -np.inf
        logits = scale * near(sim, 1)
        logits[known_pair] = MASKED

        def lse(axis):
            top = logits.max(axis=axis, keepdims=True)
            return np.log(np.exp(logits - top).sum(axis=axis)) + np.squeeze(top, axis)

        best = logits.argmax(axis=1)
        none = [None] * len(columns)
        on = own.any(axis=1)
        diagonal = np.where(on, np.where(own, logits, 0.0).sum(axis=1), 0.0)
        return {
            "idx": np.concatenate([rows, columns]),
            "row_lse": [*lse(1).tolist(), *none],
            "col_lse": [*[None] * len(rows), *lse(0).tolist()],
            "diagonal": [*(x if there else None for x, there in zip(diagonal.tolist(), on)), *none],
            "score": [*logits[np.arange(len(rows)), best].tolist(), *none],
            "top": [*columns[best].tolist(), *none],
        }

    names = ("row_lse", "col_lse", "diagonal", "score")
    fields = [_long("idx"), *map(_double, names), _long("top")]
    found = _per_tile(df, known, fold, fields, batch, idx, q, k, c1, c2, tile)
    whole = Window.partitionBy("batch_id", "idx")
    for side in ("row", "col"):
        found = found.withColumn(f"{side}_max", F.max(f"{side}_lse").over(whole))

    def merged(side):
        return F.max(f"{side}_max") + F.log(F.sum(F.exp(F.col(f"{side}_lse") - F.col(f"{side}_max"))))

    best = F.max(F.when(F.col("top").isNotNull(), F.struct("score", (-F.col("top")).alias("low"))))
    rows = found.groupBy("batch_id", "idx").agg(
        (merged("row") - F.max("diagonal")).alias("row_ce"),
        (merged("col") - F.max("diagonal")).alias("col_ce"),
        (-best["low"]).alias("top"),
    )
    return rows.select("batch_id", "idx", "row_ce", "col_ce", "top")


def info_nce(losses):
    """Symmetric loss of each batch, from ``in_batch_losses``."""
    return losses.groupBy("batch_id").agg(
        ((F.avg("row_ce") + F.avg("col_ce")) / 2).alias("loss"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def mean_batch_loss(per_batch):
    """Mean over batches, each batch counting the same whatever its size."""
    return per_batch.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def top1_accuracy(losses):
    hit = F.when(F.col("top") == F.col("idx"), F.lit(1.0)).otherwise(F.lit(0.0))
    return losses.groupBy("batch_id").agg(F.avg(hit).alias("top1_acc"))


def hard_negatives(
    df, ratio, known=None, batch="batch_id", idx="idx", q="q", k="k", c1="c1", c2="c2", tile=None
):
    """Per row the ``max(1, int(ratio))`` most similar other rows of its batch
    that are not known partners; fewer if fewer exist."""
    wanted = max(1, int(ratio)) if ratio > 0 else 0

    def fold(rows, columns, sim, mask, near):
        n = min(wanted, len(columns))
        scores = near(np.where(mask | (rows[:, None] == columns[None, :]), -np.inf, sim), n)
        cols, score = _first_best(scores, n)
        real = np.isfinite(score)
        return {"idx1": np.repeat(rows, n)[real.ravel()], "idx2": columns[cols][real], "sim": score[real]}

    fields = [_long("idx1"), _long("idx2"), _double("sim")]
    found = _per_tile(df, known, fold, fields, batch, idx, q, k, c1, c2, tile)
    return _foremost(found, "idx1", "sim", "idx2", wanted).select("batch_id", "idx1", "idx2")
