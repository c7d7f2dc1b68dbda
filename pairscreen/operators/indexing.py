"""Positions, offsets, batches and slices over a global or per-group order.

A window over one big group would put that group into one task.  Here the rows are
sorted once by a range shuffle and written; a row's number in its partition plus the
rows of the partitions before it is its position.  Any cut of the range gives the same
answer, so Spark's own sampling only decides the balance.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairscreen.functions import hash_uniform, shift_index
from pairscreen.session import materialise

_SLICE = "__slice"
_PLACE = "__place"
_SHIFT = "__shift"


def _ranged(df, order, slices):
    """``df`` in ``slices`` ranges of ``order``, written as it lies: each row with its
    slice and its place in it.  Read again, both stay what they are."""
    if slices is None:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    place = number.bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(ranged.select("*", F.shiftright(number, 33).alias(_SLICE), place.alias(_PLACE)), "ranges")


def _before(rows, measure):
    """What ``measure`` adds up to in the slices before each: as many rows as slices."""
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(_SLICE).agg(measure.alias("__n"))
    return F.broadcast(totals.select(_SLICE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(_SHIFT)))


def _from_group_start(rows, value, by, out):
    """``value`` less its least in each group; a group lies in one stretch of the order."""
    if by:
        first = rows.groupBy(*by).agg(F.min(value).alias("__first"))
        rows = rows.join(first, by)
        rows = rows.withColumn(out, (F.col(value) - F.col("__first")).cast("bigint"))
    else:
        rows = rows.withColumn(out, F.col(value).cast("bigint"))
    return rows.drop(value, "__first", _SLICE, _PLACE, _SHIFT)


def with_position(df, order, by=(), out="pos", slices=None):
    """0-based position of each row in ``order`` inside its ``by`` group.
    ``order`` should end in a unique column; ``by`` columns must not be null."""
    by = list(by)
    columns = df.columns
    rows = _ranged(df, [*by, *order], slices)
    rows = rows.join(_before(rows, F.count(F.lit(1))), _SLICE).withColumn("__at", F.col(_PLACE) + F.col(_SHIFT))
    return _from_group_start(rows, "__at", by, out).select(*columns, out)


def with_offsets(df, order, length, by=(), out="offset", slices=None):
    """Start offset of each ragged row: the lengths before it, summed; none is negative
    (null counts as 0)."""
    by = list(by)
    columns = df.columns
    rows = _ranged(df, [*by, *order], slices)
    inside = Window.partitionBy(_SLICE).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(length).over(inside), F.lit(0))
    rows = rows.withColumn("__run", run).join(_before(rows, F.sum(length)), _SLICE)
    rows = rows.withColumn("__at", F.col("__run") + F.col(_SHIFT)).drop("__run")
    return _from_group_start(rows, "__at", by, out).select(*columns, out)


def with_batch_id(df, size, order, by=(), out="batch_id", slices=None):
    """Consecutive batches of ``size`` rows; the last one may be shorter."""
    placed = with_position(df, order, by, "__pos", slices)
    return placed.withColumn(out, F.floor(F.col("__pos") / size).cast("bigint")).drop("__pos")


def seeded_shuffle(df, id_col, seed):
    """A reproducible random order: sorted by a hash of seed and id."""
    return df.orderBy(hash_uniform(seed, id_col), id_col)


def take_examples(df, n, id_col, seed):
    """The first ``n`` rows of the seeded order; zero or less means all.  Large
    ``n`` stays distributed, which a sort with a limit would not."""
    if n <= 0:
        return df
    keyed = df.withColumn("__u", hash_uniform(seed, id_col))
    placed = with_position(keyed, ["__u", id_col], out="__pos")
    return placed.where(F.col("__pos") < n).drop("__u", "__pos")


def cyclic_partner(df, shifts, total, pos="pos", out="partner"):
    """One row per shift with the position ``(pos + shift) mod total``."""
    return df.withColumn("shift", F.explode(F.array(*[F.lit(int(s)) for s in shifts]))).withColumn(
        out, shift_index(pos, "shift", F.lit(total).cast("bigint"))
    )


def bucket_by_length(df, *lengths, width=None):
    """Group like lengths into the same partitions, sorted, so that batches
    handed to a scorer hold rows of similar size.  Results do not depend on it."""
    if width is None:
        return df.sortWithinPartitions(*lengths)
    buckets = [F.floor(F.col(c) / width).alias(f"bucket_{c}") for c in lengths]
    return df.select("*", *buckets)
