"""Resumable many-by-many sweeps: what is there, what is done, what is left."""

from pyspark.sql import functions as F

from pairscreen.functions import clean_name, percent_done
from pairscreen.operators.indexing import with_position


def pair_inventory(hosts, virals, host="host_proteome", viral="viral_proteome"):
    """The grid of every host with every viral proteome, by index: both lists
    are numbered, each host lists the viral numbers, and an equi-join turns the
    numbers into names.  The result is the product by definition; nothing
    larger than it is built."""
    numbered = with_position(virals.select(viral).distinct(), [viral], out="viral_idx")
    n = numbered.count()
    cells = (
        with_position(hosts.select(host).distinct(), [host], out="host_idx")
        .where(F.lit(n) > 0)
        .withColumn("viral_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    )
    return cells.join(numbered, "viral_idx").select(host, viral, "host_idx", "viral_idx")


def pending_pairs(inventory, done, keys=("host_proteome", "viral_proteome")):
    """Inventory less what is finished.  Finished pairs repeat, so they are
    made distinct before the join."""
    keys = list(keys)
    return inventory.join(done.select(*keys).distinct(), keys, "left_anti")


def restrict(inventory, worklist, name="host_proteome"):
    """Only the hosts that a work list names."""
    return inventory.join(worklist.select(name).distinct(), name, "left_semi")


def worklist_report(lines, inventory, raw="line", name="host_proteome"):
    """Cleaned, non-blank work-list names with whether a file stands behind them."""
    names = (
        lines.select(clean_name(raw).alias(name)).where(F.col(name) != "").distinct()
    )
    known = inventory.select(name).distinct().withColumn("__there", F.lit(True))
    return names.join(known, name, "left").select(
        name, F.coalesce("__there", F.lit(False)).alias("found")
    )


def slice_inventory(inventory, start=0, step=1, offset=0, name="host_proteome", reverse=False):
    """Every ``step``-th name from position ``start`` of the sorted names on;
    reversed, the walk runs from the end of the list."""
    names = with_position(inventory.select(name).distinct(), [name], out="idx")
    if reverse:
        names = names.withColumn("idx", F.lit(names.count() - 1) - F.col("idx"))
    return names.where(
        (F.col("idx") >= start) & (F.pmod(F.col("idx") - start, F.lit(step)) == offset)
    )


def candidate_counts(df, by):
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_candidates"))


def sweep_progress(inventory, done, keys=("host_proteome", "viral_proteome")):
    """One row: finished pairs, all pairs, whole per cent.  A finished pair
    counts once however many machines delivered it."""
    keys = list(keys)
    finished = done.select(*keys).distinct().withColumn("__done", F.lit(1))
    return (
        inventory.select(*keys)
        .join(finished, keys, "left")
        .agg(F.count("__done").alias("n_done"), F.count(F.lit(1)).alias("n_total"))
        .withColumn("percent", percent_done("n_done", "n_total"))
    )


def residue_footprint(df, by, length="length", dim=1024, bytes_per_value=2):
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_proteins"),
        (F.sum(F.col(length).cast("bigint")) * dim * bytes_per_value).alias("n_bytes"),
    )


def merge_results(*frames, keys, order):
    """One row per key out of several machines' results: the first in
    ``order``.  Aggregated before the shuffle, so a pair that every machine
    delivered many times is no hot task."""
    keys, order = list(keys), list(order)
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    rest = [c for c in every.columns if c not in keys and c not in order]
    first = F.struct(*order, *rest)
    return (
        every.groupBy(*keys)
        .agg(F.min(first).alias("__first"))
        .select(*keys, *[F.col(f"__first.{c}").alias(c) for c in [*order, *rest]])
        .select(*every.columns)
    )
