"""Pool residue vectors into one vector per protein."""

from pyspark.sql import functions as F


def vector_width(df, vec):
    row = df.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    return row[0] if row else 0


def _pool(df, by, vec, fold, dim):
    """One row per (protein, dimension), so the expression is as long for any width;
    values are combined before the shuffle and a protein's list holds ``dim`` cells."""
    dim = vector_width(df, vec) if dim is None else dim
    by = [by] if isinstance(by, str) else list(by)
    long = df.select(*by, F.posexplode_outer(F.slice(vec, 1, dim)).alias("__d", "__x"))
    cells = long.groupBy(*by, "__d").agg(fold(F.col("__x").cast("double")).alias("__x"))
    cell = F.struct("__d", F.coalesce("__x", F.lit(0.0)).alias("__x"))
    listed = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("__d").isNotNull(), cell))).alias("__v"))
    # Vectors that are all missing or shorter than ``dim`` are filled up with zeros.
    rest = F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("__v"))
    return listed.select(*by, F.concat(F.transform("__v", lambda c: c["__x"]), rest).alias("pooled"))


def mean_pool(df, by, vec="vec", dim=None):
    """Mean over real positions (long form, one row per position).  A
    protein whose positions are all missing pools to zeros."""
    return _pool(df, by, vec, F.avg, dim)


def max_pool(df, by, vec="vec", dim=None):
    """Maximum over real positions; all missing gives zeros."""
    return _pool(df, by, vec, F.max, dim)


def gather_residues(df, by, pos, vec, out="residues"):
    """Long form to one ARRAY<ARRAY<..>> per protein, in order of position."""
    by = [by] if isinstance(by, str) else list(by)
    listed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(vec).alias("v"))))
    return df.groupBy(*by).agg(F.transform(listed, lambda e: e["v"]).alias(out))


def spread_residues(df, residues="residues", pos="pos", vec="vec"):
    others = [c for c in df.columns if c != residues]
    return df.select(*others, F.posexplode(residues).alias(pos, vec))
