"""Small integer helpers."""

from pyspark.sql import functions as F

KEY_MULTIPLIER = 1_000_000


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def pair_key(a, b):
    a, b = _c(a), _c(b)
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def composite_key(c1, c2, multiplier=KEY_MULTIPLIER, unique=True):
    """One BIGINT for a cluster pair; refuses clusters the multiplier cannot hold.
    ``unique=False`` takes them too: two pairs may then share a key, so it must not
    stand for the pair by itself."""
    c1, c2 = _c(c1).cast("bigint"), _c(c2).cast("bigint")
    key = c1 * F.lit(multiplier).cast("bigint") + c2
    if not unique:
        return key
    too_big = F.greatest(c1, c2) >= multiplier
    return F.when(
        too_big, F.raise_error(F.lit("cluster id reaches the key multiplier")).cast("bigint")
    ).otherwise(key)


def shift_index(i, s, n):
    return F.pmod(_c(i) + _c(s), _c(n))


def floor_median(x):
    return F.floor(F.median(_c(x)))
