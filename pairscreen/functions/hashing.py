"""Reproducible uniforms: a function of the row, never of its placement."""

from pyspark.sql import functions as F

# 13 hex digits = 52 bits, exact in a DOUBLE and enough for any slot number.
HEX_DIGITS = 13


def hash_uniform(seed, *cols, epoch=0):
    """Uniform in [0, 1) from ``md5("<seed + epoch>:<col>:...")``."""
    parts = [F.lit(str(seed + epoch))]
    parts += [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    digest = F.substring(F.md5(F.concat_ws(":", *parts)), 1, HEX_DIGITS)
    return F.conv(digest, 16, 10).cast("bigint").cast("double") / F.lit(float(16**HEX_DIGITS))
