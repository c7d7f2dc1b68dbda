"""Per-cell loss expressions, in their overflow-free forms."""

from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def bce_logits(x, y):
    x, y = _c(x), _c(y)
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def focal_cell(x, y, gamma=2.0, alpha=0.25):
    """Binary cross-entropy of the cell scaled down where it is already well
    predicted; positives weigh ``alpha``, the rest ``1 - alpha``."""
    y = _c(y)
    bce = bce_logits(x, y)
    weight = F.when(y > 0, F.lit(float(alpha))).otherwise(F.lit(1.0 - alpha))
    return weight * F.pow(F.lit(1.0) - F.exp(-bce), F.lit(float(gamma))) * bce


def cross_entropy(x, row_max, sum_exp):
    """``log(sum(exp(.))) - x`` from a max-shifted sum."""
    return _c(row_max) + F.log(_c(sum_exp)) - _c(x)


def temperature(log_scale):
    return F.exp(_c(log_scale))
