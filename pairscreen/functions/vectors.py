"""Vector expressions on ARRAY columns, computed in DOUBLE."""

from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def _sum(arr):
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def inner_product(a, b):
    """Left-to-right sum of products.  The order is part of the contract: the
    bulk retrieval recomputes its survivors in the same order, so both give
    the same bits."""
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_normalise(v, eps=1e-12):
    v = _c(v)
    norm = F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    # Bound to a variable of its own, or each element would compute it again.
    once = F.array(F.greatest(norm, F.lit(eps)))
    return F.transform(once, lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def sigmoid(x):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def multihead_logit(q, k, weights, bias=-3.0):
    """Sum over heads of ``w_h * (q_h . k_h) / sqrt(d)`` plus a bias; the head
    width ``d`` is the vector length over the number of weights."""
    q, k = _c(q), _c(k)
    heads = len(weights)
    d = F.floor(F.size(q) / F.lit(heads)).cast("int")
    total = F.lit(float(bias))
    for h, w in enumerate(weights):
        start = d * h + 1
        dot = inner_product(F.slice(q, start, d), F.slice(k, start, d))
        total = total + F.lit(float(w)) * dot / F.sqrt(d.cast("double"))
    return total
