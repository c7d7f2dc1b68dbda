"""Expressions on contact lists, ARRAY<STRUCT<i: INT, j: INT>>."""

from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def transpose_contacts(contacts):
    return F.transform(_c(contacts), lambda x: F.struct(x["j"].alias("i"), x["i"].alias("j")))


def clip_contacts_expr(contacts, len1, len2, max_len):
    """Contacts inside both clipped lengths; a missing list counts as empty."""
    n1 = F.least(_c(len1), F.lit(max_len))
    n2 = F.least(_c(len2), F.lit(max_len))
    kept = F.filter(_c(contacts), lambda x: (x["i"] < n1) & (x["j"] < n2))
    return F.coalesce(kept, F.array().cast("array<struct<i:int,j:int>>"))


def contact_cells_expr(contacts):
    """Distinct positive cells: a contact listed twice marks its cell once."""
    return F.array_distinct(_c(contacts))
