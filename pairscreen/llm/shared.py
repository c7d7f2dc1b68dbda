"""Small things that several operators need."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairscreen.session import materialise

#: Keys that are broadcast: 12 bytes each; more are joined by a shuffle.
BROADCAST_KEYS = 1 << 20


def numbered(columns):
    """Output schema as the DDL string that ``mapInArrow`` takes."""
    return ", ".join(f"{name} {kind}" for name, kind in columns)


def texts(batch, name="text"):
    """A string column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def by_bytes(items, limit):
    """Cut a list of texts into runs of about ``limit`` characters, so that no
    run of long texts is much more work than another.  Yields (start, stop)."""
    start = held = 0
    for i, t in enumerate(items):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(items):
        yield start, len(items)


def bytes_of(column):
    """The bytes of a string or binary Arrow column in one array, and where each
    row starts (one more entry than rows).  Null rows are empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, (at - at[0]).astype(np.int64)


def ascii_lower(col):
    """A-Z in lower case, every other character as it is.  ``lower`` does the
    same to pure ASCII, and much faster than ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(
        F.translate(col, upper, upper.lower())
    )


def keyed(docs, id_col, text_col):
    """``docs`` with the keys of its rows: those equal in id and text share them."""
    return docs.select("*", F.xxhash64(id_col, text_col).alias("k1"), F.hash(id_col, text_col).alias("k2"))


def semi(rows, keys, how="left_semi"):
    """``rows`` whose keys are among ``keys`` (or not: ``left_anti``).  Keys are counted:
    up to ``BROADCAST_KEYS`` are broadcast, so that texts stay where they are; more are
    shuffled."""
    keys = materialise(keys.select("k1", "k2").distinct(), "keys")
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, ["k1", "k2"], how)


def keep_first(docs, rooted, id_col, text_col):
    """``docs`` with one row of each group: that of the smallest id (none is the largest),
    and of several with this id one of them.  ``rooted`` has the ``id``, the keys and
    the group's ``root`` of each row.  All columns are kept, whatever their names, and
    only rows that come back more than once are shuffled."""
    first = F.struct(F.col("id").isNull(), "id", "k1", "k2")
    winners = rooted.groupBy("root").agg(F.min(first).alias("first")).select("first.k1", "first.k2")
    winners = materialise(winners, "winners")
    counted = rooted.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    key = (docs[f"`{id_col}`"], docs[f"`{text_col}`"])
    rows = docs.select(whole, F.xxhash64(*key).alias("k1"), F.hash(*key).alias("k2"))
    rows = semi(rows, counted.join(winners, ["k1", "k2"], "left_anti"), "left_anti")
    again = materialise(counted.where("n > 1").join(winners, ["k1", "k2"], "left_semi"), "again")
    if not again.isEmpty():
        rows = semi(rows, again, "left_anti").unionByName(semi(rows, again).dropDuplicates(["k1", "k2"]))
    return rows.select("row.*")
