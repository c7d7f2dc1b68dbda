"""Training records: truncated pairs, clipped contacts, labels, augmentation."""

from pyspark.sql import functions as F

from pairscreen.functions import (
    clip_contacts_expr,
    contact_cells_expr,
    hash_uniform,
    transpose_contacts,
)
from pairscreen.operators.knowns import UNKNOWN, normalise_clusters
from pairscreen.session import spread


#: Stands for no limit on a length: the most that a column can hold.
NO_LIMIT = 2**31 - 1


def require_min(df, n, what="sequences"):
    """Fail unless there are at least ``n`` rows; reads no more than ``n``."""
    found = df.limit(n).count()
    if found < n:
        raise ValueError(f"need at least {n} {what}, found {found}")
    return df


def truncate(df, max_len, sequence="sequence", length="length", special=0):
    """Cut sequences to ``max_len`` and add the effective ``length``.  Encoders
    that add ``special`` positions leave that many fewer for residues."""
    room = max_len - special
    return df.withColumn(sequence, F.substring(sequence, 1, room)).withColumn(
        length, F.length(sequence)
    )


def residue_rows(df, sequence="sequence", max_len=None, pos="pos", residue="residue"):
    """One row per residue of each sequence."""
    text = F.col(sequence) if max_len is None else F.substring(sequence, 1, max_len)
    others = [c for c in df.columns if c != sequence]
    symbols = F.filter(F.split(text, ""), lambda s: s != "")
    return spread(df).select(*others, F.posexplode(symbols).alias(pos, residue))


def clip_contacts(df, max_len, contacts="contacts", len1="len1", len2="len2"):
    return df.withColumn(contacts, clip_contacts_expr(contacts, len1, len2, max_len))


def swap_augment(df, id_col, pairs, seed=42, p=0.5, contacts="contacts", epoch=0):
    """With probability ``p`` exchange the two sides of a row: each ``(a, b)``
    in ``pairs`` and the contact list.  ``p = 0`` for validation data."""
    swap = hash_uniform(seed, id_col, epoch=epoch) < F.lit(float(p))
    changed = {"swapped": swap}
    for a, b in pairs:
        changed[a] = F.when(swap, F.col(b)).otherwise(F.col(a))
        changed[b] = F.when(swap, F.col(a)).otherwise(F.col(b))
    if contacts:
        changed[contacts] = F.when(swap, transpose_contacts(contacts)).otherwise(F.col(contacts))
    return df.withColumns(changed)


def symmetric_union(df, pairs, idx=None, size=None):
    """(A, B) and (B, A), from one read of the table.  With ``idx`` and ``size`` (a column or a
    number) the second half is numbered on from the first."""
    names = dict(pairs) | {b: a for a, b in pairs}
    step = F.lit(0) if size is None else F.col(size) if isinstance(size, str) else F.lit(size)

    def side(swapped):
        cols = []
        for c in df.columns:
            value = F.col(names.get(c, c)) if swapped else F.col(c)
            cols.append((value + step if swapped and c == idx else value).alias(c))
        return F.struct(*cols, F.lit(swapped).alias("swapped"))

    return df.select(F.inline(F.array(side(False), side(True))))


def union_splits(*frames):
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def append_ddi(df, ddi, cols=("seq1_cluster", "seq2_cluster")):
    """Add a second data set whose rows have no clusters."""
    for c in cols:
        ddi = ddi.withColumn(c, F.lit(UNKNOWN).cast("bigint"))
    return normalise_clusters(df.unionByName(ddi, allowMissingColumns=True), cols)


def contact_cells(df, max_len, contacts="contacts", len1="len1", len2="len2"):
    """The labelled map of each pair as rows ``(..., i, j, target)``: every cell
    inside both clipped lengths, 1 where the contact list has it."""
    others = [c for c in df.columns if c not in (contacts, len1, len2)]

    def upto(col):
        return F.sequence(F.lit(0), F.least(F.col(col), F.lit(max_len)).cast("int") - 1)

    hits = contact_cells_expr(clip_contacts_expr(contacts, len1, len2, max_len))
    # Each row of the map keeps its own contacts only, before its cells are made.
    row = F.transform(F.filter("__hits", lambda h: h["i"] == F.col("i")), lambda h: h["j"])
    return (
        df.where((F.col(len1) > 0) & (F.col(len2) > 0))
        .select(*others, hits.alias("__hits"), F.explode(upto(len1)).alias("i"), len2)
        .select(*others, row.alias("__row"), "i", F.explode(upto(len2)).alias("j"))
        .withColumn("target", F.array_contains("__row", F.col("j")).cast("int"))
        .drop("__row")
    )


def label_cells(positives, negatives):
    """Positive pairs with their targets, negative pairs all zero."""
    zero = negatives.withColumn("target", F.lit(0))
    return positives.unionByName(zero, allowMissingColumns=True)


def training_records(
    df,
    id_col,
    max_len=None,
    special=0,
    seed=42,
    swap=0.5,
    epoch=0,
    seq1="seq1",
    seq2="seq2",
    c1="seq1_cluster",
    c2="seq2_cluster",
    contacts="contacts",
):
    """Swap, normalise clusters, clip contacts against the raw lengths and the
    map size, then truncate; with both effective lengths.  Nothing is cut unless
    the caller names a ``max_len``."""
    rows = df.withColumns({"len1": F.length(seq1), "len2": F.length(seq2)})
    sides = [(seq1, seq2), (c1, c2), ("len1", "len2")]
    rows = swap_augment(rows, id_col, sides, seed, swap, contacts, epoch)
    room = NO_LIMIT if max_len is None else max_len - special
    rows = clip_contacts(normalise_clusters(rows, (c1, c2)), room, contacts)
    return rows.withColumns(
        {
            seq1: F.substring(seq1, 1, room),
            seq2: F.substring(seq2, 1, room),
            "len1": F.least("len1", F.lit(room)),
            "len2": F.least("len2", F.lit(room)),
        }
    )
