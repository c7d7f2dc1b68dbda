"""Packing of token sequences: first-fit decreasing in randomised groups."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pairscreen.llm.shared import numbered, texts
from pairscreen.llm.tokens import encode_long, encoder
from pairscreen.session import materialise

#: Pieces that one group holds on average: enough for full bins, little for a task.
GROUP_PIECES = 16_384


class FirstFit:
    """Bins of equal capacity in a tournament tree: every inner node holds the
    most room in any bin below it, so the first bin with room for an item is
    found, and its room lowered, in as many steps as the tree is high."""

    def __init__(self, bins, capacity):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size):
        """Bin and offset of an item."""
        room, leaves, at = self.room, self.leaves, 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        offset = self.capacity - room[at]
        room[at] -= size
        found = at - leaves
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return found, offset


def first_fit_decreasing(sizes, capacity):
    """Bin and offset of each of ``sizes``, which come in falling order."""
    tree = FirstFit(max(1, len(sizes)), capacity)
    return [tree.place(s) for s in sizes]


def cut_ids(docs, path, id_col="doc_id", text_col="text", capacity=1024, end_id=0):
    """Whole texts as token ids, ``end_id`` behind each, cut into pieces of
    ``capacity`` ids and a rest: id, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``.  Only checksums leave the task."""
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            ids = batch.column("id")
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(texts(batch)):
                raw = memoryview(encode_long(encode, text).astype("<u4", copy=False).tobytes() + end)
                n = len(raw) // 4
                for s in range(0, n, capacity):
                    e = min(n, s + capacity)
                    row.append(i)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(raw[4 * s : 4 * e]))
                    total.append(n)
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int64())), *numbers],
                names=["id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    schema = numbered([("id", kind)] + [(c, "long") for c in ("start", "length", "ids_crc32", "doc_tokens")])
    cut = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
    return cut.withColumnRenamed("id", id_col)


def pack(docs, path, id_col="doc_id", text_col="text", capacity=1024, end_id=0, group_pieces=GROUP_PIECES):
    """Pack whole texts into sequences of at most ``capacity`` tokens: one row per
    piece with id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` and ``offset``.

    A text becomes its token ids and ``end_id``; the ids are cut into full pieces
    and a rest.  Pieces get a random number (of their row, not of their id, so that
    an id with a third of all rows is spread too), which deals them into groups of
    about ``group_pieces``; every group is packed by itself, longest piece first,
    each into the first bin with room.  Groups do not wait for each other and no
    task sees more than one group at a time.

    A null text is empty and still has its ``end_id``.  Null ids and repeated rows
    are packed like any others; an empty table gives no rows; other columns are
    ignored.  Ties in length go by id, start and the random number.
    """
    cut = cut_ids(docs, path, id_col, text_col, capacity, end_id)
    # Written once: the numbers dealt here must not change if a task runs again.
    cut = materialise(cut.withColumn("__deal", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    kind = dict(cut.dtypes)[id_col]
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]

    def fill(frame):
        frame = frame.sort_values(["length", id_col, "start", "__deal"], ascending=[False, True, True, True])
        placed = first_fit_decreasing(frame["length"].tolist(), capacity)
        bins = np.fromiter((p[0] for p in placed), np.int64, len(placed))
        group = int(frame["__group"].iloc[0])
        return pd.DataFrame(
            {**{c: frame[c] for c in names}, "sequence_id": (group << 32) + bins, "offset": [p[1] for p in placed]}
        )

    schema = numbered([(id_col, kind)] + [(c, "long") for c in [*names[1:], "sequence_id", "offset"]])
    return (
        cut.withColumn("__group", F.pmod(F.col("__deal"), F.lit(groups)))
        .groupBy("__group")
        .applyInPandas(fill, schema)
    )
