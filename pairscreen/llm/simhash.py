"""SimHash fingerprints and near-duplicate groups by deletion-variant signatures."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from pairscreen.llm.components import components
from pairscreen.llm.shared import keep_first, keyed, numbered
from pairscreen.session import materialise

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SEED = 42

#: A bucket of more fingerprints than this is cut again by the bits it leaves free.
BUCKET = 2_048


def fingerprint(text, shingle=3):
    """64 bits of a text; bit b is set if it is set in over half of the hashes
    of its shingles.  No words: 0."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, _SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - shingle]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], _SEED) for s, e in zip(starts, stops)], dtype="<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # 64 bytes a hash, a part at a time
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * set_bits > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs, text_col="text", shingle=3):
    """``docs`` with ``fp``, the 64 bits as a long, in place of the text.  No shuffle."""
    kept = [c for c in docs.columns if c != text_col]

    def run(batches):
        for batch in batches:
            found = (fingerprint(t or "", shingle) for t in batch.column(text_col).to_pylist())
            fp = np.fromiter(found, np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fp)], names=[*kept, "fp"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, numbered([(c, kinds[c]) for c in kept] + [("fp", "long")]))


def _mix(key, value):
    """Path of a bucket: collisions only bring rows together that are then told
    apart by their bits."""
    x = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (value + np.uint64(0x7F4A7C15))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _variants(fp, key, low, width):
    """All one-wildcard variants of the two halves of bits ``low .. low + width``.

    Two fingerprints that differ there in at most 3 bits differ in at most one bit
    in one of the halves, and so share the variant without that bit.  Each variant
    carries the other half as the bits that its bucket leaves free.
    """
    half = width // 2
    one = np.uint64(1)
    mask = np.uint64((1 << half) - 1)
    keys, rest = [], []
    for side in (0, 1):
        segment = (fp >> (low + np.uint64(side * half))) & mask
        for bit in range(half):
            label = np.uint64((side * half + bit) << 8 | half)
            keys.append(_mix(_mix(key, label), segment & ~(one << np.uint64(bit))))
        rest.append(low + np.uint64((1 - side) * half))
    return (
        np.concatenate(keys),
        np.tile(fp, width),
        np.concatenate([np.tile(rest[0], half), np.tile(rest[1], half)]),
    )


def _expand(rows, width):
    """Rows (fp, key, low) to the variants of the next level."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                fp, key, low = (part.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "key", "low"))
                k, f, r = _variants(fp.view(np.uint64), key.view(np.uint64), low.astype(np.uint64), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.view(np.int64)), pa.array(f.view(np.int64)), pa.array(r.astype(np.int32))],
                    names=["key", "fp", "low"],
                )

    return rows.mapInArrow(run, "key long, fp long, low int")


def _forest(fps, near):
    """Edges that connect what links of at most ``near`` bits connect: each
    fingerprint is compared with all others, but a group of n gives n - 1 edges."""
    left = np.arange(len(fps))
    out = []
    while len(left):
        group, left = left[:1], left[1:]
        while len(group) and len(left):
            reach = np.full(len(left), -1)
            for g in group:
                close = (np.bitwise_count(fps[left] ^ fps[g]) <= near) & (reach < 0)
                reach[close] = g
            hit = reach >= 0
            out.append(np.stack([fps[reach[hit]], fps[left[hit]]], axis=1))
            group, left = left[hit], left[~hit]
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def _buckets(near, limit):
    """Task over rows sorted by key: edges of each bucket, or the rows of a bucket
    that is over ``limit``, passed on as they come to be cut again."""

    def emit(kind, a, b, low):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, kind, np.int8)),
                pa.array(a.view(np.int64)),
                pa.array(b.view(np.int64)),
                pa.array(low.astype(np.int32)),
            ],
            names=["kind", "a", "b", "low"],
        )

    def settle(fp, key, low):
        """All rows of whole buckets, at most ``limit`` each."""
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        stops = np.concatenate([starts[1:], [len(key)]])
        pair = stops - starts == 2  # most buckets that are not single
        i = starts[pair]
        close = np.bitwise_count(fp[i] ^ fp[i + 1]) <= near
        i = i[close]
        found = [np.stack([fp[i], fp[i + 1]], axis=1)]
        for s, e in zip(starts[stops - starts > 2], stops[stops - starts > 2]):
            found.append(_forest(fp[s:e], near))
        return np.concatenate(found)

    def run(batches):
        fp, key, low = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        over = None  # the key of a bucket that is being passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "key", "low")]
            fp = np.concatenate([fp, new[0].view(np.uint64)])
            key = np.concatenate([key, new[1].view(np.uint64)])
            low = np.concatenate([low, new[2]])
            change = np.flatnonzero(key[1:] != key[:-1]) + 1
            if limit:
                bounds = np.concatenate([[0], change, [len(key)]])
                sizes = np.diff(bounds)
                big = np.repeat(sizes > limit, sizes)
                if over is not None:
                    big |= key == over
                if big.any():
                    yield emit(1, fp[big], key[big], low[big])
                    over = key[-1] if big[-1] else None
                    fp, key, low = fp[~big], key[~big], low[~big]
                    change = np.flatnonzero(key[1:] != key[:-1]) + 1
            last = change[-1] if len(change) else 0
            if last:
                edges = settle(fp[:last], key[:last], low[:last])
                if len(edges):
                    yield emit(0, edges[:, 0].copy(), edges[:, 1].copy(), np.zeros(len(edges), np.int32))
                fp, key, low = fp[last:], key[last:], low[last:]
        if len(fp):
            edges = settle(fp, key, low)
            if len(edges):
                yield emit(0, edges[:, 0].copy(), edges[:, 1].copy(), np.zeros(len(edges), np.int32))

    return run


def links(fps, near=3, bucket=BUCKET):
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``) that connect
    exactly what pairs of at most ``near`` = 3 differing bits connect.

    Level one cuts 64 bits into two segments, so that two linked fingerprints
    differ by at most one bit in one of them, and joins on the segment with one bit
    taken out.  A bucket that many fingerprints share is cut again by the same rule
    on the bits that it leaves free, down to segments of 8 bits, where a bucket can
    hold some thousands at most; so no link is lost, no task holds an unbounded
    group, and no pairs are written but n - 1 for n connected ones.
    """
    if not 0 <= near <= 3:
        raise ValueError("two segments find links of at most 3 bits")
    rows = fps.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("low"))
    edges, width = None, 64
    while True:
        final = width == 16
        # Hot keys pass through one task as a stream; what it keeps of one is bounded.
        sorted_rows = _expand(rows, width).repartition("key").sortWithinPartitions("key")
        run = _buckets(near, 0 if final else bucket)
        found = materialise(sorted_rows.mapInArrow(run, "kind tinyint, a long, b long, low int"), "links")
        these = found.where("kind = 0").select("a", "b").distinct()
        edges = these if edges is None else edges.union(these)
        over = found.where("kind = 1")
        if final or over.isEmpty():
            return edges
        rows = over.select(F.col("a").alias("fp"), F.col("b").alias("key"), "low")
        width //= 2


def _grouped(rows, shingle, near, bucket):
    """Rows with a text and an ``id``: each with its ``fp``, the ``root`` of its group
    and the group's least id."""
    marked = materialise(fingerprints(rows, "text", shingle), "fingerprints")
    roots = components(links(marked.select("fp").distinct(), near, bucket))
    nodes = marked.groupBy("fp").agg(F.min("id").alias("low"))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low"
    )
    least = rooted.groupBy("root").agg(F.min("low").alias("least"))
    return marked.join(rooted.join(least, "root").select("fp", "root", "least"), "fp")


def near_duplicates(docs, id_col="doc_id", text_col="text", shingle=3, near=3, bucket=BUCKET):
    """Near-duplicate groups: ``id_col``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id among all documents that links of at most
    ``near`` differing bits reach.

    A-Z count as a-z, words are runs of characters other than white space, and a
    text of fewer words than ``shingle`` is one shingle.  Equal fingerprints, such as
    those of copies, are one node, so copies are never paired with each other.

    A null or blank text has fingerprint zero and links like any other.  A null id
    is never the smallest unless its group has no other.  Repeated rows each come
    back; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return _grouped(rows, shingle, near, bucket).select(
        F.col("id").alias(id_col), digits, F.col("least").alias("component_id")
    )


def keep_one(docs, id_col="doc_id", text_col="text", shingle=3, near=3, bucket=BUCKET):
    """``docs`` with one row of each near-duplicate group: that of the smallest id
    (none is the largest), and of several with this id one of them.  All columns are
    kept as they are, whatever their names."""
    rows = keyed(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")), "id", "text")
    return keep_first(docs, _grouped(rows, shingle, near, bucket), id_col, text_col)
