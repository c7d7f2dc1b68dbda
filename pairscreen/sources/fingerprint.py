"""Fingerprints of inputs and models, so that mixed versions are refused."""

import hashlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from pairscreen.sources.listing import list_files

RANGE_BYTES = 64 << 20
FAN = 1024
_BLOCK = 1 << 20


def open_file(path):
    """A file by its path or address, for reading at any offset."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return pafs.LocalFileSystem().open_input_file("/" + (rest if colon else path).lstrip("/"))
    authority, _, name = rest.lstrip("/").partition("/")
    files, root = pafs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{authority}/")
    return files.open_input_file(f"{root.rstrip('/')}/{name}")


def _digests(opener, head):
    """Arrow task: SHA-256 of ``head`` and the bytes from ``start`` on, in small blocks."""

    def task(batches):
        for batch in batches:
            found = []
            for row in batch.select(["path", "start", "length"]).to_pylist():
                digest, left = hashlib.sha256(head), row["length"]
                with opener(row["path"]) as f:
                    f.seek(row["start"])
                    while left:
                        block = f.read(min(_BLOCK, left))
                        if not block:
                            raise IOError(f"{row['path']} is shorter than it was")
                        digest.update(block)
                        left -= len(block)
                found.append(digest.digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns)] + [pa.array(found, pa.binary())],
                names=[*batch.schema.names, "digest"],
            )

    return task


def _hashed(pieces, opener, head=b""):
    """``pieces`` dealt over the cluster, each with its digest."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.repartition(n, "path", "start")
    return dealt.mapInArrow(_digests(opener or open_file, head), f"{fields}, digest binary")


def _name():
    return F.regexp_extract("path", r"([^/]*)$", 1).alias("name")


def fingerprint(spark, path, glob=None, opener=None):
    """SHA-256 of every file, as ``(name, size, sha256)``, as published sums are.  A file is
    read in small blocks by one task, for that hash cannot be cut; ``tree_fingerprint``
    can.  ``opener`` opens a path on the executors, if ``open_file`` cannot."""
    files = list_files(spark, path, glob or "*")
    pieces = files.select("path", "size", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("length"))
    return _hashed(pieces, opener).select(_name(), "size", F.lower(F.hex("digest")).alias("sha256"))


def tree_fingerprint(spark, path, glob=None, range_bytes=RANGE_BYTES, fan=FAN, opener=None):
    """A hash tree over byte ranges of every file, as ``(name, size, sha256)``: ranges are read
    by different tasks, and up to ``fan`` digests at a time are hashed into one.  Leaves
    and inner nodes start with different bytes and the root covers size, range and fan, so
    other cuts have other roots.  A file of any size; an empty one has one empty range."""
    files = list_files(spark, path, glob or "*")
    last = F.greatest(F.floor((F.col("size") - 1) / range_bytes), F.lit(0))
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("at"))
    start = F.col("at") * range_bytes
    length = F.least(F.lit(range_bytes).cast("bigint"), F.col("size") - start)
    level = _hashed(ranges.select("*", start.alias("start"), length.alias("length")), opener, b"\0")
    width = F.ceil(F.col("size") / range_bytes)
    level = level.select("path", "size", "at", "digest", width.alias("width"))
    widest = -(-(files.agg(F.max("size")).first()[0] or 0) // range_bytes)
    while widest > 1:
        nodes = F.array_sort(F.collect_list(F.struct("at", "digest")))
        below = F.array_join(F.transform(nodes, lambda node: F.hex(node["digest"])), "")
        inner = F.unhex(F.sha2(F.unhex(F.concat(F.lit("01"), below)), 256))
        # A file that has its root already keeps it, however large the others are.
        level = level.groupBy("path", "size", "width", F.floor(F.col("at") / fan).alias("at")).agg(
            F.when(F.col("width") <= 1, F.first("digest")).otherwise(inner).alias("digest")
        )
        level = level.withColumn("width", F.ceil(F.col("width") / fan))
        widest = -(-widest // fan)
    shape = F.concat_ws(":", "size", F.lit(range_bytes), F.lit(fan)).cast("binary")
    return level.select(_name(), "size", F.sha2(F.concat(shape, "digest"), 256).alias("sha256"))


def require_same(found, expected):
    """``found`` unchanged, or an error naming a file that differs or is missing."""
    want = expected.select("name", F.col("sha256").alias("want"))
    bad = (
        want.join(found, "name", "left")
        .where(F.col("sha256").isNull() | (F.col("sha256") != F.col("want")))
        .select("name")
        .first()
    )
    if bad is not None:
        raise ValueError(f"{bad['name']} is missing or differs from the expected version")
    return found


def content_hash(df, by, cols):
    """One hash per group that does not depend on row order: hashed rows are
    combined, never collected."""
    by = [by] if isinstance(by, str) else list(by)
    row = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in cols])
    first, second = F.bit_xor(F.xxhash64(row)), F.bit_xor(F.xxhash64(row, F.lit(1)))
    return df.groupBy(*by).agg(
        F.concat(F.hex(first), F.hex(second), F.hex(F.count(F.lit(1)))).alias("content_hash")
    )
