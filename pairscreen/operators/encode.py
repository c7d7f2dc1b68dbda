"""Sequences to residue vectors and query/key embeddings.

An encoder is any object with ``version``, ``dim`` and ``residues(seqs) ->
list of (len, dim) arrays``; ``load()`` is called once per task.  The default
is a deterministic stand-in made of hashed k-mers, NOT a trained model: plug
the real one in here.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairscreen.operators.arrow_runs import column
from pairscreen.session import spread

CHUNK_VALUES = 8_000_000  # residue values per output batch


class HashedKmerEncoder:
    """Each position is described by the row of a fixed random table that its
    k-mer hashes to."""

    BITS = 12

    def __init__(self, dim=32, k=3, seed=42):
        self.dim, self.k, self.seed = dim, k, seed
        self.version = f"kmer-{dim}-{k}-{seed}"
        self._rows = None

    def load(self):
        if self._rows is None:
            rng = np.random.default_rng(self.seed)
            self._rows = rng.standard_normal((1 << self.BITS, self.dim)).astype(np.float32)
        return self

    def residues(self, seqs):
        return [self._one(s) for s in seqs]

    def _one(self, seq):
        codes = np.frombuffer(seq.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        if not len(codes):
            return np.zeros((0, self.dim), dtype=np.float32)
        mixed = np.full(len(codes), self.seed, dtype=np.uint64)
        for lag in range(self.k):
            shifted = np.concatenate([np.zeros(min(lag, len(codes)), np.uint64), codes[: len(codes) - lag]])
            mixed = _mix(mixed ^ (shifted + np.uint64(lag)))
        return self.load()._rows[mixed >> np.uint64(64 - self.BITS)]


def _mix(x):
    """64-bit finaliser with the usual public constants."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class LinearHead:
    """A stand-in for a trained head: a seeded linear map of the mean over
    positions, unit length.  A head is any callable from an (n, dim) matrix of such
    means to an (n, out) matrix."""

    def __init__(self, dim, out, seed):
        self.weights = np.random.default_rng(seed).standard_normal((dim, out)) / np.sqrt(dim)

    def __call__(self, means):
        v = means @ self.weights
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def default_heads(encoder, out=64):
    """Query and key heads with weights of their own."""
    return LinearHead(encoder.dim, out, 1), LinearHead(encoder.dim, out, 2)


def _vectors(m):
    """Rows of a matrix as an Arrow list column."""
    flat = pa.array(np.ascontiguousarray(m, dtype=np.float32).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), flat)


def encode(
    df, ids, sequence="sequence", encoder=None, heads=None, max_len=None, residues=True, deal=True
):
    """``ids`` plus ``length``, ``q``, ``k`` and, if asked for, ``residues``.
    Whole sequences are read unless the caller names a ``max_len``.  Output batches are cut by volume,
    so one task never holds more than a few long sequences.  ``deal`` shares a
    small input out over all slots first."""
    encoder = encoder or HashedKmerEncoder()
    head_q, head_k = heads or default_heads(encoder)
    ids = [ids] if isinstance(ids, str) else list(ids)
    vec = T.ArrayType(T.FloatType())
    fields = [df.schema[c] for c in ids]
    fields += [T.StructField("length", T.IntegerType()), T.StructField("q", vec), T.StructField("k", vec)]
    if residues:
        fields.append(T.StructField("residues", T.ArrayType(vec)))
    out = T.StructType(fields)
    schema = to_arrow_schema(out)

    def pack(rows, mats):
        lengths = np.array([len(m) for m in mats], dtype=np.int64)
        means = np.stack([m.sum(axis=0, dtype=np.float64) / max(1, len(m)) for m in mats])
        columns = [pa.array([r[i] for r in rows], schema.field(c).type) for i, c in enumerate(ids)]
        columns += [pa.array(lengths, pa.int32()), _vectors(head_q(means)), _vectors(head_k(means))]
        if residues:
            ends = np.concatenate([[0], np.cumsum(lengths)])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _vectors(np.concatenate(mats))))
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def task(batches):
        model = encoder.load()
        for batch in batches:
            keys = list(zip(*[column(batch, c).to_pylist() for c in ids]))
            seqs = [s if max_len is None else s[:max_len] for s in column(batch, sequence).to_pylist()]
            start, values = 0, 0
            for n, seq in enumerate(seqs):
                if n > start and values + len(seq) * encoder.dim > CHUNK_VALUES:
                    yield pack(keys[start:n], model.residues(seqs[start:n]))
                    start, values = n, 0
                values += len(seq) * encoder.dim
            if start < len(seqs):
                yield pack(keys[start:], model.residues(seqs[start:]))

    rows = df.select(*ids, sequence)
    return (spread(rows) if deal else rows).mapInArrow(task, out)
