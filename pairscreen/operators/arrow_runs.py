"""Helpers for Arrow tasks that stream sorted rows: cut record batches into
runs of equal leading columns, and view list columns as matrices."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(batches, keys):
    """Yield ``(key tuple, slice)`` for each stretch of rows with equal ``keys``,
    in order.  A stretch that spans batches is yielded in pieces."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(n, dtype=bool)
        change[0] = True
        for c in cols:
            if n > 1:
                a, b = c.slice(1), c.slice(0, n - 1)
                differs = pc.or_(
                    pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null())
                )
                change[1:] |= differs.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(change)
        for start, stop in zip(starts, np.append(starts[1:], n)):
            key = tuple(c[int(start)].as_py() for c in cols)
            yield key, batch.slice(int(start), int(stop - start))


def column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def matrix(batch, name):
    """A list column of equal-length rows as an (n, D) array."""
    col = column(batch, name)
    if col.null_count:
        raise ValueError(f"{name}: a vector is null")
    flat = col.flatten()
    n = len(col)
    lengths = col.value_lengths()
    d = lengths[0].as_py()
    if pc.min(lengths).as_py() != pc.max(lengths).as_py():
        raise ValueError(f"{name}: vectors differ in length")
    if flat.null_count:
        raise ValueError(f"{name}: a vector holds a null")
    return flat.to_numpy(zero_copy_only=False).reshape(n, d)


def ragged(batch, name, dim):
    """A list column of flattened (L, dim) matrices, one array per row."""
    col = column(batch, name)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))
    starts = np.concatenate([[0], ends[:-1]])
    return [flat[s:e].reshape(-1, max(d, 1)) for s, e, d in zip(starts, ends, dim)]


def ids(batch, name):
    return column(batch, name).to_numpy(zero_copy_only=False)


def table(schema, **cols):
    arrays = [pa.array(cols[f.name], type=f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
