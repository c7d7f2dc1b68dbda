"""Exact inner-product retrieval for any number of queries and keys.

A task holds one block of queries and streams the keys past it; only the best
``k`` rows per query leave the task (see ``tiles`` and ``dot_kernels``).  Ties
go to the smaller key id.  N x N similarities are never stored or shuffled.
"""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairscreen.operators import tiles
from pairscreen.operators.arrow_runs import ids, matrix, runs, table
from pairscreen.operators.dot_kernels import KeyBuffer, RunningRank, RunningTop
from pairscreen.operators.tiles import TILE


def _vec_type(*cols):
    kinds = {f.dataType.elementType.typeName() for f in cols}
    return "array<float>" if kinds == {"float"} else "array<double>"


def _sides(queries, keys, q_id, q_vec, k_id, k_vec, q_space, k_space, held=(), per=None):
    vec = _vec_type(queries.schema[q_vec], keys.schema[k_vec])

    def space(col):
        return (F.lit(0) if col is None else F.col(col)).alias("space")

    left = queries.select(
        space(q_space), F.col(q_id).alias("q_id"), F.col(q_vec).cast(vec).alias("vec"), *held
    )
    grp = (F.col(per) if per else F.lit(0)).alias("grp")
    right = keys.select(
        space(k_space), F.col(k_id).alias("c_id"), grp, F.col(k_vec).cast(vec).alias("vec")
    )
    return left, right


#: What a row or a result weighs in a shuffle beside its vector.
ROW_BYTES = 40


def _plan(left, right, k, q_space, query_block, key_shard, grouped=False):
    """Block size from the vector width: a held query costs its vector, twice,
    and 24 bytes for each of its best ``k``.  A query that is sent to one more shard
    brings back ``k`` results for each group of keys."""

    def vector():
        first = left.select(F.size("vec")).first()
        value = 4 if left.schema["vec"].dataType.elementType.typeName() == "float" else 8
        return (first[0] if first else 0) * value

    def rows():
        return tiles.block_rows(vector() * 2 + 24 * k)

    def costs():
        groups = right.agg(F.approx_count_distinct("grp")).first()[0] if grouped else 1
        row = vector() + ROW_BYTES
        return row + k * max(1, groups) * ROW_BYTES, row

    return tiles.plan(
        left.select("space"), right.select("space"), q_space is None, query_block or rows, key_shard, costs
    )


def topk_by_space(
    queries,
    keys,
    k,
    q_id="q_id",
    q_vec="vec",
    k_id="c_id",
    k_vec="vec",
    q_space=None,
    k_space=None,
    per=None,
    query_block=None,
    key_shard=None,
):
    """The best ``k`` keys of every query as ``(q_id, [per], c_id, ip, rank)``.

    ``q_space``/``k_space``: only keys of the query's own space count; a query
    listed in several spaces gets its best ``k`` in each.
    ``per``: a key column; the best ``k`` are taken for each of its values.
    """
    left, right = _sides(queries, keys, q_id, q_vec, k_id, k_vec, q_space, k_space, per=per)
    p = _plan(left, right, k, q_space, query_block, key_shard, per is not None)
    per_type = keys.schema[per].dataType if per else T.IntegerType()
    both = tiles.meet(
        [
            tiles.place(left, p, "q_id", True).withColumn("kind", F.lit(0)),
            tiles.place(right, p, "c_id", False).withColumn("kind", F.lit(1)),
        ],
        p,
        ["kind", "grp", "c_id"],
    )
    out = T.StructType(
        [
            T.StructField("space", left.schema["space"].dataType),
            T.StructField("q_id", queries.schema[q_id].dataType),
            T.StructField("grp", per_type),
            T.StructField("c_id", keys.schema[k_id].dataType),
            T.StructField("ip", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
        ]
    )
    found = both.mapInArrow(_top_task(k, to_arrow_schema(out)), out)
    if not p.single_shard:
        by = ["q_id", "grp"] if q_space is None else ["space", "q_id", "grp"]
        best = Window.partitionBy(*by).orderBy(F.desc("ip"), "c_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = found.drop("space")
    return found.withColumnRenamed("grp", per) if per else found.drop("grp")


def _top_task(k, schema):
    def task(batches):
        tile, held, queries, q_ids, feed, grp = None, [], None, None, None, None

        def leave():
            if feed is None:
                return None
            feed.flush()
            top = feed.sink
            starts = np.searchsorted(top.rows, top.rows, side="left")
            rank = np.arange(len(top.rows)) - starts + 1
            return table(
                schema,
                space=[tile[0]] * len(top.rows),
                q_id=q_ids[top.rows],
                grp=[grp] * len(top.rows),
                c_id=top.key,
                ip=top.score,
                rank=rank.astype(np.int32),
            )

        for key, part in runs(batches, [*TILE, "kind", "grp"]):
            if key[:3] != tile:
                done = leave()
                if done is not None:
                    yield done
                tile, held, queries, feed, grp = key[:3], [], None, None, None
            if key[3] == 0:
                held.append((ids(part, "q_id"), np.array(matrix(part, "vec"))))
                continue
            if not held:
                continue
            if queries is None:
                q_ids = np.concatenate([h[0] for h in held])
                queries = np.concatenate([h[1] for h in held])
            if feed is None or key[4] != grp:
                done = leave()
                if done is not None:
                    yield done
                feed, grp = KeyBuffer(RunningTop(queries, k)), key[4]
            feed.add(matrix(part, "vec"), ids(part, "c_id"))
        done = leave()
        if done is not None:
            yield done

    return task


def topk_inner_product(queries, keys, top_k=100, exclude_self=True, **names):
    """Self retrieval: the best ``top_k + 1`` including the query itself, which
    is then dropped.  A query that was not among them keeps all ``top_k + 1``."""
    found = topk_by_space(queries, keys, top_k + 1, **names)
    return found.where(F.col("q_id") != F.col("c_id")) if exclude_self else found


def topk_union(queries, host_keys, own_keys, top_k=100, host="host_proteome", own="viral_proteome"):
    """Candidates of every (query, host proteome) over the union of that host's
    keys and the keys of the query's own proteome.

    ``queries`` and ``own_keys`` carry ``q_id``/``c_id``, ``vec`` and the
    ``own`` column; ``host_keys`` carries ``c_id``, ``vec`` and ``host``.
    The best of a union are the best of the two sides' best, so the own side
    is searched once per query, not once per host.
    """
    k = top_k + 1
    hosts = topk_by_space(queries, host_keys, k, per=host)
    owns = topk_by_space(queries, own_keys, k, q_space=own, k_space=own)

    def entry(is_host):
        # Sorts by score, then hosts before own keys, then key id.
        return F.struct(
            (-F.col("ip")).alias("neg"),
            F.lit(0 if is_host else 1).alias("side"),
            F.col("c_id"),
        )

    own_lists = owns.groupBy("q_id").agg(F.collect_list(entry(False)).alias("own_list"))
    merged = F.slice(F.array_sort(F.concat("host_list", F.coalesce("own_list", F.array()))), 1, k)
    return (
        hosts.groupBy("q_id", host)
        .agg(F.collect_list(entry(True)).alias("host_list"))
        .join(own_lists, "q_id", "left")
        .select("q_id", host, F.posexplode(merged).alias("p", "e"))
        .select(
            "q_id",
            host,
            F.col("e.c_id").alias("c_id"),
            (F.col("e.side") == 0).alias("is_host"),
            (-F.col("e.neg")).alias("ip"),
            (F.col("p") + 1).cast("int").alias("rank"),
        )
        .where(F.col("is_host") | (F.col("q_id") != F.col("c_id")))
    )


def rank_against(
    queries,
    keys,
    q_id="q_id",
    q_vec="vec",
    k_id="c_id",
    k_vec="vec",
    bar="bar",
    bar_id="bar_id",
    q_space=None,
    k_space=None,
    query_block=None,
    key_shard=None,
):
    """Place of a given (score, key id) in the full ranking of each query, as
    ``(q_id, rank)``: one more than the number of keys that come before it.
    Counts leave the task, never rankings."""
    held = [F.col(bar).cast("double").alias("bar"), F.col(bar_id).alias("bar_id")]
    left, right = _sides(queries, keys, q_id, q_vec, k_id, k_vec, q_space, k_space, held)
    p = _plan(left, right, 1, q_space, query_block, key_shard)
    both = tiles.meet(
        [
            tiles.place(left, p, "q_id", True).withColumn("kind", F.lit(0)),
            tiles.place(right, p, "c_id", False).withColumn("kind", F.lit(1)),
        ],
        p,
        ["kind", "c_id"],
    )
    out = T.StructType(
        [
            T.StructField("q_id", queries.schema[q_id].dataType),
            T.StructField("better", T.LongType()),
        ]
    )
    counts = both.mapInArrow(_rank_task(to_arrow_schema(out)), out)
    return counts.groupBy("q_id").agg((F.sum("better") + 1).alias("rank"))


def _rank_task(schema):
    def task(batches):
        tile, held, feed, q_ids = None, [], None, None

        def leave():
            feed.flush()
            return table(schema, q_id=q_ids, better=feed.sink.better)

        for key, part in runs(batches, [*TILE, "kind"]):
            if key[:3] != tile:
                if feed is not None:
                    yield leave()
                tile, held, feed = key[:3], [], None
            if key[3] == 0:
                held.append(
                    (
                        ids(part, "q_id"),
                        np.array(matrix(part, "vec")),
                        ids(part, "bar"),
                        ids(part, "bar_id"),
                    )
                )
                continue
            if not held:
                continue
            if feed is None:
                q_ids, vecs, bars, bar_ids = (np.concatenate(x) for x in zip(*held))
                feed = KeyBuffer(RunningRank(vecs, bars, bar_ids))
            feed.add(matrix(part, "vec"), ids(part, "c_id"))
        if feed is not None:
            yield leave()

    return task


def topk_rank(df, by, score, tie, k):
    """Rank rows of a scored table and keep the first ``k`` of each group."""
    by = [by] if isinstance(by, str) else list(by)
    best = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
