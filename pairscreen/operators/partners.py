"""Best key of each query among the clusters that are its partners.

Which cluster goes with which is a relation, not a column of the rows: a tile gets
its part of the relation beside its rows and masks the product with it.  So a
query travels once to each shard that holds a partner, however many partner
clusters there are, and a key once to each block.
"""

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairscreen.operators import tiles
from pairscreen.operators.arrow_runs import column, ids, matrix, runs, table
from pairscreen.operators.dot_kernels import (
    BLOCK_CELLS,
    KEY_ROWS,
    KEY_VALUES,
    below,
    exact_dots,
    first_copies,
    lengths_of,
    rounding_bound,
)
from pairscreen.operators.retrieval import _plan, _sides
from pairscreen.operators.tiles import TILE
from pairscreen.session import materialise

#: Related cluster pairs that a task holds before they are used.
RELATION_ROWS = 4_000_000
#: Pieces that an even share is cut into, so that clusters fill blocks evenly.
FINE = 4
#: Heavy clusters up to this many are broadcast; there are never more than FINE for each piece.
FEW_HEAVY = 100_000


def _weights(side, n, rows):
    """``(cluster, pieces)``: a cluster larger than a fraction of an even share is cut."""
    unit = max(1, -(-rows // (n * FINE)))
    cuts = F.least(F.lit(n), F.ceil(F.count(F.lit(1)) / unit)).cast("int")
    return side.groupBy("cluster").agg(cuts.alias("pieces"))


def _nth(cluster, at, n):
    return F.pmod(F.pmod(F.xxhash64(cluster), F.lit(n)) + at, F.lit(n)).cast("int")


def _deal(side, weights, row_id, n, out):
    """Rows with their piece: a cluster lies in ``pieces`` neighbouring ones."""
    if n == 1:
        return side.withColumn(out, F.lit(0))
    heavy = weights.where("pieces > 1")
    heavy = F.broadcast(heavy) if n * FINE <= FEW_HEAVY else heavy
    at = F.pmod(F.xxhash64(row_id), F.coalesce("pieces", F.lit(1)))
    return side.join(heavy, "cluster", "left").withColumn(out, _nth("cluster", at, n)).drop("pieces")


def _spread(relation, weights, col, n, out):
    """The relation, once for each piece of the cluster in ``col``; pairs without rows go."""
    held = relation.join(weights.withColumnRenamed("cluster", col), col)
    at = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    return held.withColumn("at", at).withColumn(out, _nth(col, F.col("at"), n)).drop("at", "pieces")


def _route(side, relation, col, own, other, n_own, n_other):
    """Copies of the rows for the opposite pieces that hold a partner of their cluster.  Met
    by cluster and piece: a cluster with most of the rows is in many pieces, so no key is hot."""
    if n_other == 1:
        return side.withColumn(other, F.lit(0))
    ways = relation.select(F.col(col).alias("cluster"), own, other).distinct()
    return side.join(ways, ["cluster", own])


def best_partner(queries, keys, known, query_block=None, key_shard=None):
    """``(q_id, c_id, ip)``: for each tile a query is in, its best key of a partner
    cluster; ties go to the smaller key id.  ``queries``: ``q_id``, ``vec``, ``cluster``;
    ``keys``: ``c_id``, ``vec``, ``cluster``; ``known``: distinct ``(c1, c2)``, query and key
    cluster.  A null cluster has no partner.  Clusters are compared by their text."""
    text = F.col("cluster").cast("string").alias("cluster")
    queries = queries.where("cluster is not null").select("q_id", "vec", text)
    keys = keys.where("cluster is not null").select("c_id", "vec", text)
    left, right = _sides(
        queries.withColumnRenamed("cluster", "c"), keys.withColumnRenamed("cluster", "c"),
        "q_id", "vec", "c_id", "vec", None, None, held=[F.col("c").alias("cluster")], per="c",
    )
    right = right.withColumnRenamed("grp", "cluster")
    p = _plan(left, right, 1, None, query_block, key_shard)
    (n_lb, n_rb), (n_left, n_right) = p.pieces, p.rows
    q_weights, k_weights = _weights(left, n_lb, n_left), _weights(right, n_rb, n_right)
    # Read by the relation and by the rows.
    q_weights = materialise(q_weights, "query-clusters") if n_lb > 1 else q_weights
    k_weights = materialise(k_weights, "key-clusters") if n_rb > 1 else k_weights
    relation = known.select(F.col("c1").cast("string").alias("c1"), F.col("c2").cast("string").alias("c2"))
    relation = _spread(relation, q_weights, "c1", n_lb, "lb")
    relation = _spread(relation, k_weights, "c2", n_rb, "rb")
    if n_lb * n_rb > 1:
        relation = materialise(relation, "relation")
    asked = _route(_deal(left, q_weights, "q_id", n_lb, "lb"), relation, "c1", "lb", "rb", n_lb, n_rb)
    held = _route(_deal(right, k_weights, "c_id", n_rb, "rb"), relation, "c2", "rb", "lb", n_rb, n_lb)
    pairs = relation.select("lb", "rb", F.col("c2").alias("cluster"), F.col("c1").alias("partner"))
    sides = [asked.withColumn("kind", F.lit(0)), pairs.withColumn("kind", F.lit(1)), held.withColumn("kind", F.lit(2))]
    sides = [
        s.withColumns(
            {
                "space": F.lit(0),
                "side": F.least("kind", F.lit(1)),
                "tile": F.col("lb").cast("bigint") * n_rb + F.col("rb"),
            }
        )
        for s in sides
    ]
    both = tiles.meet(sides, p, ["side", "cluster", "kind", "c_id"])
    out = T.StructType(
        [
            T.StructField("q_id", queries.schema["q_id"].dataType),
            T.StructField("c_id", keys.schema["c_id"].dataType),
            T.StructField("ip", T.DoubleType()),
        ]
    )
    return both.mapInArrow(_partner_task(to_arrow_schema(out)), out)


class RelatedBest:
    """The best key per query among those of partner clusters; exact, like the
    other kernels, and the same for any order of the keys."""

    def __init__(self, queries, clusters):
        self.q = queries
        self.q_t = np.ascontiguousarray(queries.T)
        self.q_len = lengths_of(queries)
        self.g = rounding_bound(queries.shape[1], queries.dtype)
        self.names, self.cluster = np.unique(clusters, return_inverse=True)
        self.score = np.full(len(queries), -np.inf)
        self.key = None

    def feed(self, keys, key_ids, key_clusters, partners, related):
        """Keys with their clusters, and the pairs ``(partners, related)`` of query and key cluster."""
        names, of_key = np.unique(key_clusters, return_inverse=True)
        mine, is_mine = _find(self.names, partners)
        theirs, is_theirs = _find(names, related)
        both = is_mine & is_theirs
        mine, theirs = mine[both], theirs[both]
        asked = np.zeros(len(self.names), dtype=bool)
        asked[mine] = True
        rows = np.flatnonzero(asked[self.cluster])
        if not len(rows):
            return
        # Equal vectors of one cluster: the first decides.
        keep = first_copies(np.column_stack([keys, of_key.astype(keys.dtype)]), 1)
        if keep is not None:
            keys, key_ids, of_key = keys[keep], key_ids[keep], of_key[keep]
        by_id = np.argsort(key_ids, kind="stable")
        place = np.empty(len(by_id), dtype=np.int64)
        place[by_id] = np.arange(len(by_id))
        if self.key is None:
            self.key = np.empty(len(self.q), dtype=key_ids.dtype)
        order = np.argsort(mine, kind="stable")
        mine, theirs = mine[order], theirs[order]
        rows = rows[np.argsort(self.cluster[rows], kind="stable")]
        longest = lengths_of(keys).max()
        keys_t = np.ascontiguousarray(keys.T)
        step = max(1, BLOCK_CELLS // len(keys))
        for s in range(0, len(rows), step):
            r = rows[s : s + step]
            here, of_row = np.unique(self.cluster[r], return_inverse=True)
            lo, hi = np.searchsorted(mine, here[0], "left"), np.searchsorted(mine, here[-1], "right")
            goes = np.zeros((len(here), len(names)), dtype=bool)
            goes[np.searchsorted(here, mine[lo:hi]), theirs[lo:hi]] = True
            self._block(r, goes[of_row][:, of_key], keys_t, longest, key_ids, place)

    def _block(self, r, goes, keys_t, longest, key_ids, place):
        s = self.q[r] @ keys_t
        s[~goes] = -np.inf
        slack = self.q_len[r] * longest * self.g
        bar = np.maximum(self.score[r] - slack, s.max(axis=1) - 2 * slack)
        at, c = np.nonzero((s >= below(bar, s.dtype)[:, None]) & goes)
        exact = exact_dots(self.q_t, r[at], keys_t, c)
        order = np.lexsort((place[c], -exact, at))
        at, c, exact = at[order], c[order], exact[order]
        best = np.ones(len(at), dtype=bool)
        best[1:] = at[1:] != at[:-1]
        row, key, score = r[at[best]], key_ids[c[best]], exact[best]
        wins = score > self.score[row]
        ties = np.flatnonzero((score == self.score[row]) & ~wins)
        wins[ties] = key[ties] < self.key[row[ties]]
        self.score[row[wins]], self.key[row[wins]] = score[wins], key[wins]


def _find(names, values):
    """Place of each value in the sorted names, and whether it is there."""
    at = np.minimum(np.searchsorted(names, values), len(names) - 1)
    return at, names[at] == values


def _partner_task(schema):
    def task(batches):
        tile, asked, best, waiting = None, [], None, None

        def leave():
            if best is None:
                return
            use(waiting, True)
            hit = np.flatnonzero(best.score > -np.inf)
            if len(hit):
                yield table(schema, q_id=q_ids[hit], c_id=best.key[hit], ip=best.score[hit])

        def use(held, last=False):
            """Score the keys held.  What is related to the cluster in hand, or to one
            still to come, stays."""
            keys, related = held
            if keys:
                vecs, key_ids, of_key = (np.concatenate(x) for x in zip(*keys))
                pairs = [np.concatenate(x) for x in zip(*related)] if related else None
                if pairs is not None:
                    best.feed(vecs, key_ids, of_key, pairs[0], pairs[1])
                    stay = pairs[1] >= of_key[-1]
                    related[:] = [] if last else [(pairs[0][stay], pairs[1][stay])]
                keys.clear()

        for key, part in runs(batches, [*TILE, "side"]):
            if key[:3] != tile:
                yield from leave()
                tile, asked, best, waiting, n, m = key[:3], [], None, ([], []), 0, 0
            if key[3] == 0:
                asked.append((ids(part, "q_id"), np.array(matrix(part, "vec")), names(part, "cluster")))
                continue
            if not asked:
                continue
            if best is None:
                q_ids, vecs, clusters = (np.concatenate(x) for x in zip(*asked))
                best = RelatedBest(vecs, clusters)
            is_pair = pc.equal(column(part, "kind"), 1)
            pairs, rows = part.filter(is_pair), part.filter(pc.invert(is_pair))
            if pairs.num_rows:
                waiting[1].append((names(pairs, "partner"), names(pairs, "cluster")))
                m += pairs.num_rows
            if rows.num_rows:
                vecs = matrix(rows, "vec")
                waiting[0].append((vecs, ids(rows, "c_id"), names(rows, "cluster")))
                n += rows.num_rows
                if n >= KEY_ROWS or n * vecs.shape[1] >= KEY_VALUES or m >= RELATION_ROWS:
                    use(waiting)
                    n, m = 0, sum(len(p[0]) for p in waiting[1])
        yield from leave()

    return task


def names(batch, name):
    """A text column as an array that sorts like the text."""
    return np.asarray(column(batch, name).to_pylist(), dtype=object)
