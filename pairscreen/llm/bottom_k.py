"""Near-duplicate groups by bottom-k sketches of word shingles.

One hash function orders all shingles; the least ``k`` of a document are its sketch.
Inverted lists of the retained values tell which documents overlap, the sketch of a
union estimates the Jaccard index, and whole sets decide.
"""

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from pairscreen.llm.components import components
from pairscreen.llm.shared import bytes_of, keyed, numbered, semi
from pairscreen.llm.word_table import WordTable, scramble
from pairscreen.operators.arrow_runs import runs
from pairscreen.session import materialise

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of text whose words are held as arrays at once (a longer text alone).
SLICE = 4 << 20
#: Values that the sketches of the first and of the second round retain.
NARROW, WIDE = 64, 256
#: Chance that a pair at the least similarity shares fewer retained values than asked.
MISS = 1e-9
#: Values of whole sets on each side of a tile.
BLOCK = 1 << 17
#: A cell of more blocks is cut into the inverted lists that it consists of.
CELL_BLOCKS = 32


def shingle_sets(column, words):
    """The shingles of each text of an Arrow column as sorted distinct 64-bit hashes.

    A-Z count as a-z.  A text of fewer words than ``words`` is one shingle, one
    without words or without text has none.
    """
    raw, at = bytes_of(column)
    out, start = [], 0
    while start < len(at) - 1:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + SLICE, side="right")) - 1)
        table = WordTable(_LOWER[raw[at[start] : at[stop]]], at[start : stop + 1] - at[start])
        word = table.hashes()
        whole = np.full(max(0, len(word) - words + 1), words, np.uint64)
        for j in range(words):
            whole = scramble(whole * _MIX + word[j : j + len(whole)])
        whole = whole.view(np.int64)
        first = table.first.tolist()
        for a, b in zip(first, first[1:]):
            if b - a >= words:
                out.append(np.unique(whole[a : b - words + 1]))
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for j in range(a, b):
                    one = scramble(one * _MIX + word[j : j + 1])
                out.append(one.view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
        start = stop
    return out


@functools.lru_cache(maxsize=64)
def least_overlap(k, share, miss=MISS):
    """The most retained values that two sketches of ``k`` values have in common but
    for a chance of ``miss``, if the sets are larger than that and as similar as
    ``share``: of the ``k`` least values of the union, each is in both with that chance."""
    p = share[0] / share[1]
    held = 0.0
    for t in range(k + 1):
        log = math.lgamma(k + 1) - math.lgamma(t + 1) - math.lgamma(k - t + 1)
        held += math.exp(log + t * math.log(p) + (k - t) * math.log1p(-p)) if p < 1 else float(t == k)
        if held > miss:
            return t
    return k


def _asked(k, share):
    """Column: the retained values that a document of ``n`` shingles must share with
    any as similar as ``share``.  Small sets are retained whole and this is exact."""
    return F.least(F.ceil(F.col("n") * share[0] / share[1]), F.lit(least_overlap(k, share))).cast("long")


def sketches(rows, words, k=NARROW):
    """``rows`` with ``node``, which stands for the set (null if it is empty), its
    size ``n`` and its ``k`` least values ``kept`` in place of the text.  No shuffle."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), words)
            node = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in others),
                    pa.array(node, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    _lists([s[:k] for s in sets]),
                ],
                names=[*others, "node", "n", "kept"],
            )

    kinds = dict(rows.dtypes)
    made = [("node", "long"), ("n", "long"), ("kept", "array<long>")]
    return rows.mapInArrow(run, numbered([(c, kinds[c]) for c in others] + made))


def _lists(arrays):
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _overlaps(sketched):
    """``(value, node, n, df)``: the inverted lists of at least two documents, with the
    length of each.  Lengths are counted before the shuffle; a long list may be split."""
    values = sketched.select(F.explode("kept").alias("value"), "node", "n")
    met = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return values.join(met, "value")


def _can_overlap(sketched, k, share):
    """Nodes that share as many values with others as a similar pair must."""
    shared = _overlaps(sketched).groupBy("node").agg(F.count(F.lit(1)).alias("s"), F.first("n").alias("n"))
    return shared.where(F.col("s") >= _asked(k, share)).select("node")


def _rarest(sketched, k, share):
    """``(value, node)``: of the values that a node shares with others, the rarest, so
    many that a similar pair has one of them in common.  With at least ``t`` of ``s``
    in common, that holds for the first ``s - t + 1`` of each in any common order; the
    rarest first keep what very many documents share out of the lists."""
    mine = F.array_sort(F.collect_list(F.struct("df", "value")))
    nodes = _overlaps(sketched).groupBy("node").agg(mine.alias("mine"), F.first("n").alias("n"))
    spare = F.size("mine") - _asked(k, share) + 1
    rows = nodes.where(spare > 0).select("node", F.explode(F.slice("mine", 1, spare.cast("int"))).alias("v"))
    return rows.select("v.value", "node")


def _stars(lists):
    """Edges that connect the nodes of each list: its least node with the others."""
    least = lists.groupBy("value").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    met = lists.join(least.select("value", "a"), "value")
    return met.where("a != node").select("a", F.col("node").alias("b")).distinct()


class _Tile:
    """Whole sets of one tile, as codes of their values."""

    def __init__(self, nodes, sets, share, k=NARROW):
        self.nodes, self.share, self.k = nodes, share, k
        self.size = np.array([len(s) for s in sets])
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        # Codes keep the order of the values.
        self.values, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(self.values), bool)
        self.rank = np.zeros(len(self.values), np.int64)
        self.asked = least_overlap(k, share)

    def _gather(self, left, width):
        """Codes of the ``width`` least values of each of ``left``, and their places."""
        size = np.minimum(self.size[left], width)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(size.sum()) - np.repeat(starts, size)
        return self.code[np.repeat(self.at[left], size) + place], starts, place, size

    def linked(self, x, left):
        """Which of the sets ``left`` are as similar to ``x`` as asked."""
        num, den = self.share
        n = self.size[x]
        out = np.zeros(len(left), bool)
        fits = np.flatnonzero(den * np.minimum(self.size[left], n) >= num * np.maximum(self.size[left], n))
        if not len(fits):
            return out
        mine = self.code[self.at[x] : self.at[x + 1]]
        # The k least values of the union: those in both, by their place in it.
        self.mark[mine[: self.k]] = True
        self.rank[mine[: self.k]] = np.arange(min(n, self.k))
        code, starts, place, size = self._gather(left[fits], self.k)
        both = self.mark[code]
        before = np.cumsum(both)
        before -= np.repeat(before[starts] - both[starts], size)  # in this set, up to here
        in_union = both & (self.rank[code] + place + 2 - before <= self.k)
        found = np.add.reduceat(in_union.astype(np.int64), starts)
        self.mark[mine[: self.k]] = False
        asked = np.minimum(-(-num * np.maximum(self.size[left[fits]], n) // den), self.asked)
        fits = fits[found >= asked]
        if len(fits):
            self.mark[mine] = True
            code, starts, _, size = self._gather(left[fits], np.iinfo(np.int64).max)
            both = np.add.reduceat(self.mark[code].astype(np.int64), starts)
            self.mark[mine] = False
            out[fits] = den * both >= num * (n + size - both)
        return out

    def forest(self):
        """Edges that connect what links connect: n - 1 for n connected sets.  A set
        is compared with those that are not yet in its group."""
        left = np.arange(len(self.nodes))
        out = []
        while len(left):
            group, left = [left[0]], left[1:]
            while group and len(left):
                x = group.pop()
                hit = self.linked(x, left)
                new = left[hit]
                out.extend((self.nodes[x], self.nodes[y]) for y in new)
                group.extend(new.tolist())
                left = left[~hit]
        return out


def _tiles(groups, sets):
    """``(tile, node)``: every group in one tile, or if its sets are too many in one
    for each two of its blocks, so that any two sets of a group meet in a tile."""
    sized = groups.join(sets.select("node", "n"), "node")
    blocks = sized.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = groups.join(blocks, "group").select("group", "node", own.alias("own"), other)
    return dealt.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "node")


def _edges(tiles, sets, share):
    """Exact links between the sets of each tile, as a forest."""

    def settle(held):
        nodes = [n for _, n, _ in held]
        found = _Tile(nodes, [s for _, _, s in held], share).forest()
        a, b = (pa.array([e[i] for e in found], pa.int64()) for i in (0, 1))
        return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    def run(batches):
        held = []
        for (tile,), part in runs(batches, ["tile"]):
            if held and held[0][0] != tile:
                yield settle(held)
                held = []
            values = part.column("values").to_pylist()
            held += [(tile, n, np.frombuffer(v, np.int64)) for n, v in zip(part.column("node").to_pylist(), values)]
        if held:
            yield settle(held)

    met = tiles.join(sets.select("node", "values"), "node")
    dealt = met.repartition("tile").sortWithinPartitions("tile", "node")
    return materialise(dealt.mapInArrow(run, "a long, b long").distinct(), "similar")


def whole_sets(docs, chosen, words, text_col="text"):
    """``(node, n, kept, values)``: the whole sets of the documents whose two keys
    (columns of ``docs``) are in ``chosen``, with their wide sketches."""

    def run(batches):
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column("text"), words) if len(s)]
            node = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            values = pa.array([s.tobytes() for s in sets], pa.binary())
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), size, _lists([s[:WIDE] for s in sets]), values],
                names=["node", "n", "kept", "values"],
            )

    rows = semi(docs.select("k1", "k2", F.col(text_col).alias("text")), chosen).select("text")
    made = rows.mapInArrow(run, "node long, n long, kept array<long>, values binary")
    return materialise(made.dropDuplicates(["node"]), "shingle-sets")


def roots(marked, rows, words, share, extra=None):
    """``(node, root)`` of the nodes that pairs as similar as ``share`` connect.

    ``marked`` has the keys, ``node``, ``n`` and ``kept`` of each row, ``rows`` the
    keys and the ``text``; ``extra`` are edges between nodes that are tested as well.

    1. Inverted lists of narrow sketches keep the nodes that can have a partner.
    2. Lists of their wide sketches, cut to the rarest values, say who may be similar
       to whom; nodes that such lists connect are a cell.
    3. Any two sets of a cell meet in a tile.  There the sketch of their union and then
       the whole sets tell whether they are linked.
    """
    nodes = marked.where("node IS NOT NULL").groupBy("node").agg(
        F.first("n").alias("n"), F.first("kept").alias("kept"), F.min(F.struct("k1", "k2")).alias("key")
    )
    nodes = materialise(nodes, "nodes")
    wanted = _can_overlap(nodes, NARROW, share)
    if extra is not None:
        wanted = wanted.union(extra.select("a")).union(extra.select("b")).distinct()
    chosen = nodes.select("node", "key.k1", "key.k2").join(wanted, "node", "left_semi")
    sets = whole_sets(rows, chosen, words)
    lists = materialise(_rarest(sets.select("node", "n", "kept"), WIDE, share), "lists")
    meet = _stars(lists)
    cells = components(meet if extra is None else meet.union(extra)).select("node", F.col("root").alias("group"))
    cells = materialise(cells, "cells")
    large = cells.join(sets.select("node", "n"), "node").groupBy("group").agg(F.sum("n").alias("held"))
    large = large.where(F.col("held") > CELL_BLOCKS * BLOCK).select("group")
    wide = cells.join(large, "group", "left_semi").select("node")
    groups = cells.join(large, "group", "left_anti").select("group", "node")
    groups = groups.union(lists.select(F.col("value").alias("group"), "node").join(wide, "node", "left_semi").select("group", "node"))
    if extra is not None:
        pair = F.explode(F.array("a", "b")).alias("node")
        both = extra.select(F.xxhash64("a", "b").alias("group"), pair).join(wide, "node", "left_semi")
        groups = groups.union(both.select("group", "node"))
    return components(_edges(_tiles(groups, sets), sets, share))


def near_duplicates(docs, id_col="doc_id", text_col="text", words=4, share=(4, 5)):
    """Near-duplicate groups: ``id_col``, ``n_shingles`` (distinct runs of ``words``
    words), ``component_id``, the smallest id that pairs of a Jaccard index of at least
    ``share`` (two whole numbers) reach, and ``kept``, whether that is the row's own.

    A-Z count as a-z, words are runs of characters other than white space, and a text
    of fewer words than ``words`` is one shingle.  A text without words and a null text
    have no shingle and are linked with nothing, not even with each other.  Documents of
    equal sets are one node, so copies are never paired.  No pair of other texts is
    written but n - 1 for n connected ones.

    Sets of at most ``WIDE`` shingles are never missed; of larger ones a pair exactly
    at ``share`` is missed with a chance of 1e-9 a round (``MISS``), any closer one with
    less.  Every link is checked on whole sets of 64-bit hashes.

    A null id is never the smallest unless its group has no other; then ``component_id``
    is null and the row is kept.  Repeated rows each come back; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    rows = keyed(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "id", "text")
    marked = materialise(sketches(rows, words), "sketches")
    found = roots(marked, rows, words, share)
    low = marked.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("low"))
    rooted = low.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("low").alias("least"))
    named = marked.join(rooted.join(least, "root").select("node", "least"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least"))
    return named.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
