"""How the sources of each language differ in their words.

Words are counted by Arrow kernels inside the tasks; the merged counts are dealt into
shards of terms, each of which adds up its part of every divergence.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairscreen.llm.shared import numbered
from pairscreen.operators.arrow_runs import runs
from pairscreen.session import materialise

#: What separates terms: all ASCII but letters (fixed by the contract).
_GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text split at once, and rows of counts that a task holds before it emits.
SLICE, HELD = 2 << 20, 1 << 18
#: Sources of one block: a tile holds a matrix of sums over two of them.
SOURCES = 1_024
#: Counts of one shard; more if a language has so many sources that their pairs are more.
SHARD_ROWS = 1 << 15
#: Entries of the matrix of terms by sources that are worked on at once.
ENTRIES = 1 << 19
#: p-values are whole multiples of 1 / ONE.
ONE, PRIOR = 1_000_000_000, 5

_COUNTS = [("lang", "string"), ("source", "string"), ("term", "string"), ("times", "long"), ("docs", "long")]


def _slice_counts(batch):
    """Counts of one slice: (lang, source, term), occurrences and documents.  A term
    of '' stands for the group itself, which may have none."""
    lang, source = (pc.fill_null(batch.column(c), "") for c in ("lang", "source"))
    text = pc.ascii_lower(pc.fill_null(batch.column("text"), ""))
    split = pc.split_pattern_regex(text, _GAP)
    row, term = pc.list_parent_indices(split), pc.list_flatten(split)
    real = pc.not_equal(term, "")
    words = pa.table({"row": row.filter(real), "term": term.filter(real).dictionary_encode()})
    by_row = words.group_by(["row", "term"]).aggregate([([], "count_all")])
    found = pa.table(
        {
            "lang": pc.take(lang, by_row["row"]),
            "source": pc.take(source, by_row["row"]),
            "term": by_row["term"].cast(pa.string()),
            "times": by_row["count_all"],
            "docs": pa.array(np.ones(by_row.num_rows, np.int64)),
        }
    )
    zero = pa.array(np.zeros(batch.num_rows, np.int64))
    groups = pa.table({"lang": lang, "source": source, "term": pa.array([""] * batch.num_rows, pa.string()), "times": zero, "docs": zero})
    return _merged([found, groups])


def _merged(tables):
    whole = pa.concat_tables(tables)
    found = whole.group_by(["lang", "source", "term"]).aggregate([("times", "sum"), ("docs", "sum")])
    return found.select(["lang", "source", "term", "times_sum", "docs_sum"]).rename_columns([c for c, _ in _COUNTS])


def _slices(batch):
    """Parts of a batch of about ``SLICE`` bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def term_counts(docs, text_col="text", lang_col="lang", source_col="source"):
    """``(lang, source, term, times, docs)``: occurrences of each term in a group, and
    the documents that have it.  Every group has a row with the term '', too."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for part in _slices(batch):
                held.append(_slice_counts(part))
                rows += held[-1].num_rows
                if rows > HELD:
                    held = [_merged(held)]
                    rows = held[0].num_rows
                    if rows > HELD // 2:
                        yield from held[0].combine_chunks().to_batches()
                        held, rows = [], 0
                        pa.default_memory_pool().release_unused()
        if held:
            yield from _merged(held).combine_chunks().to_batches()
        del held
        pa.default_memory_pool().release_unused()  # the worker stays, for other tasks

    rows = docs.select(*(docs[c].cast("string").alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    partial = rows.mapInArrow(run, numbered(_COUNTS))
    return partial.groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))


def share(times, total, terms):
    """``1 + floor(ONE * (times + PRIOR) / (total + PRIOR * terms))``, exactly."""
    above, below = times + PRIOR, total + PRIOR * terms
    largest = max(int(np.max(above, initial=0)), int(np.max(below, initial=0)))
    if largest < (1 << 63) // ONE:
        return 1 + ONE * above // below
    return 1 + (ONE * above.astype(object) // np.asarray(below).astype(object)).astype(np.int64)


class _Shard:
    """One tile: the terms of a shard against the sources of two blocks."""

    def __init__(self, key, top):
        self.lang, self.shard, self.low, self.high = key
        self.top = top
        self.sources, self.block, self.total = [], [], []
        self.terms = 0
        self.open = None
        self.best = {}

    def group(self, source, block, total, terms):
        """Sources come before the counts."""
        self.sources.append(source)
        self.block.append(block)
        self.total.append(total)
        self.terms = terms

    def _ready(self):
        order = np.argsort(self.block, kind="stable")
        self.sources = [self.sources[i] for i in order]
        self.block = np.array(self.block, np.int64)[order]
        self.total = np.array(self.total, np.int64)[order]
        self.place = {s: i for i, s in enumerate(self.sources)}
        self.sums = np.zeros((len(self.sources), len(self.sources)), np.int64)
        self.most = max(1, ENTRIES // len(self.sources))
        self.open = ([], [], [])
        self.column = {}

    def counts(self, terms, sources, times, lang_times, lang_total):
        if self.open is None:
            self._ready()
        self.lang_total = lang_total
        for term, source, n, all_n in zip(terms, sources, times, lang_times):
            if term not in self.column and len(self.column) >= self.most:
                self._flush()
            self.column.setdefault(term, (len(self.column), all_n))
            for held, x in zip(self.open, (self.place[source], self.column[term][0], n)):
                held.append(x)

    def _flush(self):
        if not self.column:
            return
        times = np.zeros((len(self.sources), len(self.column)), np.int64)
        times[self.open[0], self.open[1]] = self.open[2]
        p = share(times, self.total[:, None], self.terms)
        for i in range(len(p) - 1):
            self.sums[i, i + 1 :] += np.abs(p[i + 1 :] - p[i]).sum(axis=1)
        if self.low == self.high:
            q = share(np.array([n for _, n in self.column.values()], np.int64), np.int64(self.lang_total), self.terms)
            over = np.where((times > 0) & (p > q), p - q, 0)
            names = np.array(list(self.column), object)
            for i, s in enumerate(self.sources):
                at = np.flatnonzero(over[i])
                if len(at) > self.top:  # all that tie with the last one stay
                    least = np.partition(over[i, at], len(at) - self.top)[len(at) - self.top]
                    at = at[over[i, at] >= least]
                found = self.best.get(s, []) + list(zip((-over[i, at]).tolist(), names[at]))
                self.best[s] = sorted(found)[: self.top]
        self.open, self.column = ([], [], []), {}

    def rows(self):
        """(lang, source, part, item, value); pairs once, from the smaller place."""
        if self.open is None:
            self._ready()
        self._flush()
        for i, j in zip(*np.triu_indices(len(self.sources), 1)):
            if self.low == self.high or self.block[i] != self.block[j]:
                if self.sums[i, j] or self.shard == 0:
                    yield self.lang, self.sources[i], "pair", self.sources[j], int(self.sums[i, j])
        for s, found in self.best.items():
            for value, term in found:
                yield self.lang, s, "term", term, -value


_OUT = [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "long")]


def _shard_sums(tiles, top):
    """Partial divergences and the foremost terms of each tile."""
    key = ["lang", "shard", "low", "high"]

    def batch(rows):
        rows = list(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64() if kind == "long" else pa.string()) for i, (_, kind) in enumerate(_OUT)],
            names=[c for c, _ in _OUT],
        )

    def run(batches):
        now = None
        for found, part in runs(batches, [*key, "head"]):
            if now is None or found[:4] != (now.lang, now.shard, now.low, now.high):
                if now is not None:
                    yield batch(now.rows())
                now = _Shard(found[:4], top)
            cols = {c: part.column(c).to_pylist() for c in ("source", "block", "total", "terms", "term", "times", "lang_times", "lang_total")}
            if found[4] == 0:
                for row in zip(cols["source"], cols["block"], cols["total"], cols["terms"]):
                    now.group(*row)
            else:
                now.counts(cols["term"], cols["source"], cols["times"], cols["lang_times"], cols["lang_total"][0])
        if now is not None:
            yield batch(now.rows())

    dealt = tiles.repartition(*key).sortWithinPartitions(*key, "head", "term", "source")
    return dealt.mapInArrow(run, numbered(_OUT))


def divergences(docs, text_col="text", lang_col="lang", source_col="source", least_docs=30, top=50):
    """For each source of each language: how far it is from every other one (``part``
    ``pair``), and the terms that it has more of than the language (``term``, the first
    ``top``).  Columns ``lang source part item value rank``; rank 1 has the largest
    value, equal values go by item.

    A term is a run of letters A-Z, lower-cased, and of any characters beyond ASCII.  A
    language keeps the terms that at least ``least_docs`` of its documents have.  Shares
    ``p`` are whole numbers, smoothed and rounded down (see ``share``); a pair's value
    is the sum of ``|p - q|`` over all kept terms, a term's is ``p - q``.  All sums are
    over all documents and exact.

    Null texts, languages and sources are read as ''.  A group without kept terms, or
    without any, still has its pairs (0 if the language keeps none).  Repeated rows are
    documents of their own; an empty table gives no rows; other columns are ignored.
    """
    counts = materialise(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    by_lang = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("lang_times"))
    kept = by_lang.where(F.col("docs") >= least_docs).select("lang", "term", "lang_times")
    kept = materialise(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "times", "lang_times"), "kept-terms")
    size = kept.groupBy("lang").agg(F.sum("times").alias("lang_total"), F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("rows"))
    total = kept.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(total, ["lang", "source"], "left").join(size, "lang", "left")
    counted = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("all_rows"))
    shards = F.ceil(F.coalesce("all_rows", F.lit(1)) / F.greatest(F.lit(SHARD_ROWS), F.col("n") * F.col("n"))).cast("int")
    counted = counted.select("lang", F.ceil(F.col("n") / SOURCES).cast("int").alias("blocks"), shards.alias("shards"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    groups = groups.join(counted, "lang").select("*", block).drop("rows").fillna(0, ["total", "terms", "lang_total"])
    heads = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    heads = heads.select("*", F.lit(0).alias("head"), F.lit("").alias("term"), F.lit(0).cast("long").alias("times"), F.lit(0).cast("long").alias("lang_times"))
    own = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard")
    body = kept.join(groups, ["lang", "source"]).select("*", own, F.lit(1).alias("head"))
    tiles = heads.unionByName(body).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    sums = materialise(_shard_sums(tiles, top), "divergences")
    half = sums.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = half.unionByName(turned).withColumn("part", F.lit("pair"))
    terms = sums.where("part = 'term'")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(terms).withColumn("rank", F.row_number().over(order))
    ranked = ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
