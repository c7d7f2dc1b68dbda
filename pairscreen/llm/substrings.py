"""Removal of passages that another document has already: matching statistics
against suffix automata of reference shards.

To stream every document past the automata of all shards would be work in the
square of the corpus.  So the corpus is cut by content: each window of words has an
anchor, the five-word run in it with the least hash, and all windows of one anchor
meet in one shard.  A shard has an automaton over its different segments (the
windows of one place of an anchor), and the segments are streamed past it.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import functions as F

from pairscreen.llm.shared import bytes_of, numbered
from pairscreen.llm.suffix_automaton import SuffixAutomaton
from pairscreen.llm.word_table import WordTable, scramble
from pairscreen.session import materialise

#: Words of an anchor.
_GRAM = 5
#: Bytes of text that a task works on at once, and of packed text.
_BYTES = 4 << 20
_PACKED = 1 << 20
#: Places of one anchor that a task keeps until it knows all of its segments.
HOLD = 65_536


def _slices(batch, name="text", size=_BYTES):
    """Cut a batch into runs of rows of bounded size."""
    _, rows = bytes_of(batch.column(name))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(rows, rows[at] + size, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def _packed(docs):
    """``(id, hash, packed)``: texts travel compressed, which halves what is shuffled."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [press.compress(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hash"), pa.array(packed, pa.binary())], names=["id", "hash", "packed"]
            )

    rows = docs.select("id", F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(run, "id long, hash long, packed binary")


def _opened(batches):
    """Bounded runs of rows with their word table."""
    press = zstandard.ZstdDecompressor()
    for whole in batches:
        for batch in _slices(whole, "packed", _PACKED):
            plain = pa.array([press.decompress(p) for p in batch.column("packed").to_pylist()], pa.large_binary())
            yield batch, WordTable(*bytes_of(plain))


def segments(table, size):
    """Segments of a batch of texts: maximal runs of windows with one place as
    anchor.  Arrays: anchor hash, first window (a word number), windows."""
    h = table.hashes()
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    gram = scramble(h[:-2] * one + h[1:-1] * two + h[2:])
    row = table.row
    windows = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
    view = np.lib.stride_tricks.sliding_window_view(gram, size - _GRAM + 1)
    place = windows + view[windows].argmin(axis=1)
    if not len(place):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)])
    starts = np.flatnonzero(new)
    counts = np.diff(np.concatenate([starts, [len(place)]]))
    return gram[place[starts]], windows[starts], counts


def _anchors(docs, size):
    """``(anchor, id)`` of every segment, once per document."""

    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                table = WordTable(*bytes_of(batch.column("text")))
                anchor, first, _ = segments(table, size)
                pairs = np.unique(np.stack([table.row[first].astype(np.uint64), anchor], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pairs[:, 1].copy().view(np.int64)),
                        batch.column("id").take(pa.array(pairs[:, 0].astype(np.int64))),
                    ],
                    names=["anchor", "id"],
                )

    return docs.mapInArrow(run, "anchor long, id long")


def _shared(batches):
    """Rows sorted by anchor and id to those of anchors with more than one id.
    Only the last anchor's first id is kept over a batch."""
    held = None  # (anchor, id) seen once, not passed on yet
    passing = None  # anchor whose rows are passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        if held is not None:
            anchor, ids = np.concatenate([[held[0]], anchor]), np.concatenate([[held[1]], ids])
        bounds = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
        low, high = ids[bounds[:-1]], ids[bounds[1:] - 1]
        keep = (low != high) | (anchor[bounds[:-1]] == passing if passing is not None else False)
        mask = np.repeat(keep, np.diff(bounds))
        held = None if keep[-1] else (anchor[-1], ids[-1])
        passing = anchor[-1] if keep[-1] else None
        if mask.any():
            yield pa.RecordBatch.from_arrays([pa.array(anchor[mask]), pa.array(ids[mask])], names=["anchor", "id"])


def _cut_segments(size):
    """Task over documents with the anchors that others share (``anchors``): their
    segments with these anchors, as text."""

    def run(batches):
        for batch, table in _opened(batches):
            anchor, first, count = segments(table, size)
            row = table.row[first]
            listed = batch.column("anchors")
            owner = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
            wanted = listed.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            key = scramble(anchor + row.astype(np.uint64))
            use = np.isin(key, scramble(wanted + owner.astype(np.uint64)))
            anchor, first, count, row = anchor[use], first[use], count[use], row[use]
            table.normalise()
            clean = table.clean.tobytes()
            begin = table.at[first].tolist()
            end = (table.at[first + count + size - 1] - 1).tolist()
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)),
                    batch.column("id").take(take),
                    batch.column("hash").take(take),
                    pa.array((first - table.first[row]).astype(np.int32)),
                    pa.array([clean[b:e] for b, e in zip(begin, end)], pa.binary()),
                ],
                names=["anchor", "id", "hash", "at", "segment"],
            )

    return run


_FOUND = pa.schema(
    [
        ("kind", pa.int8()),
        ("anchor", pa.int64()),
        ("number", pa.int32()),
        ("id", pa.int64()),
        ("hash", pa.int64()),
        ("at", pa.int32()),
        ("mask", pa.int32()),
        ("least", pa.list_(pa.int64())),
    ]
)
_FOUND_DDL = "kind tinyint, anchor long, number int, id long, hash long, at int, mask int, least array<long>"


def _least_owners(texts, size):
    """Per segment, for each of its windows, the least id of a segment that has it.
    ``texts`` are different segments with the least id of each."""
    if len(texts) == 1:  # all of it matches itself
        return [[texts[0][1]] * (texts[0][0].count(b" ") + 2 - size)]
    automaton = SuffixAutomaton()
    split = [segment.split(b" ") for segment, _ in texts]
    for i in sorted(range(len(texts)), key=lambda i: texts[i][1]):
        automaton.add(split[i], texts[i][1])
    return [automaton.least_marks(words, size) for words in split]


def _against_shard(size, hold):
    """Task over segments sorted by anchor, text and id, which streams each anchor's
    places and keeps its different segments.

    Kind 0: a place whose document loses windows, with their bits in ``mask``.  An
    anchor with more than ``hold`` places gives them as they come (kind 1) and its
    segments with their least owners behind them (kind 2), to be joined.
    """

    def finish(anchor, texts, places, over, out):
        if not texts or not over and places[0][1] == places[-1][1] and len({p[1] for p in places}) == 1:
            return
        least = _least_owners(texts, size)
        if over:
            out += [(1, anchor, n, i, h, a, None, None) for n, i, h, a in places]
            out += [(2, anchor, n, None, None, None, None, m) for n, m in enumerate(least)]
            return
        bounds = [(min(m), max(m)) for m in least]
        for n, i, h, a in places:
            low, high = bounds[n]
            if low >= i:
                continue
            marks = least[n]
            mask = (1 << len(marks)) - 1 if high < i else sum((m < i) << j for j, m in enumerate(marks))
            out.append((0, None, None, i, h, a, mask, None))

    def pack(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)

    def run(batches):
        now, texts, places, over, out = None, [], [], False, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "segment", "id", "hash", "at")]
            for anchor, segment, i, h, a in zip(*columns):
                if anchor != now:
                    finish(now, texts, places, over, out)
                    now, texts, places, over = anchor, [], [], False
                if not texts or texts[-1][0] != segment:
                    texts.append((segment, i))
                places.append((len(texts) - 1, i, h, a))
                if len(places) > hold:
                    over = True
                    out += [(1, anchor, n, i, h, a, None, None) for n, i, h, a in places]
                    places = []
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)
                out = []
        finish(now, texts, places, over, out)
        if out:
            yield pack(out)

    return run


def repeated_spans(docs, size=13, id_col="doc_id", text_col="text", hold=HOLD):
    """Where documents repeat others: ``id``, ``hash`` (of the text), ``spans``, an
    array of (at, mask): a word number, and which of the windows from there on
    another document with a smaller id has.  Documents without any have no row."""
    if size < _GRAM or size > 32:
        raise ValueError(f"windows have {_GRAM} to 32 words")
    base = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    known = base.where(F.col("id").isNotNull())
    pairs = _anchors(known, size).repartition("anchor").sortWithinPartitions("anchor", "id")
    shared = pairs.mapInArrow(_shared, "anchor long, id long")
    wanted = shared.groupBy("id").agg(F.collect_list("anchor").alias("anchors"))
    cut = _packed(known).join(wanted, "id").mapInArrow(
        _cut_segments(size), "anchor long, id long, hash long, at int, segment binary"
    )
    shards = cut.repartition("anchor").sortWithinPartitions("anchor", "segment", "id")
    found = materialise(shards.mapInArrow(_against_shard(size, hold), _FOUND_DDL), "repeats")
    hot = found.where("kind = 1").select("anchor", "number", "id", "hash", "at")
    hot = hot.join(found.where("kind = 2").select("anchor", "number", "least"), ["anchor", "number"])
    bits = F.transform("least", lambda m, j: F.when(m < F.col("id"), F.call_function("shiftleft", F.lit(1), j)).otherwise(0))
    mask = F.aggregate(bits, F.lit(0), lambda a, b: a.bitwiseOR(b))
    hot = hot.select("id", "hash", "at", mask.alias("mask")).where("mask != 0")
    hits = found.where("kind = 0").select("id", "hash", "at", "mask").union(hot)
    return hits.groupBy("id", "hash").agg(F.collect_list(F.struct("at", "mask")).alias("spans"))


def _kept(size):
    """Task that takes the removed words out of whole texts."""

    def run(batches):
        for batch, table in _opened(batches):
            table.normalise()
            change = np.zeros(len(table) + size + 1, np.int64)
            spans = batch.column("spans")
            flat = spans.flatten()
            if len(flat):
                lengths = pc.fill_null(spans.value_lengths(), 0).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(batch.num_rows), lengths)
                first = table.first[owner] + flat.field("at").to_numpy(zero_copy_only=False)
                mask = flat.field("mask").to_numpy(zero_copy_only=False)
                place, bit = np.nonzero((mask[:, None] >> np.arange(size)) & 1)
                gone = first[place] + bit
                np.add.at(change, gone, 1)
                np.add.at(change, gone + size, -1)
            removed = np.cumsum(change)[: len(table)] > 0
            # Byte by byte: a word goes with the space behind it.
            width = np.diff(table.at)
            left = table.clean[np.repeat(~removed, width)].tobytes()
            bounds = np.concatenate([[0], np.cumsum(np.where(removed, 0, width))])[table.first].tolist()
            texts = [left[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1], bounds[1:])]
            count = np.concatenate([[0], np.cumsum(removed)])[table.first]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(table.first)), pa.array(np.diff(count)), pa.array(texts, pa.string())],
                names=["id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeats(docs, size=13, id_col="doc_id", text_col="text", hold=HOLD):
    """Whole texts without the passages that a document with a smaller id has too:
    ``id_col``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one
    space).

    A window is ``size`` consecutive words; a word goes if it is in a window whose
    words also stand in a document with a smaller id.  Windows are those of the
    input, whatever else goes.  Words are runs of characters other than space and
    9 to 13.

    A null text has no words.  Rows with one id never repeat each other; a row
    without id neither loses words nor makes others lose theirs.  An empty table
    gives no rows, repeated rows each come back, other columns are ignored.  Ids are
    whole numbers.
    """
    base = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    spans = repeated_spans(docs, size, id_col, text_col, hold)
    rows = _packed(base).join(spans, ["id", "hash"], "left").select("id", "packed", "spans")
    schema = numbered([("id", "long"), ("n_words", "long"), ("n_removed", "long"), ("kept", "string")])
    return rows.mapInArrow(_kept(size), schema).withColumnRenamed("id", id_col)
