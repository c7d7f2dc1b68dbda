"""Benchmark decontamination by a hash table of test windows.

Every window of a benchmark item is kept under its longest word.  A scan explodes
the words of the documents, looks each up in the table, and compares the whole
window around a hit: long words are rare, so few places are compared.
DataFrame functions only.
"""

from pyspark.sql import functions as F

from pairscreen.llm.shared import ascii_lower

#: What separates words, after A-Z have become a-z; and words with A-Z still there.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: A table of windows above this many bytes is joined by a shuffle instead.
BROADCAST_BYTES = 64 << 20

#: Stands behind the words of each document, so that one without any hit has a row.
_END = ""


def words(col):
    return F.array_remove(F.split(ascii_lower(F.coalesce(col, F.lit(""))), WORD_GAP, -1), _END)


def windows(benchmark, size=13, item_col="item_id", text_col="text"):
    """Distinct windows with their items: ``anchor`` (the longest word, the first
    of several), its ``offset``, ``width``, ``window`` (joined words), ``items``."""
    items = benchmark.select(
        F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item"),
        words(benchmark[text_col]).alias("words"),
    ).where(F.size("words") > 0)
    width = F.least(F.lit(size), F.size("words"))
    cut = items.select(
        "item", "words", width.alias("width"), F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("at")
    ).select("item", "width", F.slice("words", F.col("at") + 1, F.col("width")).alias("words"))
    longest = F.array_max(F.transform("words", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("back"))))
    placed = cut.select("item", "width", "words", (-longest["back"]).alias("offset"))
    return (
        placed.select(
            "item",
            "width",
            "offset",
            F.element_at("words", F.col("offset") + 1).alias("anchor"),
            F.array_join("words", " ").alias("window"),
        )
        .groupBy("anchor", "offset", "width", "window")
        .agg(F.collect_set("item").alias("items"))
    )


def _covered(spans):
    """Number of words under spans that may overlap."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], s["stop"]).alias("end"),
        ),
        lambda a: a["n"],
    )


def contamination(
    docs, benchmark, size=13, id_col="doc_id", text_col="text", item_col="item_id", item_text="text",
    min_share=0.05, broadcast_bytes=BROADCAST_BYTES,
):
    """What of each document is in the benchmark: ``id_col``, ``text_hash``,
    ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``items``
    (sorted ids, as strings), ``spans`` (hit windows as word ranges) and
    ``contaminated`` (a hit, and at least ``min_share`` of the words hit).

    An item of fewer words than ``size``, but not none, is one window.  The table
    of windows is broadcast up to ``broadcast_bytes``, measured beforehand, and
    shuffled beyond; every word and window is looked at either way.

    A null text has no words and is clean.  A null item id counts as the empty
    string.  Null document ids form no group with others unless the text is equal
    too; repeated rows each come back.  Without documents or items there are no
    rows, or no hits.  Other columns are ignored.
    """
    table = windows(benchmark, size, item_col, item_text)
    held = table.agg(F.sum(F.octet_length("window") + F.octet_length("anchor") + 64)).first()[0] or 0
    spark = docs.sparkSession
    end = spark.range(1).select(
        F.lit(_END).alias("anchor"), F.lit(0).alias("offset"), F.lit(0).alias("width"),
        F.lit("").alias("window"), F.array().cast("array<string>").alias("items"),
    )
    table = table.union(end)
    small = held <= broadcast_bytes
    if small:
        table = F.broadcast(table)
    text = docs[text_col]
    cut = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("text_hash"), words(text).alias("words"))
    each = cut.select(
        "id", "text_hash", "words", F.size("words").alias("n"),
        F.posexplode(F.concat("words", F.array(F.lit(_END)))).alias("pos", "word"),
    )
    from_ = F.lit(0)
    if not small:  # a shuffled word takes along its surroundings, not the whole text
        from_ = F.greatest(F.col("pos") - (size - 1), F.lit(0))
        each = each.withColumn("words", F.slice("words", from_ + 1, F.lit(2 * size - 1)))
    first = F.col("pos") - F.col("offset")
    inside = (first >= 0) & (first + F.col("width") <= F.col("n"))
    same = F.array_join(F.slice("words", F.greatest(first - from_ + 1, F.lit(1)), F.col("width")), " ") == F.col("window")
    at_end = F.col("anchor") == _END
    hits = each.join(table, (F.col("word") == F.col("anchor")) & (at_end | (inside & same)))
    span = F.when(~at_end, F.struct(first.alias("start"), (first + F.col("width")).alias("stop")))
    found = hits.groupBy("id", "text_hash").agg(
        F.count(F.when(at_end, 1)).alias("copies"),
        F.max("n").alias("n_words"),
        F.collect_set(span).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    counted = found.select("*", _covered(F.col("spans")).alias("n_hit"))
    share = F.col("n_hit") >= F.col("n_words") * F.lit(min_share)
    if min_share == 0.05:
        share = F.col("n_hit") * 20 >= F.col("n_words")  # the same in whole numbers
    rows = counted.select(
        F.col("id").alias(id_col),
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        "items",
        F.array_sort("spans").alias("spans"),
        ((F.col("n_hit") > 0) & share).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"),
    )
    return rows.drop("__copy")


def without_spans(text, spans, gap=CASED_WORD):
    """A text without its hit words and what stands behind each of them, up to the
    next word."""
    found = F.regexp_extract_all(text, F.lit(gap), F.lit(0))
    gaps = F.split(text, gap, -1)
    zipped = F.zip_with(found, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda w, g: F.concat(w, g))
    kept = F.filter(zipped, lambda _, i: ~F.exists(spans, lambda s: (s["start"] <= i) & (i < s["stop"])))
    return F.concat(gaps[0], F.array_join(kept, ""))


def remove_contaminated(docs, benchmark, mode="document", id_col="doc_id", text_col="text", **rule):
    """``docs`` without contaminated documents, or, with ``mode="span"``, with the
    hit words cut out of them.  All columns are kept; clean rows stay as they are.
    Only the rows to change are grouped and joined back, by id and text."""
    if mode not in ("document", "span"):
        raise ValueError(f"no mode {mode!r}")
    bad = (
        contamination(docs, benchmark, id_col=id_col, text_col=text_col, **rule)
        .where("contaminated")
        .select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
        .dropDuplicates(["__id", "__hash"])
    )
    same = docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text_col]) == bad["__hash"])
    if mode == "document":
        return docs.join(bad, same, "left_anti")
    cut = F.when(F.col("__spans").isNotNull(), without_spans(docs[text_col], F.col("__spans"))).otherwise(docs[text_col])
    others = [cut.alias(c) if c == text_col else docs[c] for c in docs.columns]
    return docs.join(bad, same, "left").select(*others)
