"""Languages of texts as a mixture: expectation maximisation over n-grams."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairscreen.llm.shared import by_bytes, numbered, texts

#: Bytes of an n-gram, and the size of the table that they are hashed into.
GRAM = 3
TABLE_BITS = 16
#: Characters of texts that are fitted together.
_TOGETHER = 1 << 19
_ROUNDS = 20
#: Bytes that are no letters in ASCII become spaces; all others stay.
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def grams(text):
    """Distinct hashed n-grams of a text with their counts."""
    raw = b" " + b" ".join(text.lower().encode().translate(_TO_SPACE).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    n = len(b) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, np.uint32)
    for i in range(GRAM):
        code = (code << np.uint32(8)) | b[i : i + n]
    return np.unique((code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS), return_counts=True)


def is_held_out(id_col):
    """Whether crc32 of the id as text is divisible by 5.  A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs, id_col="doc_id", text_col="text", lang_col="lang"):
    """Gram probabilities of each language: ``(languages, matrix)``.

    Learns from every row with a language whose id is not held out.  A task adds its
    texts up first, so the driver sees one row per language, and per language and gram
    of the fixed table.
    """
    labelled = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out("id")
    )
    names = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    if not names:
        return [], np.zeros((0, 1 << TABLE_BITS))

    def count(batches):
        held = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
                table = held.setdefault(lang, np.zeros(1 << TABLE_BITS, np.int64))
                gram, n = grams(text)
                table[gram] += n
        for lang, table in held.items():
            gram = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(table[gram])], names=["lang", "gram", "n"]
            )

    summed = labelled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    rows = summed.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.zeros((len(names), 1 << TABLE_BITS))
    np.add.at(matrix, (rows["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(np.int64), rows["gram"].to_numpy(np.int64)), rows["n"].to_numpy(np.float64))
    return names, matrix


class Mixture:
    """Fits proportions of languages to texts."""

    def __init__(self, names, counts, smoothing=0.5):
        self.names = names
        total = counts.sum(axis=1, keepdims=True)
        self.p = (counts + smoothing) / (total + smoothing * counts.shape[1])
        self.known = counts.sum(axis=0) > 0

    def _em(self, p, n, starts, total, share):
        """Proportions (languages, texts) from ``share`` on, and the likelihood of
        each text; a language at zero stays out."""
        width = np.diff(np.append(starts, p.shape[1]))
        for _ in range(_ROUNDS):
            part = p * np.repeat(share, width, axis=1)
            mixed = part.sum(axis=0)
            share = np.add.reduceat(part * (n / mixed), starts, axis=1) / total
        mixed = (p * np.repeat(share, width, axis=1)).sum(axis=0)
        return share, np.add.reduceat(n * np.log(mixed), starts)

    def fit(self, items):
        """``(language number or -1, score)`` of each text.

        All languages are fitted first.  Then sets of the likeliest ones, in the
        order of their proportions, grow by one as long as a text's likelihood gains
        more than the penalty: as n-grams overlap, a text has about a GRAM-th as
        much evidence as n-grams.  The score is the proportion of the first language
        in the set chosen, times the share of n-grams that training knows.
        """
        found = [grams(t) if _LETTER.search(t) else None for t in items]
        use = [i for i, f in enumerate(found) if f is not None and len(f[0])]
        best, score = np.full(len(items), -1), np.zeros(len(items))
        if not use or not self.names:
            return best, score
        gram = np.concatenate([found[i][0] for i in use]).astype(np.int64)
        n = np.concatenate([found[i][1] for i in use]).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum([len(found[i][0]) for i in use])[:-1]])
        total = np.add.reduceat(n, starts)
        known = np.add.reduceat(n * self.known[gram], starts) / total
        p = self.p[:, gram]
        k = len(self.names)
        share, _ = self._em(p, n, starts, total, np.full((k, len(use)), 1 / k))
        order = np.argsort(-share, axis=0, kind="stable")
        rank = np.argsort(order, axis=0, kind="stable")
        chosen, value, open_ = None, None, np.ones(len(use), bool)
        for size in range(1, k + 1):
            inside = rank < size
            share, fit = self._em(p, n, starts, total, inside / size)
            gain = fit / GRAM - size * np.log(total / GRAM + 2) * 2
            if chosen is None:
                chosen, value = share, gain
                continue
            open_ &= gain > value
            if not open_.any():
                break
            chosen[:, open_], value[open_] = share[:, open_], gain[open_]
        best[use] = chosen.argmax(axis=0)
        score[use] = np.clip(chosen.max(axis=0) * known, 0, 1)
        return best, score


def predict(docs, model, text_col="text", unknown="und", names=("lang_pred", "score")):
    """Adds ``names``, the predicted language and a score from 0 to 1, to ``docs``, from
    the text only.

    ``unknown`` with score 0 is given to texts that are null or have no letter, and
    to all if nothing was learned.  Very long texts are fitted as a whole; equal
    likelihoods go to the language that comes first by name.  Repeated rows each
    come back, an empty table gives no rows.  All columns of ``docs`` are kept, so
    none may have one of the new names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Mixture(model[0], model[1].astype(np.float32)))
    out = docs.columns

    def run(batches):
        mixture = shared.value
        labels = np.array([*mixture.names, unknown], dtype=object)
        for batch in batches:
            items = texts(batch, text_col)
            best, score = np.full(len(items), -1), np.zeros(len(items))
            for s, e in by_bytes(items, _TOGETHER):
                best[s:e], score[s:e] = mixture.fit(items[s:e])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels[best], pa.string()), pa.array(score)], names=[*out, *names]
            )

    schema = numbered([(f"`{c}`", t) for c, t in docs.dtypes] + [(names[0], "string"), (names[1], "double")])
    return docs.mapInArrow(run, schema)


def identify(docs, id_col="doc_id", text_col="text", lang_col="lang"):
    """Train on ``docs`` and predict every row: ``id_col``, ``held_out``,
    ``lang_pred``, ``score``.  Language, source and id are no inputs of a prediction."""
    model = train(docs, id_col, text_col, lang_col)
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].alias(text_col))
    return predict(rows, model, text_col).select(
        id_col, is_held_out(id_col).alias("held_out"), "lang_pred", "score"
    )


def keep_known(docs, least=0.5, id_col="doc_id", text_col="text", lang_col="lang"):
    """``docs`` whose language could be told: not ``und``, and a score of ``least``
    or more.  All columns are kept as they are."""
    marks = ("__lang_pred", "__score")
    marked = predict(docs, train(docs, id_col, text_col, lang_col), text_col, names=marks)
    return marked.where((F.col(marks[0]) != "und") & (F.col(marks[1]) >= least)).drop(*marks)
