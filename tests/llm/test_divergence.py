"""Divergence of sources against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from check_queries import compare, connect
from pairscreen.llm import divergence

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows, least=30, top=50):
    """Rows (lang, source, text)."""
    times, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        groups.add((lang, source))
        times[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        total = Counter()
        for s in sources:
            total.update(times[lang, s])

        def p(counts):
            below = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // below for t in kept}

        q, by = p(total), {s: p(times[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(by[s][t] - by[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(q[t] - by[s][t], t) for t in kept if times[lang, s][t] and by[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def check(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert sorted(map(tuple, divergence.divergences(docs, **kw).collect())) == plain(rows, **{k.replace("least_docs", "least"): v for k, v in kw.items()})


def test_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), folder, "op13_source_divergence") is None


def made_up(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "Ärger", "ärger", "日本", "x1y", "it's", "zz", "naïve", "𝒳"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(300):
        weights = [rng.random() ** 3 for _ in words]
        text = " ".join(rng.choices(words, weights, k=rng.randrange(0, 40)))
        rows.append((rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None, "é"]), text))
    return rows


def test_made_up_documents(spark):
    rows = made_up(1) + [("fr", "lonely", None), ("fr", "other", "..."), ("it", "single", "uno"), (None, None, None)]
    rows += rows[:5]
    check(spark, rows)
    check(spark, rows, least_docs=3, top=2)


def test_small_limits_change_nothing(spark, monkeypatch):
    """Flushes, source blocks, matrices of few terms."""
    monkeypatch.setattr(divergence, "SLICE", 200)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    monkeypatch.setattr(divergence, "ENTRIES", 9)
    monkeypatch.setattr(divergence, "SHARD_ROWS", 25)
    check(spark, made_up(2), least_docs=4, top=3)


def test_a_hot_language_and_a_long_text(spark):
    rows = [("en", f"s{i % 3}", "common words here") for i in range(200)] + [("en", "s0", "long " * 400_000)]
    check(spark, rows, least_docs=1)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([("en", "a", "x", 1, 1)], "lang string, source string, text string, term int, value int")
    assert divergence.divergences(docs).count() == 0  # one group, no other source, no kept term
    assert divergence.divergences(docs.limit(0)).count() == 0


def test_shares_beyond_64_bits():
    times = np.array([0, 10**12, 10**15], np.int64)
    got = divergence.share(times, np.int64(10**16), 7)
    assert got.tolist() == [1 + 10**9 * (int(t) + 5) // (10**16 + 35) for t in times]


@pytest.mark.parametrize("text, terms", [("aB-C_d", ["ab", "c", "d"]), ("É é", ["É", "é"]), ("1 2\x00@[`{\x7f", []), ("\x80x", ["\x80x"])])
def test_terms(spark, text, terms):
    docs = spark.createDataFrame([("l", "s", text)], "lang string, source string, text string")
    assert sorted(r["term"] for r in divergence.term_counts(docs).collect() if r["term"]) == sorted(terms)
