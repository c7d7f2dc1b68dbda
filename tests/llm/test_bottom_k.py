"""Bottom-k near duplicates against brute-force Jaccard."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

import __spark_entry__ as entry
from check_queries import compare, connect
from pairscreen.llm import bottom_k

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_sets(texts, size):
    out = []
    for t in texts:
        words = (t or "").translate(UPPER).replace("\x0b", " ").replace("\x0c", " ")
        words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        out.append({tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))} if words else set())
    return out


def plain_groups(rows, size=4):
    sets = dict(zip((i for i, _ in rows), plain_sets([t for _, t in rows], size)))
    where, root = defaultdict(list), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for a, b in {(a, b) for met in where.values() for n, a in enumerate(met) for b in met[n + 1 :]}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def edited(rng, words, n, tag):
    words = list(words)
    for j in rng.sample(range(len(words)), n):
        words[j] = f"{tag}{j}"
    return words


def test_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), folder, "op11_minhash_near_dedup") is None


def test_made_up_groups(spark):
    """Near copies of all degrees, chains, a shared passage, long and short texts."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(rng.choice((40, 120, 900)))]
        for i in range(40):
            rows.append(edited(rng, base, rng.randrange(0, max(2, len(base) // 12)), f"e{g}_{i}_"))
    for i in range(12):  # a chain: neighbours are linked, the ends are not
        rows.append([f"c{j}" for j in range(3 * i, 3 * i + 60)])
    rows += [passage + [f"own{i}_{j}" for j in range(20)] for i in range(30)]
    rows += [["one", "two"], ["ONE", "two"], ["two", "one"], ["one", "two", "three", "four"]]
    rows = list(enumerate(" ".join(r) for r in rows))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(bottom_k.near_duplicates(docs)) == plain_groups(rows)


def test_awkward_rows(spark):
    long = " ".join(f"word{i % 30_011}" for i in range(120_000))
    rows = [
        (1, None, "x", 1, 1),
        (2, "", "x", 1, 1),
        (3, " \t\n", None, 1, 1),
        (4, "A b", "x", 1, 1),
        (4, "A b", "x", 1, 1),
        (5, "a  B", "x", 1, None),
        (None, "a b", "x", 1, 1),
        (None, "only without an id", "x", 1, 1),
        (7, long, "x", 1, 1),
        (8, long + " end", "x", 1, 1),
        (9, "É b c d e", "x", 1, 1),
        (10, "é b c d e", "x", 1, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, k1 long, n int")
    got = sorted(bottom_k.near_duplicates(docs).collect(), key=repr)
    want = [
        (1, 0, 1, True),
        (2, 0, 2, True),
        (3, 0, 3, True),
        (4, 1, 4, True),
        (4, 1, 4, True),
        (5, 1, 4, False),
        (None, 1, 4, False),
        (None, 1, None, True),
        (7, 30_011, 7, True),
        (8, 30_012, 7, False),
        (9, 2, 9, True),
        (10, 2, 10, True),
    ]
    assert got == sorted((Row(doc_id=i, n_shingles=n, component_id=c, kept=k) for i, n, c, k in want), key=repr)
    assert bottom_k.near_duplicates(docs.limit(0)).count() == 0


def test_hot_group_of_near_copies_and_a_common_passage(spark):
    """Near copies of one text, all with a passage that as many others have too."""
    rng = random.Random(1)
    base, passage = [f"b{i}" for i in range(100)], [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + edited(rng, base, rng.randrange(0, 9), f"e{i}_"))) for i in range(300)]
    rows += [(1000 + i, " ".join(passage + [f"o{i}_{j}" for j in range(40)])) for i in range(300)]
    want = plain_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(bottom_k.near_duplicates(docs)) == want


@pytest.mark.parametrize("block, cell", [(2_000, 1 << 20), (2_000, 0)])
def test_blocks_and_lists_give_the_same(spark, monkeypatch, block, cell):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 9), f"e{i}_"))) for i in range(120)]
    monkeypatch.setattr(bottom_k, "BLOCK", block)
    monkeypatch.setattr(bottom_k, "CELL_BLOCKS", cell)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(bottom_k.near_duplicates(docs)) == plain_groups(rows)


def test_union_sketch_and_links_against_sets():
    rng = np.random.default_rng(3)
    for _ in range(40):
        pool = rng.integers(-(1 << 62), 1 << 62, 400)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 390), replace=False)) for _ in range(12)]
        sets += [np.unique(np.concatenate([sets[0][: len(sets[0]) * 9 // 10], rng.integers(0, 99, 2)]))]
        tile = bottom_k._Tile(list(range(13)), sets, (4, 5))
        for x in range(13):
            hit = tile.linked(x, np.arange(13))
            exact = [5 * len(np.intersect1d(sets[x], s)) >= 4 * len(np.union1d(sets[x], s)) for s in sets]
            assert hit.tolist() == exact


def test_shingles_of_a_column():
    texts = ["a b c d e", None, "", "A  B\tc d", "a b c", "a b c d " * 9, "x" * (5 << 20) + " y z w"]
    sets = bottom_k.shingle_sets(pa.array(texts), 4)
    assert [len(s) for s in sets] == [len(s) for s in plain_sets(texts, 4)]
    assert set(sets[3]) < set(sets[0]) and not set(sets[4]) & set(sets[0])


def test_least_overlap_is_the_binomial_tail():
    from fractions import Fraction
    from math import comb

    for k in (16, 64, 256):
        t = bottom_k.least_overlap(k, (4, 5))

        def below(t):
            return sum(comb(k, i) * Fraction(4, 5) ** i * Fraction(1, 5) ** (k - i) for i in range(t))

        assert below(t) <= bottom_k.MISS < below(t + 1)
