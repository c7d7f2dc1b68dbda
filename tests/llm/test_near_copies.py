"""The pipeline's near-duplicate stage against brute-force Jaccard."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairscreen.llm import bottom_k, near_copies, simhash
from test_bottom_k import edited, plain_groups


def kept_by_jaccard(rows):
    """Ids that stay; blank texts are copies of each other."""
    blank = [i for i, t in rows if not (t or "").split()]
    groups = plain_groups([r for r in rows if r[0] not in blank], size=5)
    return sorted([i for i, (_, _, kept) in groups.items() if kept] + blank[:1])


def near_dedup(spark, docs):
    return sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, None).select("doc_id").collect())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    kept = near_dedup(spark, docs)
    assert kept == kept_by_jaccard(sorted((r["doc_id"], r["text"]) for r in docs.collect()))


def test_made_up_groups(spark):
    """Copies, chains of edits, a shared template and short texts."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        words = rng.choice(rows)[1].split() if rng.random() < 0.5 else list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:60] + [f"y{i}_{j}" for j in range(30)])) for i in range(30)]
    rows += [(300 + i, rows[5][1].upper()) for i in range(4)]
    rows += [(400, "one two"), (401, "one  TWO"), (402, "two one"), (403, ""), (404, None), (405, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(1))
    assert near_dedup(spark, docs) == kept_by_jaccard(rows)


@pytest.mark.parametrize("keep", [near_copies.keep_one, simhash.keep_one])
def test_awkward_rows(spark, keep):
    """Nulls, repeated rows, a very long text, an empty table, columns called as the
    operators call theirs."""
    long = " ".join(f"word{i % 30_011}" for i in range(120_000))
    rows = [
        (None, "a b c d e f", "x", 1, 1, 2.0),
        (3, "a b c d e f", "y", None, 1, 2.0),
        (3, "a b c d e f", "y", None, 1, 2.0),
        (4, None, None, 1, 1, 2.0),
        (5, "", "x", 1, None, 2.0),
        (6, long, "x", 1, 1, None),
        (7, long, "z", 1, 1, 2.0),
        (None, "another text without an id", "x", 1, 1, 2.0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string, node long, row int, `a.b` double")
    got = keep(docs)
    assert got.columns == docs.columns
    want = [rows[1], rows[3], rows[5], rows[7]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert keep(docs.limit(0)).count() == 0


def test_joins_stay_in_proportion_to_the_input(spark):
    """Near copies of one text with a passage that as many others have: the rows that
    meet in a tile are a few for each document, and no pairs are written."""
    rng = random.Random(4)
    base, passage = [f"b{i}" for i in range(60)], [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + edited(rng, base, rng.randrange(0, 3), f"e{i}_"))) for i in range(2500)]
    rows += [(5000 + i, " ".join(passage + [f"o{i}_{j}" for j in range(60)])) for i in range(2500)]
    seen = []
    tiles = bottom_k._tiles

    def counted(groups, sets):
        found = tiles(groups, sets)
        seen.append(found.count())
        return found

    bottom_k._tiles = counted
    try:
        kept = near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    finally:
        bottom_k._tiles = tiles
    assert kept == [0] + [5000 + i for i in range(2500)]  # at most 2 edits: all link to the text itself
    assert seen[0] <= 4 * 2500
