"""Random runs of classes that a table hardly has."""

import random

import pytest

from pairscreen.llm import secret_scan

_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


@pytest.mark.parametrize("planted", [1, 3, 9])
def test_few_keys_are_found(spark, planted):
    rng = random.Random(planted)
    keys = ["".join(rng.choices(_B64, k=40)) for _ in range(planted)]
    parts = ["user", "Name", "Table", "2021", "_", "/", "index", "Module", "data", "View", "-", "10", "Request"]
    plain = ["Ab1" + "".join(rng.choices(parts, k=10)) for _ in range(400)]
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(keys + plain)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.find_secrets(docs).collect()}
    assert all(got[i] == [(4, 3, 44)] for i in range(planted))
    assert sum(bool(got[i]) for i in range(planted, planted + 400)) <= 1
    cut = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    assert all(cut[i] == "see [SECRET] there" for i in range(planted))
