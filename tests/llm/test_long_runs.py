"""Token counts and packing of texts with very long runs of white space."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from pairscreen.llm import packing, tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_long_runs_through_spark(spark, tokenizer):
    rows = [
        (1, " " * 2_000_000),
        (2, "\n" * 2_000_000),
        (3, " \n\t\u3000" * 200_000),
        (4, " " * 1_000_000 + "a"),
        (5, "a" + "\n" * 1_000_000 + "b c"),
        (6, "x" + " " * 100_000 + "<|endoftext|>" + "\t" * 100_000 + "'s"),
        (7, "-" * 1_000_000),
        (8, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    counted = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, VOCABULARY).collect()}
    assert counted == {i: len(x) for i, x in ids.items()}
    whole = {i: np.array([*x, 0], "<u4") for i, x in ids.items()}
    for r in packing.cut_ids(docs, VOCABULARY).collect():
        want = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(want.tobytes()) and r["doc_tokens"] == len(whole[r["doc_id"]])


def test_runs_are_cut_as_the_pattern_cuts_them(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "RUN_CHARS", 3)
    monkeypatch.setattr(tokens, "_RUN", re.compile(tokens._RUN.pattern.replace("65536", "3")))
    encode = tokens.encoder(VOCABULARY)
    rng = random.Random(1)
    signs = [" ", "\n", "\t", "\u3000", "\xa0", "a", "1", "-", "'s", "\x1c", "\x85", "<|endoftext|>"]
    for _ in range(2000):
        text = "".join(rng.choices(signs, [6, 3, 2, 1, 1, 2, 1, 1, 1, 1, 1, 1], k=rng.randrange(40)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
