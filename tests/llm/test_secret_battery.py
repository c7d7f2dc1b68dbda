"""The randomness battery against plain Python, planted keys, and long runs."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from pairscreen.llm import secret_scan

ALPHABETS = {name: alphabet for name, _, alphabet in secret_scan.ENCODINGS}


def plain_scores(x, k):
    n = len(x)
    chi = sum(x.count(v) ** 2 for v in range(k)) * k / n - n
    spread = 2 / (9 * (k - 1))
    uniform = ((chi / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)
    high = sum(v >= k / 2 for v in x)
    runs = 1 + sum((a >= k / 2) != (b >= k / 2) for a, b in zip(x, x[1:]))
    mean_runs = 2 * high * (n - high) / n + 1
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    mean = sum(x) / n
    var = sum((v - mean) ** 2 for v in x)
    lag = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:]))
    return (
        uniform,
        (runs - mean_runs) / math.sqrt(var_runs) if var_runs > 0 else 8.0,
        (lag / var + 1 / n) * math.sqrt(n) if var > 0 else 8.0,
    )


def upper_tail(s):
    return math.erfc(math.sqrt(s / 2)) + math.sqrt(2 * s / math.pi) * math.exp(-s / 2)


def test_scores_agree_with_plain_ones(spark):
    rng = random.Random(3)
    rows = []
    for name, alphabet in ALPHABETS.items():
        for n in (20, 33, 100):
            rows += ["".join(rng.choices(alphabet, k=n)) for _ in range(4)]
        rows += [(alphabet * 4)[:40], alphabet[-1] * 30 + alphabet[0] * 10]
    docs = spark.createDataFrame([(t,) for t in rows], "token string").select("token", secret_scan._encoded(F.struct("token")).alias("e"))
    e = F.col("e")
    scores = secret_scan._bound(secret_scan._sums(e), lambda m: secret_scan._scores(e, m))
    seen = 0
    for r in docs.where("e IS NOT NULL").select("token", "e", scores.alias("s"), secret_scan._battery(e).alias("p")).collect():
        want = plain_scores(list(r["e"]["x"]), int(r["e"]["k"]))
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(r["s"], want))
        assert abs(r["p"] - upper_tail(sum(v * v for v in want))) < 1e-6
        seen += 1
    assert seen > 60


def test_planted_keys_of_all_encodings_and_lengths(spark):
    """Most keys are found and hardly any identifier is called, in each encoding."""
    rng = random.Random(9)
    words = "the user Name table Data index module view request value of and in List node Path error with state File".split()
    rows, planted = [], {}
    for name in ("hex", "base32", "base62", "base64"):
        alphabet = ALPHABETS[name].upper() if name == "hex" else ALPHABETS[name]
        for n in (24, 40, 64):
            for _ in range(10):
                planted[len(rows)] = (name, n)
                rows.append("".join(rng.choices(alphabet, k=n)))
    for _ in range(1500):
        rows.append(rng.choice("_/-").join(rng.choices(words, k=rng.randrange(4, 9))) + str(rng.randrange(100)))
    docs = spark.createDataFrame([(i, f"see {t} there {rng.choice(words)}") for i, t in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"] for r in secret_scan.find_secrets(docs).collect() if any(s["kind"] == 3 for s in r["spans"])}
    for name in ("base62", "base64", "base32"):
        own = [i for i, (kind, _) in planted.items() if kind == name]
        assert sum(i in found for i in own) >= 0.8 * len(own), name
    own = [i for i, (kind, n) in planted.items() if kind == "hex" and n >= 40]
    assert sum(i in found for i in own) >= 0.5 * len(own)
    assert len(found - set(planted)) <= 0.1 * len(found)


def test_classes_are_pooled_with_their_neighbours():
    counts = [{"stratum": s, "count": n, "bin": 0, "score": 0} for s, n in ((4, 50), (5, 180), (6, 40), (7, 500), (8, 3), (36, 2))]
    assert secret_scan.pools(counts) == [[4, 5], [6, 7, 8], [36]]


@pytest.mark.parametrize("n, length, alphabet", [(1, 1_000_000, "base64"), (16_000, 24, "base64"), (16_000, 30, "hex")])
def test_work_is_in_proportion(spark, n, length, alphabet):
    rng = random.Random(1)
    runs = ["".join(rng.choices(ALPHABETS[alphabet], k=length)) for _ in range(n)]
    docs = spark.createDataFrame([(1, " ".join(runs))], "doc_id long, text string")
    began = time.time()
    spans = secret_scan.find_secrets(docs).first()["spans"]
    text = secret_scan.redact(docs).first()["text"]
    assert time.time() - began < 60
    at = [(i * (length + 1), i * (length + 1) + length) for i in range(n)]
    found = {(s["start"], s["end"]) for s in spans}
    assert found <= set(at) and (alphabet != "hex" or len(spans) == n)
    left = [r for r, place in zip(runs, at) if place not in found]
    assert text.replace("[SECRET]", "").split() == left and text.count("[SECRET]") == len(spans)


def test_running_numbers_and_cuts(spark):
    rng = random.Random(0)
    values = [rng.randrange(9) for _ in range(1000)]
    row = spark.createDataFrame([(values,), ([],)], "v array<int>")
    sums, most = (row.select(secret_scan._running(F.col("v"), f, 7).alias("r")) for f in (lambda a, b: a + b, lambda a, b: F.greatest(a, b)))
    assert [list(r["r"]) for r in sums.collect()] == [[sum(values[:i]) for i in range(1000)], []]
    assert [list(r["r"]) for r in most.collect()] == [[max([0] + values[:i]) for i in range(1000)], []]
    text = "é" + "".join(rng.choices("abc漢", k=400))
    for _ in range(3):
        spans = sorted((s, s + rng.randrange(1, 9)) for s in (rng.randrange(390) for _ in range(60)))
        out, done = "", 0
        for s, e in spans:
            if s >= done and (s > done or s == 0):
                out += text[done:s] + "#"
            done = max(done, e)
        docs = spark.createDataFrame([(text, [(s, 0, e) for s, e in spans])], "t string, s array<struct<start:int,kind:int,end:int>>")
        cut = docs.select(secret_scan._without(F.col("t"), F.col("s"), "#", 8).alias("c")).first()["c"]
        assert cut.replace("##", "#") == (out + text[done:]).replace("##", "#")
