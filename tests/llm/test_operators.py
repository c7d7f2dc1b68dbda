"""Every operator against a plain version of itself, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check_queries import compare, connect
from test_bottom_k import plain_groups
from pairscreen.llm import (
    chat,
    decontaminate,
    languages,
    neighbours,
    packing,
    page_text,
    secret_scan,
    simhash,
    substrings,
    tokens,
)

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, base string, spans int"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, blanks, repeated rows, ties, a very long text and clashing columns."""
    rows = [
        (1, None, "en", "x", 1),
        (2, "", None, "x", 1),
        (3, " \t\n ", "en", None, None),
        (None, "one two three four", "en", "x", 1),
        (4, "one two three four", "en", "x", 1),
        (4, "one two three four", "en", "x", 1),
        (5, "Ünïcödé 漢字 <|endoftext|> it's  2x\r\n", "de", "x", 1),
        (6, " ".join(f"word{i % 977}" for i in range(60_000)), "en", "x", 1),
        (7, "x" * 300_000, "en", "x", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def empty(spark, df):
    return spark.createDataFrame([], df.schema)


# Nearest neighbours


def exact(ids, x, query, k):
    score = x @ x[query] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[query])
    order = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != ids[query]]
    return ids[order[:k]].tolist()


def test_neighbours_recall(spark):
    v = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    got = entry.queries()["op1_nearest_neighbours"](spark, FOLDER).toPandas()
    p = v.toPandas()
    ids, x = p["vec_id"].to_numpy(), np.array(p["embedding"].tolist(), dtype=float)
    queries = np.flatnonzero(ids % 50 == 0)
    hits = sum(len(set(exact(ids, x, q, 5)) & set(got[got["query_id"] == ids[q]]["vec_id"])) for q in queries)
    assert len(got) == 5 * len(queries) and hits >= 0.9 * 5 * len(queries)
    first = got[got["rank"] == 1].iloc[0]
    a, b = x[ids == first["query_id"]][0], x[ids == first["vec_id"]][0]
    assert abs(first["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-14


def test_neighbours_awkward(spark):
    rows = [(i, [1.0, 0.0]) for i in range(20)] + [(30, [2.0, 0.0]), (31, [0.0, 1.0]), (31, [0.0, 1.0])]
    rows += [(40, None), (41, []), (42, [0.0, 0.0]), (43, [None, 1.0]), (44, [float("nan"), 1.0]), (None, [1.0, 1.0])]
    rows += [(45, [1.0, 0.0, 0.0]), (46, [float("inf"), 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1))
    got = neighbours.nearest(v, F.col("id").isin(0, 31, 45), k=5, tables=2, probes=1).orderBy("query_id", "rank")
    found = [(r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()]
    assert found == [(0, i, i) for i in range(1, 6)] + [(31, i + 1, i) for i in range(5)]
    assert neighbours.nearest(empty(spark, v), F.col("id") % 50 == 0).count() == 0


# Near duplicates


def groups(pairs, near=3):
    fps = sorted({fp for _, fp in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= near:
                root[find(b)] = find(a)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return {f: least.get(find(f)) for f in fps}


def test_near_duplicates(spark, given):
    got = simhash.near_duplicates(given).collect()
    want = groups([(r["doc_id"], int(r["fingerprint"], 16)) for r in got])
    assert len(got) == given.count() and all(want[int(r["fingerprint"], 16)] == r["component_id"] for r in got)
    text = {r["doc_id"]: r["text"] for r in given.collect()}
    for r in got[:20]:
        assert int(r["fingerprint"], 16) == simhash.fingerprint(text[r["doc_id"]])


@pytest.mark.parametrize("bucket", [2, 2048])
def test_links_lose_nothing(spark, bucket):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(400):
        f = rng.choice(sorted(fps)) if rng.random() < 0.8 else centre
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            f ^= 1 << b
        fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), bucket=bucket).collect()
    pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in edges]
    assert all(1 <= (a ^ b).bit_count() <= 3 for a, b in pairs)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in pairs:
        root[find(b)] = find(a)
    want = groups([(f, f) for f in fps])
    mine = {}
    for f in fps:
        mine[find(f)] = min(mine.get(find(f), f), f)
    assert all(mine[find(f)] == want[f] for f in fps)


def test_near_duplicates_awkward(spark, awkward):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(awkward).collect()}
    assert got[(1, "0" * 16)] == got[(2, "0" * 16)] == got[(3, "0" * 16)] == 1
    assert simhash.near_duplicates(awkward).count() == awkward.count()
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == [1, 4, 5, 6, 7]
    assert simhash.near_duplicates(empty(spark, awkward)).count() == 0


# Languages


def test_languages_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = entry.queries()["op3_language_id"](spark, folder)
    rows = got.join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixture_prefers_the_larger_part():
    counts = np.zeros((2, 1 << languages.TABLE_BITS))
    a, b = "alba gatto lima nera ", "zwick runch fjord hym "
    for row, text in enumerate((a, b)):
        gram, n = languages.grams(text * 50)
        counts[row, gram] += n
    best, score = languages.Mixture(["a", "b"], counts).fit([a * 20, b * 20, a * 30 + b * 10, "漢字", "123", ""])
    assert best.tolist()[:3] == [0, 1, 0] and best.tolist()[4:] == [-1, -1]
    assert 0.6 < score[2] < 0.85 and score[3] < 0.5


def test_languages_awkward(spark, awkward):
    got = languages.identify(awkward).collect()
    assert len(got) == awkward.count()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3}
    assert languages.identify(empty(spark, awkward)).count() == 0
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in languages.identify(unlabelled).collect()} == {"und"}
    assert languages.keep_known(awkward).columns == awkward.columns


# Tokens and packing


def test_encoder_is_the_tokenizer(tokenizer):
    rng = random.Random(3)
    signs = list("ab cZ  \n\t.,'’!é中文 1２_-  ​\x1c\x85ǆʼѣ")
    signs += ["<|endoftext|>", " the", " don't", "'s", "<|", "|>"]
    items = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000)]
    want = [e.ids for e in tokenizer.encode_batch(items, add_special_tokens=False)]
    encode = tokens.encoder(VOCABULARY)
    assert [encode(t).tolist() for t in items] == want
    assert [np.concatenate([encode(p) for p in tokens.split_long(t, 7)]).tolist() for t in items] == want


def test_other_vocabularies_fall_back(tokenizer):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some  Words, and more."
    assert tokens.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_token_counts(spark, given, awkward, tokenizer):
    for docs in (given, awkward):
        got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(docs, VOCABULARY).collect()}
        want = set()
        for r in docs.collect():
            text = r["text"] or ""
            n = len(tokenizer.encode(text, add_special_tokens=False).ids)
            want.add((r["doc_id"], len(text.encode()), n, n > 1024))
        assert got == want
    assert tokens.count_tokens(awkward, VOCABULARY).count() == awkward.count()
    assert tokens.count_tokens(empty(spark, awkward), VOCABULARY).count() == 0


def check_packed(rows, texts, tokenizer, capacity=1024):
    """Pieces make up the documents' ids, sequences have no gaps and fit."""
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return sum(r["length"] for r in rows) / len(bins) / capacity


def test_packing(spark, given, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    assert check_packed(packing.pack(given, VOCABULARY).collect(), texts, tokenizer) > 0.97
    check_packed(packing.pack(given, VOCABULARY, group_pieces=50).collect(), texts, tokenizer)


def test_packing_awkward(spark, awkward):
    got = packing.pack(awkward, VOCABULARY).collect()
    assert sum(r["doc_id"] == 4 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    assert [r["length"] for r in got if r["doc_id"] == 1] == [1]
    assert packing.pack(empty(spark, awkward), VOCABULARY).count() == 0


def test_first_fit():
    rng = random.Random(1)
    sizes = sorted((rng.randrange(1, 101) for _ in range(300)), reverse=True)
    room, want = [], []
    for s in sizes:
        i = next((i for i, r in enumerate(room) if r >= s), len(room))
        if i == len(room):
            room.append(100)
        want.append((i, 100 - room[i]))
        room[i] -= s
    assert packing.first_fit_decreasing(sizes, 100) == want


# Repeated passages


def brute_repeats(rows, size):
    owner = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            owner[key] = min(owner.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - size + 1):
            if owner[tuple(w[s : s + size])] < i:
                gone.update(range(s, s + size))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("hold", [2, 65_536])
def test_repeats_against_brute_force(spark, hold):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randrange(60)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(100, rows[3][1]), (200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(docs, size=6, hold=hold).collect()
    assert sorted(tuple(r) for r in got) == brute_repeats(rows, 6)


def test_repeats_awkward(spark, awkward):
    got = sorted(substrings.remove_repeats(awkward).collect(), key=str)
    assert len(got) == awkward.count() and sum(r["n_removed"] for r in got) == 0
    assert substrings.remove_repeats(empty(spark, awkward)).count() == 0


# Chat


def test_turns_come_back():
    rng = random.Random(2)
    signs = [*"ab\\<>[]/ \n", "</s>", "<s>", "[INST]", "[/INST]", "<\\/s>", "[\\\\INST]"]
    for _ in range(3000):
        role = rng.choice(["user", "assistant", "system", "", "a\\\nb"])
        text = "".join(rng.choices(signs, k=rng.randrange(12)))
        assert [t[:2] for t in chat.parse(chat.render(role, text))] == [(role, text)]
        assert chat.unescape(chat.escape(text)) == text


def test_chat_awkward(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "assistant", ""), (None, 5, "user", "x" * 200_000)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(c)).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["n_turns"] == 1 and got[1]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == hashlib.sha256(b"assistant\n\n\n\n\n\n").hexdigest()
    assert chat.read_back(chat.format_turns(empty(spark, c))).count() == 0


# Secrets

_ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def brute_base(text):
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_base_spans(spark, given, awkward):
    rng = random.Random(4)
    bits = ["token", "secret", "=", ":", " ", '"', "API_KEY", "passwd", "AKIA", "abcdef012345", "Z9", "é", "漢", "-x", "\n", "ABCD2345ABCD2345"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(30)))) for i in range(400)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (made, given.select("doc_id", "text"), awkward.select("doc_id", "text")):
        got = [(r["doc_id"], [tuple(s) for s in r["base"]]) for r in secret_scan.find_secrets(docs).collect()]
        want = [(r["doc_id"], brute_base(r["text"] or "")) for r in docs.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert secret_scan.find_secrets(empty(spark, awkward)).count() == 0


def test_random_runs_are_told_from_text(spark):
    rng = random.Random(6)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(b64, k=44)) for _ in range(60)]
    plain = ["Aa1" + "".join(rng.choices(["the", "and", "ing", "tion"], k=12)) for _ in range(60)]
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(keys + plain)], "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secret_scan.find_secrets(docs).collect()}
    assert sum(3 in got[i] for i in range(60)) >= 45
    assert sum(3 in got[i] for i in range(60, 120)) <= 6


def test_redaction(spark, awkward):
    text = "é password = hunter22x and token: 0123456789abcdef0123456789abcdef end"
    docs = spark.createDataFrame([(1, text, 5, "b"), (2, "clean", 9, "b"), (3, None, None, None)], "doc_id long, text string, n_chars long, base string")
    got = {r["doc_id"]: r for r in secret_scan.redact(docs, length_col="n_chars").collect()}
    assert got[1]["text"] == "é [SECRET] and [SECRET] end" and got[1]["n_chars"] == 27 and got[1]["base"] == "b"
    assert got[2]["text"] == "clean" and got[2]["n_chars"] == 9 and got[3]["text"] is None


# Decontamination


def test_contamination_awkward(spark, awkward):
    bench = spark.createDataFrame(
        [(1, "One, TWO three"), (1, None), (None, "word0 word1 word2"), (3, "..."), (3, "one two three")], "item_id long, text string"
    )
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        got = decontaminate.contamination(awkward, bench, broadcast_bytes=limit).collect()
        assert len(got) == awkward.count()
        by = {r["doc_id"]: r for r in got}
        assert by[4]["n_hit"] == 3 and list(by[4]["items"]) == ["1", "3"] and by[4]["contaminated"] and by[None]["contaminated"]
        assert list(by[6]["items"]) == [""] and not by[6]["contaminated"] and by[1]["n_words"] == 0
    assert decontaminate.contamination(awkward, empty(spark, bench)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty(spark, awkward), bench).count() == 0
    kept = decontaminate.remove_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5, 6, 7]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_contaminated(awkward, bench, mode="span").collect()}
    assert cut[4] == "four" and cut[2] == "" and cut[1] is None


# Pages


def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        a, b = (rng.choices(range(4), k=rng.randrange(15)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        for room in (1 << 26, 3):
            found = page_text.common(a, b, room)
            rest = iter(b)
            assert found == sorted(set(found)) and len(found) == best[-1][-1] and all(a[i] in rest for i in found)


def test_page_blocks():
    page = (
        '<html><head><title>t</title></head><body><div class="site-header">menu</div><article><header><h1>A&amp;B</h1></header>'
        '<p>one\n two<br>three<p><b>four &#233;</p><script>var t="</p>";</script><div id="comments"><p>no</p></div>'
        "<form><input>no</form><ul><li>x<li>y</ul></article><aside>no</aside><p>tail 1 < 2 &am"
    )
    assert [t for t, _ in page_text.blocks(page)] == ["A&B", "one two three", "four é", "x", "y", "tail 1 < 2 &am"]
    assert page_text.blocks("") == [] and page_text.blocks("<p") == [] and page_text.blocks("<script>x") == []


def test_pages_lose_what_neighbours_share(spark):
    rows = [
        (1, "http://a.example/x/1", "<div>Site menu</div><p>first text</p><p>All rights</p>"),
        (2, "http://a.example/x/2?p=1", "<div>Site menu</div><p>second text</p><p>All rights</p>"),
        (3, "http://b.example/x/1", "<div>Site menu</div><article><p>All rights</p></article>"),
        (4, "http://b.example/x/2", "<div>Site menu</div><article><p>All rights</p></article>"),
        (5, None, None),
        (5, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in page_text.extract(pages).collect())
    assert got == [(1, "first text", 10), (2, "second text", 11), (3, "All rights", 10), (4, "All rights", 10), (5, "", 0), (5, "", 0)]
    assert page_text.extract(empty(spark, pages)).count() == 0


# Queries and pipeline


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", ["op5_substring_dedup", "op7_chat_formatting", "op9_decontamination"])
def test_query_matches_its_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_every_operator_has_one_query():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_pipeline_against_a_plain_version(spark, tokenizer):
    """Stage by stage, each judged on its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language_id", "near_dedup", "decontamination", "secrets"):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stages[name](spark, docs, FOLDER).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and after.keys() <= before.keys() and len(after) == docs.count()
        if name == "language_id":
            assert after == before  # every document has a language here
        elif name == "near_dedup":
            want = plain_groups([(i, r["text"]) for i, r in before.items()], size=5)
            assert set(after) == {i for i, (_, _, kept) in want.items() if kept}
        elif name == "decontamination":
            bad = entry.queries()["op9_decontamination"](spark, FOLDER).where("contaminated").collect()
            assert set(after) == set(before) - {r["doc_id"] for r in bad}
        else:
            changed = {i for i in before if after[i]["text"] != before[i]["text"]}
            assert changed >= {i for i, r in before.items() if brute_base(r["text"])}
            assert not any(brute_base(r["text"]) for r in after.values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_packed(corpus_pipeline.run(spark, FOLDER).collect(), texts, tokenizer)
