import hashlib
import os

import pytest

from pairscreen.functions import basename, clean_name, pair_name
from pairscreen.operators import sweep
from pairscreen.operators.encode import HashedKmerEncoder
from pairscreen.sources import fasta, fingerprint, interactions, results, worklist
from pairscreen.sources.store import EncodedStore

FILES = {
    "b.faa": ">p1 first protein\nACD\nEF\n\n>p2 with > inside\r\nGH I\r\n>p1\nKL",
    "a.faa": ">only\nMNP\n",
    "empty.faa": "",
    "lead.faa": "; a comment\n>x\nAC\n>bare\n",
    "notes.txt": ">no\nAAA\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path)


def records(df):
    return sorted((r.proteome_id, r.seq_idx, r.protein_id, r.sequence, r.length) for r in df.collect())


def test_fasta(spark, folder):
    assert records(fasta.read_fasta(spark, folder, "*.faa")) == [
        ("a", 0, "only", "MNP", 3),
        ("b", 0, "p1", "ACDEF", 5),
        ("b", 1, "p2", "GHI", 3),
        ("b", 2, "p1", "KL", 2),
        ("lead", 0, "x", "AC", 2),
        ("lead", 1, "bare", "", 0),
    ]


def test_fasta_in_many_splits_keeps_order(spark, folder, tmp_path):
    big = tmp_path / "big"
    big.mkdir()
    text = "; no record\n" + "".join(f">p{i} x\n{'ACDE' * (i % 9)}\n" for i in range(200)) + ">\n>\n"
    (big / "with space.faa").write_text(text)
    (big / "z.faa").write_text(">a\nAC")
    want = [("with space", i, f"p{i}", "ACDE" * (i % 9), 4 * (i % 9)) for i in range(200)]
    want += [("with space", i, "", "", 0) for i in (200, 201)] + [("z", 0, "a", "AC", 2)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        df = fasta.read_fasta(spark, str(big))
        assert records(df) == want
        assert len(spark.read.text(str(big)).inputFiles()) == 2 and spark.read.text(str(big)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_inventory_is_sorted(spark, folder):
    got = fasta.scan_proteomes(spark, folder).collect()
    assert [r.proteome_id for r in got] == ["a", "b", "empty", "lead"]
    assert got[0]["size"] == len(FILES["a.faa"])


def test_names(spark):
    df = spark.createDataFrame([("/x/y.z/h.tar.faa", " a b.faa \t")], "p string, s string")
    r = df.select(basename("p").alias("b"), basename("p", False).alias("f"), clean_name("s").alias("c"), pair_name("s", "p").alias("n")).first()
    assert (r.b, r.f, r.c) == ("h.tar", "h.tar.faa", "ab")
    dots = spark.createDataFrame([(".hidden",), ("plain",), ("a.",)], "p string")
    assert [r[0] for r in dots.select(basename("p")).collect()] == [".hidden", "plain", "a"]


def test_interaction_splits(spark, tmp_path):
    rows = [("c1", "AC", "GH", 1, None, [(0, 1)], "train"), ("c2", "A", "G", 3, 4, None, "test")]
    df = spark.createDataFrame(rows, interactions.INTERACTIONS)
    path = str(tmp_path / "inter")
    interactions.write_interactions(df, path)
    train = interactions.read_interactions(spark, path, "train")
    assert [r.complex_id for r in train.collect()] == ["c1"]
    assert "split" in train._jdf.queryExecution().executedPlan().toString()
    assert interactions.read_interactions(spark, path, "all").count() == 2
    ddi = interactions.read_ddi(spark, path, "test").first()
    assert (ddi.seq1_cluster, ddi.seq2_cluster) == (-1, -1)


def test_worklist(spark, tmp_path):
    (tmp_path / "list").write_text("h1.faa\n\n   \n h2 \nmissing\nh1\nlast.faa")
    inventory = spark.createDataFrame([("h1",), ("h2",), ("last",)], "host_proteome string")
    got = {r.host_proteome: r.found for r in worklist.read_worklist(spark, str(tmp_path / "list"), inventory).collect()}
    assert got == {"h1": True, "h2": True, "missing": False, "last": True}


def proteins(spark, rows):
    return spark.createDataFrame(rows, "proteome_id string, seq_idx int, protein_id string, sequence string")


def test_store_encodes_what_is_missing(spark, tmp_path):
    store = EncodedStore(spark, str(tmp_path / "store"), HashedKmerEncoder(dim=4), max_len=3)
    rows = proteins(spark, [("a", 0, "x", "ACDE"), ("a", 1, "y", "G"), ("b", 0, "z", "KLM")])
    assert store.read().count() == 0
    assert store.missing(rows).count() == 3
    first = {r.protein_id: r for r in store.ensure(rows).collect()}
    assert first["x"].length == 3 and len(first["x"].residues) == 3 and len(first["x"].q) == 64
    assert store.missing(rows).count() == 0
    assert {r.protein_id for r in store.read(["b"]).collect()} == {"z"}
    # Changed content of one proteome: that partition alone is replaced.
    changed = proteins(spark, [("a", 0, "x", "ACDF"), ("b", 0, "z", "KLM")])
    assert {r.proteome_id for r in store.missing(changed).collect()} == {"a"}
    store.ensure(changed)
    assert sorted(r.protein_id for r in store.read().collect()) == ["x", "z"]
    # Another version or length limit is another encoding.
    assert EncodedStore(spark, store.path, HashedKmerEncoder(dim=4, seed=1), max_len=3).missing(changed).count() == 2
    assert EncodedStore(spark, store.path, HashedKmerEncoder(dim=4), max_len=4).missing(changed).count() == 2


def test_encoding_does_not_depend_on_batches(spark, tmp_path, monkeypatch):
    from pairscreen.operators import encode

    rows = proteins(spark, [("a", i, str(i), "ACDEFGH"[: i % 7 + 1] * 3) for i in range(40)])
    want = {r.protein_id: (r.q, r.residues) for r in encode.encode(rows, ["protein_id"]).collect()}
    monkeypatch.setattr(encode, "CHUNK_VALUES", 100)
    got = encode.encode(rows.repartition(5), ["protein_id"])
    assert {r.protein_id: (r.q, r.residues) for r in got.collect()} == want


def test_predictions_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 0.5), ("c", "d", 0.9)], "query_id string, match_id string, contact_score double")
    results.write_predictions(df, str(tmp_path / "p"))
    back = spark.read.option("header", True).csv(str(tmp_path / "p"))
    assert [r.query_id for r in back.orderBy("contact_score", ascending=False).collect()] == ["c", "a"]
    results.write_predictions(df.limit(0), str(tmp_path / "none"), fmt="parquet")
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "none")).count() == 0


def test_pair_results_and_status(spark, tmp_path):
    path = str(tmp_path / "out")
    pairs = spark.createDataFrame([("h1", "v1"), ("h1", "v2")], "host_proteome string, viral_proteome string")
    found = spark.createDataFrame(
        [("h1", "v1", "x", "y", 0.7, True), ("h1", "v1", "z", "y", 0.9, False)],
        "host_proteome string, viral_proteome string, viral_id string, host_id string, contact_score double, host_is_best_contact boolean",
    )
    for _ in range(2):  # a repeated write replaces the pair's rows
        results.write_pair_results(found, pairs, path)
    assert results.read_partitioned_results(spark, path).count() == 2
    status = results.read_pair_status(spark, path).collect()
    assert sorted((r.viral_proteome, r.n_results) for r in status) == [("v1", 2), ("v2", 0)]
    assert sweep.pending_pairs(pairs, results.read_pair_status(spark, path)).count() == 0
    # A pair that has no rows any more keeps none of the old ones.
    results.write_pair_results(found.limit(0), pairs.where("viral_proteome = 'v1'"), path)
    assert results.read_partitioned_results(spark, path).count() == 0
    assert sorted(r.n_results for r in results.read_pair_status(spark, path).collect()) == [0, 0]


def test_finished_pair_files(spark, tmp_path):
    head = "viral_id,host_id,contact_score,host_is_best_contact\n"
    (tmp_path / "h1__v1.csv").write_text(head + "a,b,0.5,True\n")
    (tmp_path / "h1__v__2.csv").write_text(head)
    (tmp_path / "h2__v1.csv").write_text("")
    (tmp_path / "h1.log").write_text("nothing to see")
    got = results.read_pair_results(spark, str(tmp_path)).collect()
    assert [(r.host_proteome, r.viral_proteome, r.viral_id, r.contact_score, r.host_is_best_contact) for r in got] == [("h1", "v1", "a", 0.5, True)]
    done = {tuple(r) for r in results.finished_pairs(spark, str(tmp_path)).collect()}
    assert done == {("h1", "v1"), ("h1", "v__2"), ("h2", "v1")}


def test_metrics_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "eval/x", 0.5)], "step long, metric string, value double")
    for _ in range(2):
        results.write_metrics(df, str(tmp_path / "m"))
    assert results.read_metrics(spark, str(tmp_path / "m")).count() == 2


def test_fingerprint(spark, folder):
    got = fingerprint.fingerprint(spark, folder, "*.faa")
    assert got.where("name = 'empty.faa'").first().sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.name: r.sha256 for r in got.collect()}["a.faa"] == hashlib.sha256(FILES["a.faa"].encode()).hexdigest()
    assert fingerprint.require_same(got, got) is got
    with open(os.path.join(folder, "a.faa"), "a") as f:
        f.write("X")
    expected = spark.createDataFrame([("a.faa", hashlib.sha256(FILES["a.faa"].encode()).hexdigest())], "name string, sha256 string")
    with pytest.raises(ValueError, match="a.faa"):
        fingerprint.require_same(fingerprint.fingerprint(spark, folder, "*.faa"), expected)


def hash_tree(data, size, fan):
    sha = lambda b: hashlib.sha256(b).digest()
    level = [sha(b"\0" + data[i : i + size]) for i in range(0, max(1, len(data)), size)]
    while len(level) > 1:
        level = [sha(b"\1" + b"".join(level[i : i + fan])) for i in range(0, len(level), fan)]
    return hashlib.sha256(f"{len(data)}:{size}:{fan}".encode() + level[0]).hexdigest()


@pytest.mark.parametrize("size, fan", [(1, 2), (7, 3), (1000, 4)])
def test_tree_fingerprint(spark, tmp_path, size, fan):
    """Ranges of a few bytes; a file's root does not depend on the files beside it."""
    data = {"empty": b"", "one": b"x", "seven": b"ACDEFGH", "long": bytes(range(256)) * 2, "a b%20c": b"same" * 9}
    for name, text in data.items():
        (tmp_path / name).write_bytes(text)
    got = fingerprint.tree_fingerprint(spark, str(tmp_path), range_bytes=size, fan=fan).collect()
    assert {r.name: (r["size"], r.sha256) for r in got} == {
        n: (len(t), hash_tree(t, size, fan)) for n, t in data.items()
    }
    whole = fingerprint.fingerprint(spark, str(tmp_path)).collect()
    assert {r.name: r.sha256 for r in whole} == {n: hashlib.sha256(t).hexdigest() for n, t in data.items()}


def test_content_hash_ignores_row_order(spark):
    rows = [("a", i, str(i), "ACDEF"[: i % 5]) for i in range(30)]
    cols = ["seq_idx", "protein_id", "sequence"]
    one = fingerprint.content_hash(proteins(spark, rows), "proteome_id", cols).first().content_hash
    two = fingerprint.content_hash(proteins(spark, rows[::-1]).repartition(4), "proteome_id", cols).first().content_hash
    assert one == two
    rows[3] = ("a", 3, "3", "G")
    assert fingerprint.content_hash(proteins(spark, rows), "proteome_id", cols).first().content_hash != one


def test_proteome_in_two_batches_keeps_both(spark, tmp_path):
    from pairscreen.operators.encode import HashedKmerEncoder
    from pairscreen.sources.store import EncodedStore
    from pairscreen.streaming.encoding import stream_encode_rows

    schema = "proteome_id string, seq_idx int, protein_id string, sequence string"
    folder, store = str(tmp_path / "in"), EncodedStore(spark, str(tmp_path / "store"), HashedKmerEncoder(dim=4))
    for i in range(2):
        spark.createDataFrame([("p", i, f"x{i}", "ACD" * 500)], schema).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        stream_encode_rows(stream, store, str(tmp_path / "state"), once=True).awaitTermination(60)
    got = {r["protein_id"]: r["length"] for r in store.read().collect()}
    assert got == {"x0": 1500, "x1": 1500}
