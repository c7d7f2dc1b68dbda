import numpy as np
import pytest

from pairscreen.operators import sweep
from pairscreen.operators.contacts import MultiHeadDot
from pairscreen.operators.encode import HashedKmerEncoder, encode
from pairscreen.plans import cross, screen
from pairscreen.sources.results import read_pair_status, read_partitioned_results
from pairscreen.streaming import encoding, results as stream
from pairscreen.sources.store import EncodedStore
from pyspark.sql import functions as F

HEADS = [4.0] * 8


@pytest.fixture(scope="module")
def encoded(spark):
    rng = np.random.default_rng(9)
    letters = np.array(list("ACDEFGHIKLMNPQRSTVWY"))
    rows, n = [], 0
    for proteome, size in (("h0", 14), ("h1", 9), ("v0", 6), ("v1", 5)):
        for i in range(size):
            seq = "".join(rng.choice(letters, rng.integers(5, 40)))
            rows.append((n, proteome, f"{proteome}_{i}", seq))
            n += 1
    df = spark.createDataFrame(rows, "row_id long, proteome_id string, protein_id string, sequence string")
    out = encode(df, ["row_id", "proteome_id", "protein_id"], encoder=HashedKmerEncoder(dim=16))
    return out.cache()


def brute_cross(host, viral, top_k, threshold, scorer):
    out = []
    keys = np.concatenate([np.stack(host.k), np.stack(viral.k)]).astype(np.float32)
    res = [np.array([list(v) for v in m]) for m in [*host.residues, *viral.residues]]
    for i, q in enumerate(np.stack(viral.q).astype(np.float32)):
        s = np.zeros(len(keys))
        for d in range(keys.shape[1]):
            s += keys[:, d].astype(float) * float(q[d])
        order = np.lexsort((np.arange(len(keys)), -s))[: top_k + 1]
        cand = [int(j) for j in order if j != len(host) + i]
        mine = res[len(host) + i]
        scored = [(j, 1 / (1 + np.exp(-scorer.logits(mine, res[j]).max()))) for j in cand]
        hosts = [x for x in scored if x[0] < len(host)]
        if not hosts:
            continue
        best = max(hosts, key=lambda x: x[1])
        if best[1] > threshold:
            top = max(scored, key=lambda x: x[1])
            out.append((viral.protein_id.iloc[i], host.protein_id.iloc[best[0]], round(best[1], 9), top[0] < len(host)))
    return sorted(out)


def tuples(df):
    return sorted((r.viral_id, r.host_id, round(r.contact_score, 9), r.host_is_best_contact) for r in df.collect())


def test_cross_screen_is_the_pairwise_loop(spark, encoded):
    pdf = encoded.toPandas().sort_values("row_id")
    scorer = MultiHeadDot(HEADS, -3.0)
    host, viral = encoded.where("proteome_id like 'h%'"), encoded.where("proteome_id like 'v%'")
    results, _ = cross.cross_screen(host, viral, 4, 0.3, scorer)
    results = results.cache()
    seen = 0
    for h in ("h0", "h1"):
        for v in ("v0", "v1"):
            want = brute_cross(pdf[pdf.proteome_id == h], pdf[pdf.proteome_id == v], 4, 0.3, scorer)
            got = tuples(results.where((F.col("host_proteome") == h) & (F.col("viral_proteome") == v)))
            assert got == want
            seen += len(want)
    assert seen > 0


def test_sweep_resumes(spark, encoded, tmp_path):
    host, viral = encoded.where("proteome_id like 'h%'"), encoded.where("proteome_id like 'v%'")
    scorer = MultiHeadDot(HEADS, -3.0)
    path, whole = str(tmp_path / "sweep"), str(tmp_path / "whole")
    assert cross.run_sweep(spark, host, viral, whole, 4, 0.3, scorer) == 4
    only = spark.createDataFrame([("h1",)], "host_proteome string")
    assert cross.run_sweep(spark, host, viral, path, 4, 0.3, scorer, hosts=only) == 2
    assert cross.run_sweep(spark, host, viral, path, 4, 0.3, scorer) == 2
    assert cross.run_sweep(spark, host, viral, path, 4, 0.3, scorer) == 0
    a = read_partitioned_results(spark, path, "parquet")
    b = read_partitioned_results(spark, whole, "parquet")
    assert tuples(a) == tuples(b)
    status = read_pair_status(spark, path)
    assert status.count() == 4 and status.agg(F.sum("n_results")).first()[0] == a.count()
    assert status.where("n_candidates = 0").count() == 0


def test_stopped_sweep_keeps_its_finished_waves(spark, encoded, tmp_path, monkeypatch):
    host, viral = encoded.where("proteome_id like 'h%'"), encoded.where("proteome_id like 'v%'")
    path, whole, write = str(tmp_path / "waves"), str(tmp_path / "whole"), cross.write_pair_results
    calls = []

    def failing(*args, **kwargs):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return write(*args, **kwargs)

    monkeypatch.setattr(cross, "write_pair_results", failing)
    with pytest.raises(RuntimeError):
        cross.run_sweep(spark, host, viral, path, 4, 0.3, wave_pairs=1)
    assert read_pair_status(spark, path).count() == 1
    assert cross.run_sweep(spark, host, viral, path, 4, 0.3, wave_pairs=2) == 3
    assert cross.run_sweep(spark, host, viral, whole, 4, 0.3) == 4
    a, b = (read_partitioned_results(spark, p, "parquet") for p in (path, whole))
    assert tuples(a) == tuples(b)


def test_empty_results_count_as_done(spark, encoded, tmp_path):
    host, viral = encoded.where("proteome_id = 'h1'"), encoded.where("proteome_id = 'v1'")
    path = str(tmp_path / "none")
    assert cross.run_sweep(spark, host, viral, path, 4, 0.999999999) == 1
    assert read_pair_status(spark, path).first().n_results == 0
    assert cross.run_sweep(spark, host, viral, path, 4, 0.999999999) == 0


def test_screen(spark, encoded):
    h0 = encoded.where("proteome_id = 'h0'")
    scorer = MultiHeadDot(HEADS, -3.0)
    got = screen.screen(h0, 100, 0.0, scorer).collect()
    assert len(got) == 14 * 13 / 2
    res = {r.protein_id: np.array(r.residues) for r in h0.collect()}
    for r in got:
        both = [scorer.logits(res[a], res[b]).max() for a, b in ((r.query_id, r.match_id), (r.match_id, r.query_id))]
        assert r.contact_score == pytest.approx(1 / (1 + np.exp(-max(both))))
    with pytest.raises(ValueError):
        screen.screen(h0.limit(1))


def test_repeated_ids_collapse_only_on_request(spark, encoded):
    same = encoded.where("proteome_id = 'h0'").withColumn("protein_id", F.lit("p"))
    assert screen.screen(same, 3, 0.0).count() > 1
    assert screen.screen(same, 3, 0.0, by_id=True).count() == 1


def test_inventory_and_slices(spark):
    h = spark.createDataFrame([(f"h{i}",) for i in range(7)], "host_proteome string")
    v = spark.createDataFrame([("v1",), ("v0",), ("v1",)], "viral_proteome string")
    inv = sweep.pair_inventory(h, v)
    assert {(r.host_proteome, r.viral_proteome) for r in inv.collect()} == {(f"h{i}", f"v{j}") for i in range(7) for j in range(2)}
    plan = inv._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert sweep.pair_inventory(h, v.limit(0)).count() == 0
    parts = [
        {r.host_proteome for r in sweep.slice_inventory(h, 1, 3, o).collect()} for o in range(3)
    ]
    assert set().union(*parts) == {f"h{i}" for i in range(1, 7)} and sum(map(len, parts)) == 6
    back = sweep.slice_inventory(h, 0, 7, 0, reverse=True).first()
    assert back.host_proteome == "h6"
    only = sweep.restrict(inv, spark.createDataFrame([("h3",), ("x",)], "host_proteome string"))
    assert only.count() == 2
    done = spark.createDataFrame([("h1", "v0")] * 5, "host_proteome string, viral_proteome string")
    p = sweep.sweep_progress(inv, done).first()
    assert (p.n_done, p.n_total, p.percent) == (1, 14, 7)


HEAD = "viral_id,host_id,contact_score,host_is_best_contact\n"


def test_stream_of_result_files(spark, tmp_path):
    src, out, chk = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "chk")
    for machine in ("m1", "m2"):
        (src / machine).mkdir(parents=True)
    (src / "m1" / "h1__v1.csv").write_text(HEAD + "a,b,0.5,True\nc,b,0.6,False\n")
    (src / "m2" / "h1__v1.csv").write_text(HEAD + "a,b,0.5,True\nc,b,0.6,False\n")
    (src / "m1" / "run.log").write_text("still writing")
    keys = ["host_proteome", "viral_proteome", "viral_id"]

    def run():
        s = stream.stream_dedupe(stream.stream_results(spark, str(src), max_files=1), keys)
        stream.start(s, out, chk, once=True).awaitTermination()
        return spark.read.parquet(out)

    assert run().count() == 2
    # After a restart: one new pair, and a late copy of a known one.
    (src / "m2" / "h2__v1.csv").write_text(HEAD + "a,z,0.9,True\n")
    (src / "m2" / "h1__v1_copy.csv").write_text(HEAD + "a,b,0.5,True\n")
    got = run().toPandas()
    assert len(got) == 4 and set(got.host_proteome) == {"h1", "h2"}


def test_stream_progress_counts_a_pair_once(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "rows")
    src.mkdir()

    def run():
        counts = stream.stream_progress(stream.stream_results(spark, str(src), max_files=1))
        q = (
            counts.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "chk"))
            .foreachBatch(stream.keep_latest(path, ["host_proteome"])).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        return {r.host_proteome: r.n_done for r in stream.read_latest(spark, path, ["host_proteome"]).collect()}

    (src / "h1__v1.csv").write_text(HEAD + "a,b,0.5,True\nc,b,0.6,False\n")
    (src / "h1__v2.csv").write_text(HEAD + "a,b,0.5,True\n")
    assert run() == {"h1": 2}
    (src / "h2__v2.csv").write_text(HEAD + "a,b,0.5,True\n")
    assert run() == {"h1": 2, "h2": 1}


def test_snapshots_replace_old_batches(spark, tmp_path):
    """Nine batches, a snapshot after every third: what is read does not grow."""
    path = str(tmp_path / "rows")
    write, want = stream.keep_latest(path, ["k"], compact_every=3), {}
    for b in range(9):
        rows = [("a", b), (f"k{b % 4}", b * 10)]
        batch = spark.createDataFrame(rows, "k string, n long")
        write(batch, b)
        if b in (2, 5):  # a replayed batch, with its snapshot
            write(batch, b)
        want.update(rows)
        got = stream.read_latest(spark, path, ["k"])
        assert got.columns == ["k", "n"] and {r.k: r.n for r in got.collect()} == want
        # What a snapshot covers is not read again: a row put there later never shows.
        if b % 3 == 2:
            ghost = spark.createDataFrame([("ghost", b)], "k string, n long")
            ghost.write.mode("overwrite").parquet(f"{path}/batches/batch_id={b - 1}")


def test_loop_outlives_a_failed_pass(spark, tmp_path):
    src, out, waits, seen = tmp_path / "in", str(tmp_path / "out"), [], []
    src.mkdir()
    passes = iter(range(100))

    def begin():
        n = next(passes)
        (src / f"h{n}__v.csv").write_text(HEAD + "a,b,0.5,True\n")

        def write(batch, number):
            if n in (1, 2):
                raise RuntimeError("the target is away")
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        rows = stream.stream_results(spark, str(src))
        writer = rows.writeStream.option("checkpointLocation", str(tmp_path / "chk")).foreachBatch(write)
        return writer.trigger(availableNow=True).start()

    done, failures = stream.keep_running(begin, 10, 35, passes=5, on_failure=seen.append, sleep=waits.append)
    assert (done, failures) == (5, 2) and len(seen) == 2 and all("away" in str(e) for e in seen)
    assert waits == [10, 20, 35, 10]  # longer after each failure, then as before
    got = [r.host_proteome for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [f"h{n}" for n in range(5)]  # nothing lost, nothing twice
    ended = stream.keep_running(begin, passes=9, stop=lambda: True)
    assert ended == (0, 0)


def test_watermarked_dedupe(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.range(100).selectExpr("id % 10 k", "timestamp_seconds(1700000000 + id) ts").write.parquet(src)
    s = stream.stream_table(spark, src, "*.parquet", spark.read.parquet(src).schema)
    out = stream.stream_dedupe(s, ["k"], "ts", "1 hour")
    stream.start(out, str(tmp_path / "o"), str(tmp_path / "c"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 10


def test_stream_encode(spark, tmp_path):
    src = tmp_path / "fa"
    src.mkdir()
    store = EncodedStore(spark, str(tmp_path / "store"), HashedKmerEncoder(dim=4))
    (src / "a.faa").write_text(">p1\nACDE\n>p2\nGH\n")

    def run():
        encoding.stream_encode(spark, str(src), store, str(tmp_path / "chk"), once=True).awaitTermination()
        return sorted((r.proteome_id, r.protein_id, r.length) for r in store.read().collect())

    assert run() == [("a", "p1", 4), ("a", "p2", 2)]
    (src / "b.faa").write_text(">p3\nKLM\n")
    assert run() == [("a", "p1", 4), ("a", "p2", 2), ("b", "p3", 3)]
