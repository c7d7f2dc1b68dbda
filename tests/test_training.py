import math

import numpy as np
import pytest

from pairscreen.functions import composite_key
from pairscreen.operators import cell_losses, in_batch, knowns, metrics, negatives, sampling, training
from pairscreen.operators.pooling import gather_residues, max_pool, mean_pool, spread_residues

CL = "seq1_cluster long, seq2_cluster long"


def test_interaction_keys_are_symmetric_and_distinct(spark):
    a = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 4), (-1, 5)], CL)
    b = spark.createDataFrame([(1, 2), (7, 8)], CL)
    got = {tuple(r) for r in knowns.interaction_keys(a, b).collect()}
    assert got == {(1, 2), (2, 1), (3, 3), (7, 8), (8, 7)}
    keyed = knowns.interaction_keys(b, multiplier=1000).collect()
    assert {r.key for r in keyed} == {1002, 2001, 7008, 8007}


def test_multiplier_guard(spark):
    big = spark.createDataFrame([(1_000_000, 2)], CL)
    with pytest.raises(ValueError):
        knowns.check_multiplier(big)
    with pytest.raises(Exception, match="multiplier"):
        big.select(composite_key("seq1_cluster", "seq2_cluster")).collect()
    assert knowns.check_multiplier(spark.createDataFrame([(None, 2)], CL)) is None
    assert knowns.interaction_keys(spark.createDataFrame([], CL)).count() == 0


def test_mark_known(spark):
    known = spark.createDataFrame([(1, 2)], "c1 long, c2 long")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (None, 2)], "c1 long, c2 long")
    assert sorted(r.known for r in knowns.mark_known(pairs, known).collect()) == [False, False, True]
    assert knowns.mark_known(pairs, known, how="semi").count() == 1
    assert knowns.mark_known(pairs, known, how="anti").count() == 2


def test_cluster_members(spark):
    df = spark.createDataFrame([(1, 5, 5), (2, 5, 6), (3, None, 6)], f"ex long, {CL}")
    got = {tuple(r) for r in knowns.cluster_members(df, "ex").collect()}
    assert got == {(5, 1), (5, 2), (6, 2)}
    s = knowns.dataset_summary(df).first()
    assert (s.n_examples, s.n_without_clusters, s.n_clusters) == (3, 1, 2)


def batch(spark, n, clusters=None):
    rng = np.random.default_rng(n)
    q, k = rng.standard_normal((n, 4)), rng.standard_normal((n, 4))
    c = clusters or [(-1, -1)] * n
    rows = [(0, i, c[i][0], c[i][1], q[i].tolist(), k[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(
        rows, "batch_id long, idx long, c1 long, c2 long, q array<double>, k array<double>"
    )
    return q, k, df


def idx_pairs(df):
    return sorted((r.idx1, r.idx2) for r in df.collect())


def test_random_negatives(spark):
    _, _, df = batch(spark, 4)
    assert idx_pairs(negatives.random_negatives(df, 1.0)) == [(0, 1), (1, 2), (2, 3), (3, 0)]
    assert idx_pairs(negatives.random_negatives(df, 0)) == []
    got = idx_pairs(negatives.random_negatives(df, 1.6))  # int(6.4) = 6: two of the second shift
    assert got == sorted([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3)])
    assert len(idx_pairs(negatives.random_negatives(df, 4.0))) == 12  # the wrap onto itself is left out
    assert len(idx_pairs(negatives.random_negatives(df, 4.0, keep_wraps=True))) == 16
    assert idx_pairs(negatives.random_negatives(batch(spark, 1)[2], 2.5)) == []


def test_known_pairs_are_no_negatives(spark):
    clusters = [(1, 2), (3, 4), (5, 6), (-1, -1)]
    _, _, df = batch(spark, 4, clusters)
    known = spark.createDataFrame([(1, 4), (1, 2), (3, 2), (3, 6), (5, 5)], "c1 long, c2 long")
    bad = {(0, 1), (0, 0), (1, 0), (1, 2)}
    every = negatives.all_negatives(df, {"random": 3.0, "self": 1.0, "hard": 3.0}, known)
    got = {(r.idx1, r.idx2, r.source) for r in every.collect()}
    assert not {(a, b) for a, b, _ in got} & bad
    assert {s for _, _, s in got} == {"random", "self", "hard"}
    all_known = spark.createDataFrame([(a, b) for a in (1, 3, 5) for b in (2, 4, 6)], "c1 long, c2 long")
    left = negatives.random_negatives(df.where("idx < 3"), 2.0, all_known)
    assert left.count() == 0


def test_self_negatives(spark):
    _, _, df = batch(spark, 5)
    assert idx_pairs(negatives.self_negatives(df, 0.7)) == [(0, 0), (1, 1), (2, 2)]
    assert len(idx_pairs(negatives.self_negatives(df, 2.5))) == 5


def test_hard_negatives(spark):
    q, k, df = batch(spark, 6, [(1, 9)] * 3 + [(2, 8)] * 3)
    known = spark.createDataFrame([(1, 8)], "c1 long, c2 long")
    got = idx_pairs(in_batch.hard_negatives(df, 3.0, known))
    sim = q @ k.T
    np.fill_diagonal(sim, -np.inf)
    sim[:3, 3:] = -np.inf
    want = []
    for i in range(6):
        order = [j for j in np.argsort(-sim[i]) if np.isfinite(sim[i, j])][:3]
        want += [(i, int(j)) for j in order]  # the first rows have two only
    assert got == sorted(want)


def test_batch_losses(spark):
    q, k, df = batch(spark, 7, [(i % 2, i % 3) for i in range(7)])
    known = spark.createDataFrame([(0, 1), (1, 2)], "c1 long, c2 long")
    losses = in_batch.in_batch_losses(df, 3.0, known)
    x = 3.0 * q @ k.T
    for i in range(7):
        for j in range(7):
            if i != j and (i % 2, j % 3) in {(0, 1), (1, 2)}:
                x[i, j] = -1e4
    row = np.log(np.exp(x).sum(1)) - np.diag(x)
    col = np.log(np.exp(x).sum(0)) - np.diag(x)
    assert in_batch.info_nce(losses).first().loss == pytest.approx((row.mean() + col.mean()) / 2)
    assert in_batch.top1_accuracy(losses).first().top1_acc == pytest.approx((x.argmax(1) == np.arange(7)).mean())
    top = {(r.idx, r["rank"]): r.match for r in in_batch.in_batch_topk(df, 2).collect()}
    assert all(top[(i, 1)] == int((q @ k.T)[i].argmax()) for i in range(7))


def _all_results(df, known):
    losses = {(r.batch_id, r.idx): (r.row_ce, r.col_ce, r.top) for r in in_batch.in_batch_losses(df, 3.0, known).collect()}
    top = sorted(map(tuple, in_batch.in_batch_topk(df, 4).collect()), key=repr)
    hard = sorted((r.batch_id, r.idx1, r.idx2) for r in in_batch.hard_negatives(df, 3.0, known).where("batch_id = 0").collect())
    return losses, top, hard


@pytest.mark.parametrize("tile", [1, 7, 20])
def test_batches_of_any_size(spark, monkeypatch, tile):
    """Tiles give what one matrix gives, with a hub, equal vectors and two batches."""
    rng = np.random.default_rng(2)
    rows = []
    for b, n in ((0, 45), (None, 6)):
        for i in range(n):
            q, k = (rng.integers(-2, 3, 3).astype(float).tolist() for _ in range(2))
            rows.append((b, i, q, k, int(rng.integers(-1, 6)), int(rng.integers(-1, 6))))
    df = spark.createDataFrame(rows, "batch_id long, idx long, q array<double>, k array<double>, c1 long, c2 long")
    known = spark.createDataFrame([(0, c) for c in range(6)] + [(2, 3), (4, 1)], "c1 long, c2 long")
    monkeypatch.setattr(in_batch, "FEW_PARTNERS", 3)
    want = _all_results(df, known)
    monkeypatch.setattr(in_batch, "TILE", tile)
    got = _all_results(df, known)
    assert got[1:] == want[1:] and got[0].keys() == want[0].keys()
    for key, (row, col, top) in want[0].items():
        assert got[0][key][:2] == pytest.approx((row, col), abs=1e-9) and got[0][key][2] == top


def test_mean_of_batches_ignores_their_size(spark):
    df = spark.createDataFrame([(0, 1.0, 10), (1, 3.0, 1)], "batch_id long, loss double, n_rows long")
    assert in_batch.mean_batch_loss(df).first().loss == 2.0


def test_cell_losses(spark):
    x, y = [-80.0, 0.3, 60.0, 2.0], [0, 1, 1, 0]
    df = spark.createDataFrame(list(zip(x, y)), "logit double, target int")
    x, y = np.array(x), np.array(y)
    bce = np.maximum(x, 0) - x * y + np.log1p(np.exp(-abs(x)))
    assert cell_losses.contact_bce(df).first().bce == pytest.approx(bce.mean())
    focal = np.where(y, 0.25, 0.75) * (1 - np.exp(-bce)) ** 2 * bce
    assert cell_losses.contact_focal(df).first().focal == pytest.approx(focal.sum() / 2)
    none = df.where("target = 0")
    assert cell_losses.contact_focal(none).first().focal == pytest.approx(focal[y == 0].sum())
    empty = df.where("false")
    assert cell_losses.contact_bce(empty).first().bce == 0 == cell_losses.contact_focal(empty).first().focal


CONTACTS = "id long, len1 int, len2 int, contacts array<struct<i:int,j:int>>"


def test_clip_contacts(spark):
    rows = [(1, 3, 9, [(0, 0), (3, 0), (2, 8), (2, 5), (2, 5)]), (2, 3, 3, None), (3, 3, 3, [])]
    got = {r.id: [tuple(c) for c in r.contacts] for r in training.clip_contacts(spark.createDataFrame(rows, CONTACTS), 6).collect()}
    assert got == {1: [(0, 0), (2, 5), (2, 5)], 2: [], 3: []}
    cells = training.contact_cells(spark.createDataFrame(rows, CONTACTS), 6).toPandas()
    assert len(cells) == 18 + 9 + 9 and cells.target.sum() == 2
    assert set(map(tuple, cells[cells.target == 1][["i", "j"]].values)) == {(0, 0), (2, 5)}


def test_swap_and_records(spark):
    rows = [(i, "A" * 9, "C" * 4, 1, None, [(8, 3), (0, 1)]) for i in range(200)]
    df = spark.createDataFrame(
        rows, f"id long, seq1 string, seq2 string, {CL}, contacts array<struct<i:int,j:int>>"
    )
    got = training.training_records(df, "id", max_len=8, special=2, seed=3).collect()
    assert 60 < sum(r.swapped for r in got) < 140
    for r in got:
        one = ("C" * 4, "A" * 6, 4, 6, -1, 1) if r.swapped else ("A" * 6, "C" * 4, 6, 4, 1, -1)
        assert (r.seq1, r.seq2, r.len1, r.len2, r.seq1_cluster, r.seq2_cluster) == one
        # (8, 3) lies outside the map of 6
        assert [tuple(c) for c in r.contacts] == ([(1, 0)] if r.swapped else [(0, 1)])
    plain = training.training_records(df, "id", swap=0.0)
    assert plain.where("swapped").count() == 0
    other = training.training_records(df, "id", max_len=8, special=2, seed=3, epoch=1)
    assert {r.id for r in other.where("swapped").collect()} != {r.id for r in got if r.swapped}


def test_unions(spark):
    main = spark.createDataFrame([(1, 5, None)], f"id long, {CL}")
    ddi = spark.createDataFrame([(2,)], "id long")
    got = {r.id: (r.seq1_cluster, r.seq2_cluster) for r in training.append_ddi(main, ddi).collect()}
    assert got == {1: (5, -1), 2: (-1, -1)}
    twice = training.symmetric_union(main, [("seq1_cluster", "seq2_cluster")], "id", 10).collect()
    assert {(r.id, r.seq1_cluster, r.seq2_cluster, r.swapped) for r in twice} == {
        (1, 5, None, False), (11, None, 5, True)
    }
    assert training.union_splits(main, main, ddi).count() == 3


def test_truncate_and_residues(spark):
    df = spark.createDataFrame([(1, "ACDEF"), (2, ""), (3, "é\nb")], "id long, sequence string")
    assert {r.id: r.length for r in training.truncate(df, 4, special=2).collect()} == {1: 2, 2: 0, 3: 2}
    got = sorted((r.id, r.pos, r.residue) for r in training.residue_rows(df, max_len=3).collect())
    assert got == [(1, 0, "A"), (1, 1, "C"), (1, 2, "D"), (3, 0, "é"), (3, 1, "\n"), (3, 2, "b")]
    with pytest.raises(ValueError):
        training.require_min(df, 4)


def test_cluster_sample(spark):
    rows = [(i, 0 if i < 300 else i, i % 7) for i in range(400)] + [(1000 + i, None, 1) for i in range(50)]
    df = spark.createDataFrame(rows, f"ex long, {CL}")
    got = sampling.cluster_sample(df, "ex", n=4000, p=0.25, seed=1).toPandas()
    assert len(got) == 4000 and got.draw.nunique() == 4000
    loose = got[got.cluster == -1]
    assert set(loose.ex) <= set(range(1000, 1050)) and 0.2 < len(loose) / 4000 < 0.3
    # Clusters are drawn uniformly, whatever their size: cluster 0 holds most examples.
    n_clusters = len({c for _, a, b in rows if a is not None for c in (a, b)})
    share = (got.cluster == 0).sum() / (4000 - len(loose))
    assert share < 4 / n_clusters
    members = {(c, ex) for ex, a, b in rows if a is not None for c in (a, b)}
    assert {(c, e) for c, e in zip(got.cluster, got.ex) if c != -1} <= members
    again = sampling.cluster_sample(df, "ex", n=4000, p=0.25, seed=1).toPandas()
    assert got.sort_values("draw").ex.tolist() == again.sort_values("draw").ex.tolist()
    later = sampling.cluster_sample(df, "ex", n=4000, p=0.25, seed=1, epoch=1).toPandas()
    assert got.sort_values("draw").ex.tolist() != later.sort_values("draw").ex.tolist()


def test_cluster_sample_falls_back(spark):
    loose = spark.createDataFrame([(i, None, None) for i in range(5)], f"ex long, {CL}")
    got = sampling.cluster_sample(loose, "ex", p=0.0).toPandas()
    assert len(got) == 5 and (got.cluster == -1).all()
    tied = spark.createDataFrame([(i, 1, 2) for i in range(5)], f"ex long, {CL}")
    got = sampling.cluster_sample(tied, "ex", p=1.0).toPandas()
    assert len(got) == 5 and (got.cluster > 0).all()


def rank_oracle(q, k, valid):
    out = []
    for i in range(len(q)):
        s = k @ q[i]
        order = np.lexsort((np.arange(len(k)), -s))
        out.append(next((p + 1 for p, j in enumerate(order) if valid(i, j)), len(k) + 1))
    return out


@pytest.mark.parametrize("own", [True, False])
def test_first_valid_rank(spark, own):
    rng = np.random.default_rng(4)
    q, k = rng.integers(-2, 3, (60, 4)).astype(float), rng.integers(-2, 3, (60, 4)).astype(float)
    c1, c2 = rng.integers(-1, 6, 60), rng.integers(-1, 6, 60)
    pairs = {(1, 2), (2, 1), (3, 3), (1, 5)}
    known = spark.createDataFrame(sorted(pairs), "c1 long, c2 long")
    schema = "{} long, vec array<double>, cluster long"
    qs = spark.createDataFrame([(i, q[i].tolist(), int(c1[i])) for i in range(60)], schema.format("q_id"))
    ks = spark.createDataFrame([(i, k[i].tolist(), int(c2[i])) for i in range(60)], schema.format("c_id"))
    got = metrics.first_valid_rank(qs, ks, known, own, query_block=16, key_shard=17).orderBy("q_id").collect()
    valid = lambda i, j: (own and i == j) or (int(c1[i]), int(c2[j])) in pairs
    assert [r["rank"] for r in got] == rank_oracle(q, k, valid)


def test_metric_rows(spark):
    ranks = spark.createDataFrame([(i, r) for i, r in enumerate([1, 3, 6, 9])], "q_id long, rank long")
    got = {r.metric: r.value for r in metrics.rank_metrics(ranks, "x").collect()}
    assert got == {"x_mean_rank": 4.75, "x_median_rank": 4.0, "x_R@1": 0.25, "x_R@5": 0.5, "x_R@10": 1.0}
    long = metrics.metrics_long(metrics.rank_metrics(ranks, "x"), 5).collect()
    assert {r.step for r in long} == {5} and all(r.metric.startswith("eval/x_") for r in long)


def test_both_directions_at_once(spark):
    rng = np.random.default_rng(8)
    q, k = rng.integers(-2, 3, (40, 4)).astype(float), rng.integers(-2, 3, (40, 4)).astype(float)
    c = rng.integers(-1, 5, (40, 2))
    pairs = {(1, 2), (3, 0), (4, 4)}
    rows = [(i, q[i].tolist(), k[i].tolist(), int(c[i, 0]), int(c[i, 1])) for i in range(40)]
    df = spark.createDataFrame(rows, "idx long, q array<double>, k array<double>, c1 long, c2 long")
    known = spark.createDataFrame(sorted(pairs), "c1 long, c2 long")
    got = {r.metric: r.value for r in metrics.retrieval_metrics(df, known, query_block=9, key_shard=11).collect()}
    for name, a, b, valid in (
        ("seq1_to_seq2", q, k, lambda i, j: i == j or (int(c[i, 0]), int(c[j, 1])) in pairs),
        ("seq2_to_seq1", k, q, lambda i, j: i == j or (int(c[j, 0]), int(c[i, 1])) in pairs),
    ):
        ranks = np.array(rank_oracle(a, b, valid))
        assert got[f"{name}_mean_rank"] == pytest.approx(ranks.mean())
        assert got[f"{name}_median_rank"] == math.floor(np.median(ranks))
        assert got[f"{name}_R@5"] == pytest.approx((ranks <= 5).mean())


def test_exact_median(spark):
    for values in ([5], [1, 2], [1, 1, 1, 9], [4, 8, 15, 16, 23]):
        df = spark.createDataFrame([(v,) for v in values], "rank long")
        assert metrics.exact_floor_median(df, "rank").first().value == math.floor(np.median(values))


def test_pooling(spark):
    rows = [(1, 0, [1.0, -5.0]), (1, 1, [3.0, -1.0]), (2, 0, None)]
    df = spark.createDataFrame(rows, "p long, pos int, vec array<float>")
    assert {r.p: r.pooled for r in mean_pool(df, "p").collect()} == {1: [2.0, -3.0], 2: [0.0, 0.0]}
    assert {r.p: r.pooled for r in max_pool(df, "p").collect()} == {1: [3.0, -1.0], 2: [0.0, 0.0]}
    packed = gather_residues(df.where("p = 1"), "p", "pos", "vec")
    assert packed.first().residues == [[1.0, -5.0], [3.0, -1.0]]
    assert sorted((r.pos, r.vec) for r in spread_residues(packed).collect()) == [(0, [1.0, -5.0]), (1, [3.0, -1.0])]


@pytest.mark.parametrize("few", [0, 1, 32])
def test_hubs_and_others_give_the_same_known_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(in_batch, "FEW_PARTNERS", few)
    _, _, df = batch(spark, 6, [(1, 2), (1, 3), (4, 2), (-1, 3), (5, -1), (7, 9)])
    pairs = {(1, 2), (1, 3), (1, 8), (4, 3), (6, 2), (7, 7)}
    known = spark.createDataFrame(sorted(pairs), "c1 long, c2 long")
    got = sorted((r.c1, r.c2) for r in in_batch.known_in_batch(df, known).collect())
    assert got == [(1, 2), (1, 3), (4, 3)]


def test_doubled_batches(spark):
    _, _, df = batch(spark, 3, [(1, 2), (3, 4), (5, 6)])
    twice = training.symmetric_union(df, [("q", "k"), ("c1", "c2")], "idx", 3)
    assert sorted((r.idx, r.c1) for r in twice.collect()) == [(0, 1), (1, 3), (2, 5), (3, 2), (4, 4), (5, 6)]
    assert idx_pairs(negatives.random_negatives(twice, 1.0)) == [(i, (i + 1) % 6) for i in range(6)]
