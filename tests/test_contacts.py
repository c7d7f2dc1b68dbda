import numpy as np
import pytest

from pairscreen.operators import contacts
from pairscreen.operators.encode import HashedKmerEncoder


def protein_frames(spark, mats, parts=3):
    rows = [(i, [[float(x) for x in v] for v in m]) for i, m in enumerate(mats)]
    df = spark.createDataFrame(rows, "id long, residues array<array<float>>").repartition(parts)
    return df.withColumnRenamed("id", "q_id"), df.withColumnRenamed("id", "c_id")


def pair_frame(spark, pairs):
    return spark.createDataFrame(pairs, "q_id long, c_id long")


def scores(df):
    return {(r.q_id, r.c_id): (r.max_logit, r.contact_score) for r in df.collect()}


@pytest.fixture(scope="module")
def proteins():
    letters = np.array(list("ACDEFGHIKLMNPQRSTVWY"))
    rng = np.random.default_rng(11)
    seqs = ["".join(rng.choice(letters, n)) for n in (78, 78, 515, 1, 30)]
    return HashedKmerEncoder(dim=16).residues(seqs)


def test_a_score_does_not_depend_on_its_company(spark, proteins):
    q, c = protein_frames(spark, proteins)
    alone = scores(contacts.contact_scores(pair_frame(spark, [(0, 1)]), q, c))
    for extra in ([(2, 2)], [(0, 2), (2, 1), (3, 4), (0, 3), (4, 4)]):
        for side_bytes in (contacts.SIDE_BYTES, 3000):
            got = contacts.contact_scores(
                pair_frame(spark, [(0, 1), *extra]), q, c, side_bytes=side_bytes
            )
            assert scores(got)[(0, 1)] == alone[(0, 1)]


def test_score_is_the_sigmoid_of_the_largest_cell(spark, proteins):
    q, c = protein_frames(spark, proteins)
    scorer = contacts.MultiHeadDot([0.5, 2.0, 1.0, 0.25], bias=-1.0)
    got = scores(contacts.contact_scores(pair_frame(spark, [(0, 2), (2, 0), (3, 3)]), q, c, scorer))
    for (a, b), (logit, score) in got.items():
        x, y = proteins[a].astype(float), proteins[b].astype(float)
        want = -1.0 + sum(
            w * x[:, 4 * h : 4 * h + 4] @ y[:, 4 * h : 4 * h + 4].T / 2.0
            for h, w in enumerate([0.5, 2.0, 1.0, 0.25])
        )
        assert abs(logit - want.max()) < 1e-9
        assert abs(score - 1 / (1 + np.exp(-want.max()))) < 1e-9


def test_orientation_counts(spark, proteins):
    class OneSided:
        def logits(self, r1, r2):
            return r1[:, :1] + 0 * r2[:, :1].T

    q, c = protein_frames(spark, proteins)
    got = scores(contacts.contact_scores(pair_frame(spark, [(0, 4), (4, 0)]), q, c, OneSided()))
    assert got[(0, 4)][0] == pytest.approx(proteins[0][:, 0].max())
    assert got[(4, 0)][0] == pytest.approx(proteins[4][:, 0].max())


def test_hot_candidate_and_small_chunks(spark, proteins, monkeypatch):
    rng = np.random.default_rng(0)
    mats = [rng.standard_normal((n % 5 + 1, 8)).astype(np.float32) for n in range(60)]
    q, c = protein_frames(spark, mats)
    pairs = [(i, 0) for i in range(60)] + [(i, (i * 7) % 60) for i in range(60)]
    want = {p: (mats[p[0]].astype(float) @ mats[p[1]].astype(float).T).max() for p in pairs}
    monkeypatch.setattr(contacts, "CELLS", 10)
    for side_bytes in (contacts.SIDE_BYTES, 500):
        got = scores(
            contacts.contact_scores(pair_frame(spark, pairs), q, c, contacts.Dot(), side_bytes=side_bytes)
        )
        assert set(got) == set(want)
        assert all(abs(got[p][0] - want[p]) < 1e-12 for p in want)


def test_map_has_the_real_cells_only(spark, proteins):
    q, c = protein_frames(spark, proteins)
    cells = contacts.contact_map(pair_frame(spark, [(4, 0), (3, 4)]), q, c).toPandas()
    sizes = cells.groupby(["q_id", "c_id"]).agg(n=("i", "size"), i=("i", "max"), j=("j", "max"))
    assert sizes.loc[(4, 0)].tolist() == [30 * 78, 29, 77]
    assert sizes.loc[(3, 4)].tolist() == [30, 0, 29]
    top = scores(contacts.contact_scores(pair_frame(spark, [(4, 0)]), q, c))[(4, 0)][1]
    assert abs(cells[(cells.q_id == 4)].prob.max() - top) < 1e-12


def test_a_protein_without_residues_scores_nothing(spark, proteins):
    q, c = protein_frames(spark, [proteins[0], np.zeros((0, 16), np.float32)])
    assert set(scores(contacts.contact_scores(pair_frame(spark, [(0, 0), (0, 1), (1, 0)]), q, c))) == {(0, 0)}


def test_no_pairs(spark, proteins):
    q, c = protein_frames(spark, proteins)
    assert contacts.contact_scores(pair_frame(spark, [(0, 0)]).limit(0), q, c).count() == 0


def test_the_larger_side_gets_more_blocks():
    mb = 1 << 20
    assert contacts.tile_counts(100 * mb, 100 * mb, 8, 128 * mb) == (4, 4)
    n_qb, n_cb = contacts.tile_counts(mb, 10_000 * mb, 32, 128 * mb)
    assert n_qb == 1 and n_cb >= 79
    n_qb, n_cb = contacts.tile_counts(0, 0, 8, 128 * mb)
    assert n_qb * n_cb >= 8


def test_volume_is_read_from_lengths(spark, proteins):
    q, _ = protein_frames(spark, proteins)
    want = sum(len(p) for p in proteins) * 16 * 4
    from pyspark.sql import functions as F

    assert contacts.residue_bytes(q, "residues") == want
    assert contacts.residue_bytes(q.withColumn("length", F.size("residues")), "residues") == want


def model():
    """Made inside a function, so that tasks get it by value."""

    class Model:
        """A scorer that has to be loaded, and whose padding would win."""

        def __init__(self, ready=False):
            self.ready = ready

        def load(self):
            return type(self)(ready=True)

        def batch(self, r1, r2, real1, real2):
            assert self.ready and r1.shape[0] == r2.shape[0] == len(real1) == len(real2)
            logits = np.matmul(r1.astype(float), r2.astype(float).transpose(0, 2, 1))
            return np.where(real1[:, :, None] & real2[:, None, :], logits, 1e9)

        def logits(self, r1, r2):
            assert self.ready
            return r1.astype(float) @ r2.astype(float).T

    return Model()


@pytest.mark.parametrize("cells, held", [(1, 1), (500, 7), (1 << 22, 8_192)])
def test_batches_do_not_change_the_scores(spark, monkeypatch, cells, held):
    rng = np.random.default_rng(4)
    mats = [rng.standard_normal((n, 8)).astype(np.float32) - 3 for n in (1, 40, 3, 17, 3, 90)]
    monkeypatch.setattr(contacts, "HELD_PAIRS", held)
    q, c = protein_frames(spark, mats)
    pairs = [(i, j) for i in range(6) for j in range(6)]
    got = scores(contacts.contact_scores(pair_frame(spark, pairs), q, c, model(), cells=cells))
    assert got.keys() == set(pairs)
    for (i, j), (logit, _) in got.items():
        assert abs(logit - (mats[i].astype(float) @ mats[j].astype(float).T).max()) < 1e-9
    cell = contacts.contact_map(pair_frame(spark, [(0, 2)]), q, c, model()).orderBy("j").collect()
    assert [r.j for r in cell] == [0, 1, 2]


def test_padded_default_scorer_agrees_with_the_default(spark, proteins):
    q, c = protein_frames(spark, proteins)
    pairs = pair_frame(spark, [(a, b) for a in range(5) for b in range(5)])
    one = scores(contacts.contact_scores(pairs, q, c, contacts.MultiHeadDot([0.5, 2.0], bias=-1.0)))
    other = scores(contacts.contact_scores(pairs, q, c, contacts.PaddedDot([0.5, 2.0], bias=-1.0), cells=50_000))
    assert one.keys() == other.keys() and all(abs(one[p][0] - other[p][0]) < 1e-9 for p in one)


def test_length_batches_hold_all_pairs_within_the_budget():
    rng = np.random.default_rng(0)
    shapes = [tuple(x) for x in rng.integers(1, 60, (200, 2)).tolist()]
    batches = list(contacts.length_batches(shapes, 5_000))
    assert sorted(n for b in batches for n in b) == list(range(200))
    for b in batches:
        area = len(b) * max(shapes[n][0] for n in b) * max(shapes[n][1] for n in b)
        assert len(b) == 1 or area <= 5_000
    assert len(batches) < 100
