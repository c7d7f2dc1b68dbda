"""Host/viral screens: one pair of proteomes, or a resumable sweep over many.

What the sweep does once rather than once per pair: search a viral proteome
against itself, and score a (query, candidate) pair that comes up for many
hosts.
"""

from pyspark.sql import functions as F

from pairscreen.operators.contacts import contact_scores
from pairscreen.operators.grid import PairGrid, cut
from pairscreen.operators.resolve import best_host
from pairscreen.operators.retrieval import topk_union
from pairscreen.operators.sweep import candidate_counts
from pairscreen.operators.training import require_min
from pairscreen.session import materialise
from pairscreen.sources.results import PAIR, read_pair_status, write_pair_results

THRESHOLD = 0.4
WAVE_PAIRS = 10_000


def cross_candidates(host, viral, top_k=100, pairs=None):
    """Candidates of every viral protein per host proteome, optionally only for
    the given ``(host_proteome, viral_proteome)`` pairs.  Frames carry
    ``proteome_id``, ``row_id`` (unique over both), ``q`` and ``k``."""
    queries = viral.select(
        F.col("row_id").alias("q_id"), F.col("q").alias("vec"), F.col("proteome_id").alias("viral_proteome")
    )
    own = viral.select(
        F.col("row_id").alias("c_id"), F.col("k").alias("vec"), F.col("proteome_id").alias("viral_proteome")
    )
    keys = host.select(
        F.col("row_id").alias("c_id"), F.col("k").alias("vec"), F.col("proteome_id").alias("host_proteome")
    )
    found = topk_union(queries, keys, own, top_k)
    found = found.join(queries.select("q_id", "viral_proteome"), "q_id")
    return found if pairs is None else found.join(pairs.select(*PAIR), PAIR, "left_semi")


def cross_screen(host, viral, top_k=100, threshold=THRESHOLD, scorer=None, pairs=None):
    """``(results, candidates)``: the best host protein of each viral protein
    per pair of proteomes, and the candidate table behind it."""
    require_min(host, 1, "host sequences")
    require_min(viral, 1, "viral sequences")
    candidates = materialise(cross_candidates(host, viral, top_k, pairs), "candidates")
    cols = ["row_id", "length", "residues"]
    everyone = host.select(*cols).unionByName(viral.select(*cols))
    scores = contact_scores(
        candidates,
        viral.select(F.col("row_id").alias("q_id"), "length", "residues"),
        everyone.withColumnRenamed("row_id", "c_id"),
        scorer,
    )
    scored = candidates.join(scores.select("q_id", "c_id", "contact_score"), ["q_id", "c_id"])
    best = best_host(scored, threshold, by=[*PAIR, "q_id"])
    vnames = viral.select(F.col("row_id").alias("q_id"), F.col("protein_id").alias("viral_id"))
    hnames = host.select(F.col("row_id").alias("host_row"), F.col("protein_id").alias("host_id"))
    results = (
        best.withColumnRenamed("host_id", "host_row")
        .join(vnames, "q_id")
        .join(hnames, "host_row")
        .select(*PAIR, "viral_id", "host_id", "contact_score", "host_is_best_contact")
    )
    return results, candidates


def run_sweep(
    spark, host, viral, path, top_k=100, threshold=THRESHOLD, scorer=None, hosts=None, wave_pairs=WAVE_PAIRS
):
    """Work on every pair that ``path`` has no status row for, and record it,
    in waves of ``wave_pairs`` pairs that are committed one by one: stopped and
    started again, only the wave in hand is worked on twice.  A wave holds the
    pairs of neighbouring hosts, and only proteomes with a pending pair in it
    are searched.  Returns the number of pairs worked on."""
    names = host.select(F.col("proteome_id").alias("host_proteome"))
    if hosts is not None:
        names = names.join(hosts, "host_proteome", "left_semi")
    grid = PairGrid(names, viral.select(F.col("proteome_id").alias("viral_proteome")))
    todo = materialise(grid.placed(_done(spark, path)), "pending")
    n = todo.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    for start in range(0, n, wave_pairs):
        # Ranges become pairs a wave at a time.
        pairs = materialise(grid.pairs(cut(todo, start, start + wave_pairs)).select(*PAIR), "wave")
        results, candidates = cross_screen(
            _busy(host, pairs, "host_proteome"),
            _busy(viral, pairs, "viral_proteome"),
            top_k,
            threshold,
            scorer,
            pairs,
        )
        write_pair_results(
            materialise(results, "results"), pairs, path, candidate_counts(candidates, PAIR), fmt="parquet"
        )
    return n


def _busy(proteins, pairs, side):
    """Proteins of proteomes that have a pair to work on."""
    return proteins.join(pairs.select(F.col(side).alias("proteome_id")).distinct(), "proteome_id", "left_semi")


def _done(spark, path):
    try:
        return read_pair_status(spark, path).select(*PAIR)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "host_proteome string, viral_proteome string")
