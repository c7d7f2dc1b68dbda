"""Sweep planning over ``events``: users as hosts, event types as viral
proteomes; a pair is finished once one of its events has a value above 60."""

from pyspark.sql import functions as F

from pairscreen.functions import pair_name
from pairscreen.operators import sweep
from pairscreen.operators.grid import PairGrid
from pairscreen.sources.tables import load

DONE_ABOVE = 60.0


def _events(spark, d):
    return load(spark, d, "events").select(
        "event_id",
        "ts",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host_proteome"),
        F.col("event_type").alias("viral_proteome"),
        "value",
    )


def _inventory(spark, d):
    e = _events(spark, d)
    return sweep.pair_inventory(e.select("host_proteome"), e.select("viral_proteome"))


def _grid(spark, d):
    e = _events(spark, d)
    return PairGrid(e.select("host_proteome"), e.select("viral_proteome"))


def _done(spark, d):
    return _events(spark, d).where(F.col("value") > DONE_ABOVE)


def pair_inventory(spark, d):
    return _inventory(spark, d)


def pending_pairs(spark, d):
    grid = _grid(spark, d)
    return grid.pairs(grid.free(_done(spark, d))).select("host_proteome", "viral_proteome")


def sweep_progress(spark, d):
    return _grid(spark, d).progress(_done(spark, d))


def pending_ranges(spark, d):
    """Gaps of each host's finished pairs, with the pending pairs before each."""
    return _grid(spark, d).placed(_done(spark, d))


def pair_names(spark, d):
    return _inventory(spark, d).select(pair_name("host_proteome", "viral_proteome").alias("name"))


def worklist_join(spark, d):
    lines = load(spark, d, "customer").select(
        F.concat(F.lit("  C"), F.col("c_custkey").cast("string"), F.lit(".faa \t")).alias("line")
    )
    inventory = load(spark, d, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("host_proteome")
    )
    return sweep.worklist_report(lines, inventory)


def slice_inventory(spark, d):
    names = load(spark, d, "customer").select(F.col("c_name").alias("host_proteome"))
    return sweep.slice_inventory(names, start=10, step=7, offset=3)


def residue_footprint(spark, d):
    docs = load(spark, d, "documents").select("lang", F.length("text").alias("length"))
    return sweep.residue_footprint(docs, "lang", dim=1024, bytes_per_value=2)


def merge_first_wins(spark, d):
    e = _events(spark, d)
    late = e.where("event_id % 2 = 0")
    early = e.where("event_id % 2 = 1")
    return sweep.merge_results(
        late, early, keys=["host_proteome", "viral_proteome"], order=["ts", "event_id"]
    ).select("host_proteome", "viral_proteome", "event_id", "value")


QUERIES = {
    "pair_inventory": pair_inventory,
    "pending_pairs": pending_pairs,
    "pending_ranges": pending_ranges,
    "sweep_progress": sweep_progress,
    "pair_names": pair_names,
    "worklist_join": worklist_join,
    "slice_inventory": slice_inventory,
    "residue_footprint": residue_footprint,
    "merge_first_wins": merge_first_wins,
}

_GRID = f"""
ev AS (SELECT event_id, ts, 'u' || user_id AS host_proteome, event_type AS viral_proteome, value FROM events),
h AS (SELECT host_proteome, row_number() OVER (ORDER BY host_proteome) - 1 AS host_idx
      FROM (SELECT DISTINCT host_proteome FROM ev)),
v AS (SELECT viral_proteome, row_number() OVER (ORDER BY viral_proteome) - 1 AS viral_idx
      FROM (SELECT DISTINCT viral_proteome FROM ev)),
inv AS (SELECT host_proteome, viral_proteome, host_idx, viral_idx FROM h CROSS JOIN v),
done AS (SELECT DISTINCT host_proteome, viral_proteome FROM ev WHERE value > {DONE_ABOVE}::DOUBLE)"""

SQL = {
    "pair_inventory": f"WITH {_GRID} SELECT * FROM inv",
    "pending_pairs": f"""WITH {_GRID}
        SELECT host_proteome, viral_proteome FROM inv ANTI JOIN done USING (host_proteome, viral_proteome)""",
    "pending_ranges": f"""WITH {_GRID},
        p AS (SELECT host_idx, viral_idx, viral_idx - row_number() OVER (PARTITION BY host_idx ORDER BY viral_idx) AS run
              FROM inv ANTI JOIN done USING (host_proteome, viral_proteome)),
        r AS (SELECT host_idx, min(viral_idx) AS first, max(viral_idx) AS last, count(*) AS n FROM p GROUP BY host_idx, run)
        SELECT *, (coalesce(sum(n) OVER (ORDER BY host_idx, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
               AS before FROM r""",
    "sweep_progress": f"""WITH {_GRID}
        SELECT (SELECT count(*) FROM done) AS n_done, (SELECT count(*) FROM inv) AS n_total,
               ((SELECT count(*) FROM done) * 100) // (SELECT count(*) FROM inv) AS percent""",
    "pair_names": f"WITH {_GRID} SELECT host_proteome || '__' || viral_proteome AS name FROM inv",
    "worklist_join": """
        SELECT 'C' || c_custkey AS host_proteome,
               c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer""",
    "slice_inventory": """
        WITH n AS (SELECT c_name AS host_proteome, row_number() OVER (ORDER BY c_name) - 1 AS idx
                   FROM (SELECT DISTINCT c_name FROM customer))
        SELECT host_proteome, idx FROM n WHERE idx >= 10 AND (idx - 10) % 7 = 3""",
    "residue_footprint": """
        SELECT lang, count(*) AS n_proteins, (sum(length(text)) * 1024 * 2)::BIGINT AS n_bytes
        FROM documents GROUP BY lang""",
    "merge_first_wins": f"""WITH {_GRID}
        SELECT host_proteome, viral_proteome, event_id, value FROM ev
        QUALIFY row_number() OVER (PARTITION BY host_proteome, viral_proteome ORDER BY ts, event_id) = 1""",
}
