"""Residue-level scoring and the whole screens."""

from pyspark.sql import functions as F

from pairscreen.functions import l2_normalise
from pairscreen.operators import contacts, pooling
from pairscreen.operators.retrieval import topk_inner_product
from pairscreen.plans.cross import cross_screen as screen_across
from pairscreen.plans.screen import screen
from pairscreen.queries.views import (
    DIM,
    SQL_POOLED,
    SQL_RESIDUES,
    pooled,
    residues,
    residues_long,
)
from pairscreen.session import materialise

TOP_K = 3
HEADS = [1.0, 0.5, 2.0, 0.25, 1.5, 0.75, 0.125, 3.0]
SCREEN_THRESHOLD = 0.056


def _candidates(spark, d):
    p = pooled(spark, d)
    found = topk_inner_product(
        p.select(F.col("protein").alias("q_id"), F.col("pooled").alias("vec")),
        p.select(F.col("protein").alias("c_id"), F.col("pooled").alias("vec")),
        TOP_K,
    )
    return found.select("q_id", "c_id", "rank")


def _sides(spark, d):
    r = residues(spark, d)
    return r.withColumnRenamed("protein", "q_id"), r.withColumnRenamed("protein", "c_id")


def contact_map(spark, d):
    pairs = materialise(_candidates(spark, d), "candidates")
    cells = contacts.contact_map(pairs, *_sides(spark, d), scorer=contacts.Dot())
    return cells.select("q_id", "c_id", "i", "j", F.round("prob", 6).alias("prob"))


def contact_scores(spark, d):
    pairs = materialise(_candidates(spark, d), "candidates")
    scorer = contacts.MultiHeadDot(HEADS, bias=-3.0)
    scored = contacts.contact_scores(pairs, *_sides(spark, d), scorer=scorer)
    return scored.select("q_id", "c_id", F.round("contact_score", 6).alias("contact_score"))


def contact_scores_batched(spark, d):
    """The same scores by a model of padded batches of a few maps."""
    pairs = materialise(_candidates(spark, d), "candidates")
    scorer = contacts.PaddedDot(HEADS, bias=-3.0)
    scored = contacts.contact_scores(pairs, *_sides(spark, d), scorer=scorer, cells=2_000)
    return scored.select("q_id", "c_id", F.round("contact_score", 6).alias("contact_score"))


def candidate_residues(spark, d):
    lengths = residues_long(spark, d).groupBy(F.col("protein").alias("id")).agg(
        F.count(F.lit(1)).alias("length")
    )
    return contacts.candidate_residues(_candidates(spark, d), lengths)


def _cells(df):
    return df.select("protein", F.posexplode("pooled").alias("dim", "x")).select(
        "protein", "dim", F.round("x", 6).alias("x")
    )


def mean_pool(spark, d):
    return _cells(pooled(spark, d))


def max_pool(spark, d):
    return _cells(pooling.max_pool(residues_long(spark, d), "protein", dim=DIM))


def _encoded(spark, d):
    """Proteins with their own mean as query and key vector."""
    unit = pooled(spark, d).select("protein", l2_normalise("pooled").alias("q"))
    both = unit.join(residues(spark, d), "protein")
    label = (F.col("protein") % 4).cast("string")
    return both.select(
        F.col("protein").alias("row_id"),
        F.concat(F.lit("p"), F.col("protein").cast("string")).alias("protein_id"),
        F.concat(F.lit("g"), label).alias("proteome_id"),
        "q",
        F.col("q").alias("k"),
        F.size("residues").alias("length"),
        "residues",
    )


def all_vs_all(spark, d):
    encoded = materialise(_encoded(spark, d), "encoded")
    found = screen(encoded, TOP_K, SCREEN_THRESHOLD, contacts.MultiHeadDot(HEADS, bias=-3.0))
    return found.select("query_id", "match_id", F.round("contact_score", 6).alias("contact_score"))


def cross_screen(spark, d):
    """Proteomes g0-g2 as hosts, g3 as the viral one."""
    encoded = materialise(_encoded(spark, d), "encoded")
    host, viral = encoded.where("proteome_id <> 'g3'"), encoded.where("proteome_id = 'g3'")
    scorer = contacts.MultiHeadDot(HEADS, bias=-3.0)
    results, _ = screen_across(host, viral, TOP_K, SCREEN_THRESHOLD, scorer)
    return results.withColumn("contact_score", F.round("contact_score", 6))


QUERIES = {
    "contact_map": contact_map,
    "contact_scores": contact_scores,
    "contact_scores_batched": contact_scores_batched,
    "candidate_residues": candidate_residues,
    "mean_pool": mean_pool,
    "max_pool": max_pool,
    "all_vs_all": all_vs_all,
    "cross_screen": cross_screen,
}

_CAND = f"""{SQL_RESIDUES}, {SQL_POOLED},
ranked AS (SELECT a.protein AS q_id, b.protein AS c_id,
                  row_number() OVER (PARTITION BY a.protein
                                     ORDER BY list_inner_product(a.v, b.v) DESC, b.protein) AS rank
           FROM pooled a CROSS JOIN pooled b),
cand AS (SELECT * FROM ranked WHERE rank <= {TOP_K + 1} AND q_id <> c_id)"""


def _head_sum(a, b):
    return " + ".join(
        f"{w}::DOUBLE * list_inner_product({a}[{8 * h + 1}:{8 * h + 8}], {b}[{8 * h + 1}:{8 * h + 8}])"
        f" / sqrt(8.0::DOUBLE)"
        for h, w in enumerate(HEADS)
    )


_LOGIT = f"-3.0::DOUBLE + {_head_sum('x.vec', 'y.vec')}"
_SCORES = f"""
scores AS (SELECT c.q_id, c.c_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-max({_LOGIT}))) AS score
           FROM (SELECT DISTINCT q_id, c_id FROM cand) c
           JOIN res x ON x.protein = c.q_id JOIN res y ON y.protein = c.c_id
           GROUP BY c.q_id, c.c_id)"""
_UNIT = """
unit AS (SELECT protein, list_transform(v, lambda x: x / greatest(
             sqrt(list_inner_product(v, v)), 1e-12::DOUBLE)) AS v FROM pooled)"""

SQL = {
    "contact_map": f"""WITH {_CAND}
        SELECT c.q_id, c.c_id, x.pos::INTEGER AS i, y.pos::INTEGER AS j,
               round(1.0::DOUBLE / (1.0::DOUBLE + exp(-list_inner_product(x.vec, y.vec))), 6) AS prob
        FROM cand c JOIN res x ON x.protein = c.q_id JOIN res y ON y.protein = c.c_id""",
    "contact_scores": f"""WITH {_CAND}, {_SCORES}
        SELECT q_id, c_id, round(score, 6) AS contact_score FROM scores""",
    "candidate_residues": f"""WITH {_CAND},
        n AS (SELECT protein, count(*) AS n FROM res GROUP BY protein)
        SELECT c.q_id, c.c_id, c.rank::INTEGER AS rank, x.n AS len_q, y.n AS len_c, x.n * y.n AS cells
        FROM cand c JOIN n x ON x.protein = c.q_id JOIN n y ON y.protein = c.c_id""",
    "mean_pool": f"""WITH {SQL_RESIDUES}, {SQL_POOLED}
        SELECT protein, (dim - 1)::INTEGER AS dim, round(m, 6) AS x FROM dims""",
    "max_pool": f"""WITH {SQL_RESIDUES}, {SQL_POOLED}
        SELECT protein, (dim - 1)::INTEGER AS dim, round(max(x), 6) AS x FROM cells GROUP BY ALL""",
    "all_vs_all": f"""WITH {SQL_RESIDUES}, {SQL_POOLED}, {_UNIT},
        ranked AS (SELECT a.protein AS q_id, b.protein AS c_id,
                          row_number() OVER (PARTITION BY a.protein
                              ORDER BY list_inner_product(a.v, b.v) DESC, b.protein) AS rank
                   FROM unit a CROSS JOIN unit b),
        cand AS (SELECT * FROM ranked WHERE rank <= {TOP_K + 1} AND q_id <> c_id), {_SCORES},
        best AS (SELECT s.*, c.rank FROM scores s JOIN cand c USING (q_id, c_id)
                 WHERE score > {SCREEN_THRESHOLD}::DOUBLE
                 QUALIFY row_number() OVER (PARTITION BY least(q_id, c_id), greatest(q_id, c_id)
                                            ORDER BY score DESC, q_id, rank) = 1)
        SELECT 'p' || q_id AS query_id, 'p' || c_id AS match_id, round(score, 6) AS contact_score FROM best""",
    "cross_screen": f"""WITH {SQL_RESIDUES}, {SQL_POOLED}, {_UNIT},
        hosts AS (SELECT DISTINCT protein % 4 AS h FROM unit WHERE protein % 4 <> 3),
        space AS (
          SELECT a.protein AS q_id, b.protein % 4 AS h, b.protein AS c_id, true AS is_host,
                 list_inner_product(a.v, b.v) AS ip
          FROM unit a JOIN unit b ON a.protein % 4 = 3 AND b.protein % 4 <> 3
          UNION ALL
          SELECT a.protein, hosts.h, b.protein, false, list_inner_product(a.v, b.v)
          FROM unit a JOIN unit b ON a.protein % 4 = 3 AND b.protein % 4 = 3 CROSS JOIN hosts),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY h, q_id
                                                ORDER BY ip DESC, is_host DESC, c_id) AS rank FROM space),
        cand AS (SELECT * FROM ranked WHERE rank <= {TOP_K + 1} AND q_id <> c_id), {_SCORES},
        placed AS (SELECT c.*, s.score, row_number() OVER (PARTITION BY h, c.q_id
                                                           ORDER BY s.score DESC, c.rank) AS pos
                   FROM cand c JOIN scores s ON s.q_id = c.q_id AND s.c_id = c.c_id),
        tops AS (SELECT h, q_id, is_host AS top_host FROM placed WHERE pos = 1),
        best AS (SELECT * FROM placed WHERE is_host
                 QUALIFY row_number() OVER (PARTITION BY h, q_id ORDER BY pos) = 1)
        SELECT 'g' || best.h AS host_proteome, 'g3' AS viral_proteome, 'p' || best.q_id AS viral_id,
               'p' || best.c_id AS host_id, round(score, 6) AS contact_score,
               top_host AS host_is_best_contact
        FROM best JOIN tops ON tops.h = best.h AND tops.q_id = best.q_id
        WHERE score > {SCREEN_THRESHOLD}::DOUBLE""",
}

SQL["contact_scores_batched"] = SQL["contact_scores"]
