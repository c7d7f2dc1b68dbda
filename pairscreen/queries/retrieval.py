"""Retrieval and resolution over ``embeddings``."""

from pyspark.sql import functions as F

from pairscreen.functions import inner_product, l2_normalise, multihead_logit, sigmoid
from pairscreen.operators.contacts import Dot, contact_scores
from pairscreen.operators.resolve import best_host as pick_best_host
from pairscreen.operators.resolve import dedupe_unordered, keep_above
from pairscreen.operators.retrieval import topk_inner_product
from pairscreen.operators.retrieval import topk_union as union_topk
from pairscreen.operators.sweep import candidate_counts as count_candidates
from pairscreen.queries.views import as_keys, as_queries, vectors
from pairscreen.session import materialise

TOP_K = 10
THRESHOLD = 0.58
WEIGHTS = [0.5, 0.25, 1.0, 0.75, 0.125, 2.0, 1.5, 0.375]


def _self(spark, d):
    v = vectors(spark, d)
    return topk_inner_product(as_queries(v), as_keys(v), TOP_K)


def topk_self(spark, d):
    return _self(spark, d).select("q_id", "c_id", "rank", F.round("ip", 6).alias("ip"))


def _union(spark, d):
    v = vectors(spark, d)
    host, viral = v.where("label < 8"), v.where("label >= 8")
    own = viral.withColumnRenamed("label", "viral_proteome")
    return union_topk(
        as_queries(own), as_keys(host.withColumnRenamed("label", "host_proteome")), as_keys(own), TOP_K
    )


def topk_union(spark, d):
    return _union(spark, d).select(
        "q_id", "host_proteome", "c_id", "is_host", "rank", F.round("ip", 6).alias("ip")
    )


def candidate_counts(spark, d):
    return count_candidates(_union(spark, d), ["host_proteome", "q_id"])


def _with_following(spark, d):
    """Each vector with the next one, the last with the first."""
    v = vectors(spark, d)
    before = F.pmod(F.col("vec_id") - 1, F.lit(v.count())).alias("vec_id")
    return v.join(v.select(before, F.col("vec").alias("following")), "vec_id")


def inner_products(spark, d):
    return _with_following(spark, d).select(
        "vec_id", F.round(inner_product("vec", "following"), 6).alias("ip")
    )


def l2_normalised(spark, d):
    scaled = F.transform("vec", lambda x: x.cast("double") * (F.col("label") + 2))
    unit = vectors(spark, d).select("vec_id", l2_normalise(scaled).alias("u"))
    return unit.select("vec_id", F.posexplode("u").alias("dim", "x")).select(
        "vec_id", "dim", F.round("x", 6).alias("x")
    )


def multihead(spark, d):
    return _with_following(spark, d).select(
        "vec_id", F.round(multihead_logit("vec", "following", WEIGHTS, -3.0), 6).alias("logit")
    )


def _scored_self(spark, d):
    return _self(spark, d).withColumn("contact_score", sigmoid("ip"))


def threshold_filter(spark, d):
    return keep_above(_scored_self(spark, d), THRESHOLD).select(
        "q_id", "c_id", F.round("contact_score", 6).alias("contact_score")
    )


def dedupe_pairs(spark, d):
    kept = keep_above(_scored_self(spark, d), THRESHOLD).select("q_id", "c_id", "rank", "contact_score")
    best = dedupe_unordered(kept, order=["q_id", "rank"])
    return best.select("q_id", "c_id", F.round("contact_score", 6).alias("contact_score"))


def best_host(spark, d):
    """Vectors as proteins of one residue, scored and resolved per host."""
    candidates = materialise(_union(spark, d), "candidates")
    one = vectors(spark, d).select("vec_id", F.array("vec").alias("residues"))
    scores = contact_scores(candidates, as_queries(one), as_keys(one), Dot())
    scored = candidates.join(scores.select("q_id", "c_id", "contact_score"), ["q_id", "c_id"])
    return pick_best_host(scored, THRESHOLD, by=["host_proteome", "q_id"]).select(
        "host_proteome",
        "q_id",
        "host_id",
        F.round("contact_score", 6).alias("contact_score"),
        "host_is_best_contact",
    )


QUERIES = {
    "topk_self": topk_self,
    "topk_union": topk_union,
    "candidate_counts": candidate_counts,
    "inner_product": inner_products,
    "l2_normalise": l2_normalised,
    "multihead_logit": multihead,
    "threshold_filter": threshold_filter,
    "dedupe_pairs": dedupe_pairs,
    "best_host": best_host,
}

_SELF = f"""
v AS (SELECT vec_id, embedding::DOUBLE[] AS vec, label FROM embeddings),
ranked AS (SELECT a.vec_id AS q_id, b.vec_id AS c_id, list_inner_product(a.vec, b.vec) AS ip,
                  row_number() OVER (PARTITION BY a.vec_id
                                     ORDER BY list_inner_product(a.vec, b.vec) DESC, b.vec_id) AS rank
           FROM v a CROSS JOIN v b),
top AS (SELECT q_id, c_id, rank, ip, 1.0::DOUBLE / (1.0::DOUBLE + exp(-ip)) AS score
        FROM ranked WHERE rank <= {TOP_K + 1} AND q_id <> c_id)"""

_UNION = f"""
v AS (SELECT vec_id, embedding::DOUBLE[] AS vec, label FROM embeddings),
viral AS (SELECT * FROM v WHERE label >= 8),
hosts AS (SELECT DISTINCT label AS host_proteome FROM v WHERE label < 8),
space AS (
  SELECT q.vec_id AS q_id, k.label AS host_proteome, k.vec_id AS c_id, true AS is_host,
         list_inner_product(q.vec, k.vec) AS ip
  FROM viral q JOIN v k ON k.label < 8
  UNION ALL
  SELECT q.vec_id, h.host_proteome, k.vec_id, false, list_inner_product(q.vec, k.vec)
  FROM viral q JOIN viral k ON k.label = q.label CROSS JOIN hosts h),
ranked AS (SELECT *, row_number() OVER (PARTITION BY host_proteome, q_id
                                        ORDER BY ip DESC, is_host DESC, c_id) AS rank FROM space),
cand AS (SELECT * FROM ranked WHERE rank <= {TOP_K + 1} AND NOT (NOT is_host AND q_id = c_id))"""

_HEADS = " + ".join(
    f"{w}::DOUBLE * list_inner_product(a.embedding[{8 * h + 1}:{8 * h + 8}]::DOUBLE[],"
    f" b.embedding[{8 * h + 1}:{8 * h + 8}]::DOUBLE[]) / sqrt(8.0::DOUBLE)"
    for h, w in enumerate(WEIGHTS)
)

SQL = {
    "topk_self": f"WITH {_SELF} SELECT q_id, c_id, rank::INTEGER AS rank, round(ip, 6) AS ip FROM top",
    "topk_union": f"""WITH {_UNION}
        SELECT q_id, host_proteome, c_id, is_host, rank::INTEGER AS rank, round(ip, 6) AS ip FROM cand""",
    "candidate_counts": f"""WITH {_UNION}
        SELECT host_proteome, q_id, count(*) AS n_candidates FROM cand GROUP BY ALL""",
    "inner_product": """
        SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS ip
        FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)""",
    "l2_normalise": """
        WITH c AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim,
                          unnest(embedding::DOUBLE[]) * (label + 2) AS x FROM embeddings),
             n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM c GROUP BY vec_id)
        SELECT vec_id, dim, round(x / greatest(n, 1e-12::DOUBLE), 6) AS x FROM c JOIN n USING (vec_id)""",
    "multihead_logit": f"""
        SELECT a.vec_id, round(-3.0::DOUBLE + {_HEADS}, 6) AS logit
        FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)""",
    "threshold_filter": f"""WITH {_SELF}
        SELECT q_id, c_id, round(score, 6) AS contact_score FROM top WHERE score > {THRESHOLD}::DOUBLE""",
    "dedupe_pairs": f"""WITH {_SELF}
        SELECT q_id, c_id, round(score, 6) AS contact_score FROM top WHERE score > {THRESHOLD}::DOUBLE
        QUALIFY row_number() OVER (PARTITION BY least(q_id, c_id), greatest(q_id, c_id)
                                   ORDER BY score DESC, q_id, rank) = 1""",
    "best_host": f"""WITH {_UNION},
        scored AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-ip)) AS score FROM cand),
        placed AS (SELECT *, row_number() OVER (PARTITION BY host_proteome, q_id
                                                ORDER BY score DESC, rank) AS pos FROM scored),
        tops AS (SELECT host_proteome, q_id, is_host AS top_host FROM placed WHERE pos = 1),
        best AS (SELECT * FROM placed WHERE is_host
                 QUALIFY row_number() OVER (PARTITION BY host_proteome, q_id ORDER BY pos) = 1)
        SELECT host_proteome, q_id, c_id AS host_id, round(score, 6) AS contact_score,
               top_host AS host_is_best_contact
        FROM best JOIN tops USING (host_proteome, q_id) WHERE score > {THRESHOLD}::DOUBLE""",
}
