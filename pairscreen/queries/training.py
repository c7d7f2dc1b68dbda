"""Training-pair preparation over ``lineitem``, ``documents`` and ``embeddings``."""

from pyspark.sql import functions as F

from pairscreen.functions.numbers import KEY_MULTIPLIER
from pairscreen.operators import in_batch, knowns, negatives, sampling, training
from pairscreen.queries.views import (
    SQL_INTERACTIONS,
    SQL_PAIRS,
    SQL_WHOLE,
    batched_pairs,
    interactions,
    same_label,
    whole_batch,
)
from pairscreen.sources.tables import load

EXAMPLE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
CLUSTERS = ["seq1_cluster", "seq2_cluster"]
SEED = 42
RATIOS = {"random": 2.5, "self": 0.6, "hard": 2.0}


def interaction_keys(spark, d):
    """Rows are pairs; above the multiplier their key is no longer one pair's alone."""
    return knowns.interaction_keys(interactions(spark, d), multiplier=KEY_MULTIPLIER, unique=False)


def cluster_index(spark, d):
    return knowns.cluster_index(interactions(spark, d), EXAMPLE)


def cluster_normalise(spark, d):
    return knowns.normalise_clusters(interactions(spark, d)).select(*EXAMPLE, *CLUSTERS)


def known_mask(spark, d):
    """Is an item's part and supplier known from the interactions?"""
    known = knowns.interaction_keys(interactions(spark, d))
    pairs = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("c1"), F.col("l_suppkey").alias("c2")
    )
    return knowns.mark_known(pairs, known)


def dataset_summary(spark, d):
    return knowns.dataset_summary(interactions(spark, d))


def symmetric_union(spark, d):
    rows = knowns.normalise_clusters(interactions(spark, d))
    return training.symmetric_union(
        rows.select("l_orderkey", "l_linenumber", *CLUSTERS), [tuple(CLUSTERS)]
    )


def ddi_union(spark, d):
    rows = interactions(spark, d)
    main = rows.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", *CLUSTERS)
    ddi = rows.where("l_returnflag <> 'A'").select("l_orderkey", "l_linenumber")
    return training.append_ddi(main, ddi)


def split_union(spark, d):
    """Order status as split: every split on its own, then all together."""
    rows = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split"))
    return training.union_splits(*[rows.where(F.col("split") == s) for s in ("F", "O", "P")])


def _batch(spark, d):
    return batched_pairs(spark, d)


def random_negatives(spark, d):
    return negatives.random_negatives(_batch(spark, d), RATIOS["random"], same_label(spark, d))


def self_negatives(spark, d):
    return negatives.self_negatives(_batch(spark, d), RATIOS["self"], same_label(spark, d))


def hard_negatives(spark, d):
    return in_batch.hard_negatives(_batch(spark, d), RATIOS["hard"], same_label(spark, d))


def hard_negatives_whole(spark, d):
    return in_batch.hard_negatives(whole_batch(spark, d), RATIOS["hard"], same_label(spark, d), tile=64)


def all_negatives(spark, d):
    return negatives.all_negatives(_batch(spark, d), RATIOS, same_label(spark, d))


def _contact_lists(spark, d):
    """One example per order: its lines are contacts, the number of lines and
    the mean quantity its two lengths."""
    contact = F.struct(
        F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("int").alias("j")
    )
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(contact).alias("contacts"),
        F.count(F.lit(1)).cast("int").alias("len1"),
        F.floor(F.avg("l_quantity")).cast("int").alias("len2"),
    )


def clip_contacts(spark, d):
    clipped = training.clip_contacts(_contact_lists(spark, d), 32)
    return clipped.select("l_orderkey", F.inline("contacts"))


MAP = 512


def labelled_cells(spark, d):
    """All cells of the maps of all orders, summed up per map."""
    rows = _contact_lists(spark, d)
    positive = training.contact_cells(rows, MAP)
    negative = training.contact_cells(rows.withColumn("l_orderkey", -F.col("l_orderkey") - 1), MAP)
    cells = training.label_cells(positive, negative.drop("target"))
    return cells.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.sum("target").alias("n_targets"),
        F.sum(F.col("i") * F.col("target")).alias("sum_i"),
        F.sum(F.col("j") * F.col("target")).alias("sum_j"),
    )


def swap_augment(spark, d):
    swapped = training.swap_augment(
        _contact_lists(spark, d), "l_orderkey", [("len1", "len2")], SEED, 0.5
    )
    return swapped.select("l_orderkey", "swapped", "len1", "len2", F.inline("contacts"))


def training_records(spark, d):
    """Each document with the one before it (none before the first), whole texts,
    labels as clusters."""
    docs = load(spark, d, "documents")
    labels = load(spark, d, "labels")
    contact = F.struct(F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("int").alias("j"))
    lists = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.collect_list(contact).alias("contacts")
    )
    rows = (
        docs.select("doc_id", F.col("text").alias("seq1"))
        .join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("seq2")), "doc_id", "left")
        .withColumn("seq2", F.coalesce("seq2", F.lit("")))
        .join(lists, "doc_id", "left")
        .join(
            labels.select("doc_id", F.col("quality").alias("seq1_cluster"), F.col("toxic").alias("seq2_cluster")),
            "doc_id",
            "left",
        )
    )
    made = training.training_records(rows, "doc_id", seed=SEED)
    return made.select(
        "doc_id",
        "swapped",
        "len1",
        "len2",
        "seq1_cluster",
        "seq2_cluster",
        F.size("contacts").alias("n_contacts"),
        F.md5("seq1").alias("seq1_md5"),
        F.md5("seq2").alias("seq2_md5"),
    )


def cluster_sample(spark, d):
    return sampling.cluster_sample(interactions(spark, d), EXAMPLE, seed=SEED, epoch=1)


QUERIES = {
    "interaction_keys": interaction_keys,
    "cluster_index": cluster_index,
    "cluster_normalise": cluster_normalise,
    "known_mask": known_mask,
    "dataset_summary": dataset_summary,
    "symmetric_union": symmetric_union,
    "ddi_union": ddi_union,
    "split_union": split_union,
    "random_negatives": random_negatives,
    "self_negatives": self_negatives,
    "hard_negatives": hard_negatives,
    "hard_negatives_whole": hard_negatives_whole,
    "all_negatives": all_negatives,
    "clip_contacts": clip_contacts,
    "labelled_cells": labelled_cells,
    "swap_augment": swap_augment,
    "training_records": training_records,
    "cluster_sample": cluster_sample,
}

_KNOWN = f"""{SQL_INTERACTIONS},
one AS (SELECT DISTINCT seq1_cluster AS a, seq2_cluster AS b FROM inter WHERE seq1_cluster IS NOT NULL),
known AS (SELECT a AS c1, b AS c2 FROM one UNION SELECT b, a FROM one)"""

_MEMBERS = f"""{SQL_INTERACTIONS},
members AS (SELECT seq1_cluster AS cluster, {', '.join(EXAMPLE)} FROM inter WHERE seq1_cluster IS NOT NULL
            UNION ALL
            SELECT seq2_cluster, {', '.join(EXAMPLE)} FROM inter
            WHERE seq1_cluster IS NOT NULL AND seq2_cluster <> seq1_cluster)"""


def _uniform(key):
    return f"('0x' || substr(md5({key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE"


_NEG = f"""{SQL_PAIRS},
sz AS (SELECT batch_id, count(*) AS b FROM pairs GROUP BY batch_id),
rnd AS (SELECT p.batch_id, p.idx AS idx1, (p.idx + s.s) % z.b AS idx2
        FROM pairs p JOIN sz z USING (batch_id)
        CROSS JOIN (SELECT unnest(range(1, 4)) AS s) s
        WHERE z.b > 1 AND s.s <= ceil(floor(z.b * {RATIOS['random']}::DOUBLE) / z.b)
          AND p.idx < floor(z.b * {RATIOS['random']}::DOUBLE) - (s.s - 1) * z.b),
random_neg AS (SELECT r.* FROM rnd r
               JOIN pairs x ON x.batch_id = r.batch_id AND x.idx = r.idx1
               JOIN pairs y ON y.batch_id = r.batch_id AND y.idx = r.idx2
               WHERE r.idx1 <> r.idx2 AND x.c1 <> y.c2),
self_neg AS (SELECT p.batch_id, p.idx AS idx1, p.idx AS idx2 FROM pairs p JOIN sz z USING (batch_id)
             WHERE p.idx < least(z.b, floor(z.b * {RATIOS['self']}::DOUBLE)) AND p.c1 <> p.c2),
hard_neg AS (SELECT x.batch_id, x.idx AS idx1, y.idx AS idx2 FROM pairs x JOIN pairs y USING (batch_id)
             WHERE x.idx <> y.idx AND x.c1 <> y.c2
             QUALIFY row_number() OVER (PARTITION BY x.batch_id, x.idx
                                        ORDER BY list_inner_product(x.q, y.k) DESC, y.idx)
                     <= {int(RATIOS['hard'])})"""

_LISTS = """
lists AS (SELECT l_orderkey, count(*)::INTEGER AS len1, floor(avg(l_quantity))::INTEGER AS len2
          FROM lineitem GROUP BY l_orderkey),
items AS (SELECT l_orderkey, l_linenumber AS i, l_quantity::INTEGER AS j FROM lineitem)"""

SQL = {
    "interaction_keys": f"""WITH {_KNOWN}
        SELECT c1, c2, c1 * {KEY_MULTIPLIER} + c2 AS key FROM known""",
    "cluster_index": f"""WITH {_MEMBERS}
        SELECT cluster, count(*) AS n_examples FROM members GROUP BY cluster""",
    "cluster_normalise": f"""WITH {SQL_INTERACTIONS}
        SELECT {', '.join(EXAMPLE)}, coalesce(seq1_cluster, -1) AS seq1_cluster,
               coalesce(seq2_cluster, -1) AS seq2_cluster FROM inter""",
    "known_mask": f"""WITH {_KNOWN}
        SELECT l.l_orderkey, l.l_linenumber, l.l_partkey AS c1, l.l_suppkey AS c2, k.c1 IS NOT NULL AS known
        FROM lineitem l LEFT JOIN known k ON k.c1 = l.l_partkey AND k.c2 = l.l_suppkey
        """,
    "dataset_summary": f"""WITH {_MEMBERS}
        SELECT (SELECT count(*) FROM inter) AS n_examples,
               (SELECT count(*) FROM inter WHERE seq1_cluster IS NULL) AS n_without_clusters,
               (SELECT count(DISTINCT cluster) FROM members) AS n_clusters""",
    "symmetric_union": f"""WITH {SQL_INTERACTIONS},
        n AS (SELECT l_orderkey, l_linenumber, coalesce(seq1_cluster, -1) AS a, coalesce(seq2_cluster, -1) AS b
              FROM inter)
        SELECT l_orderkey, l_linenumber, a AS seq1_cluster, b AS seq2_cluster, false AS swapped FROM n
        UNION ALL SELECT l_orderkey, l_linenumber, b, a, true FROM n""",
    "ddi_union": """
        SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_partkey ELSE -1 END AS seq1_cluster,
               CASE WHEN l_returnflag = 'A' THEN l_suppkey ELSE -1 END AS seq2_cluster FROM lineitem""",
    "split_union": "SELECT o_orderkey, o_orderstatus AS split FROM orders",
    "random_negatives": f"WITH {_NEG} SELECT batch_id, idx1, idx2 FROM random_neg",
    "self_negatives": f"WITH {_NEG} SELECT batch_id, idx1, idx2 FROM self_neg",
    "hard_negatives": f"WITH {_NEG} SELECT batch_id, idx1, idx2 FROM hard_neg",
    "hard_negatives_whole": f"WITH {_NEG.replace(SQL_PAIRS, SQL_WHOLE)} SELECT batch_id, idx1, idx2 FROM hard_neg",
    "all_negatives": f"""WITH {_NEG}
        SELECT batch_id, idx1, idx2, 'random' AS source FROM random_neg
        UNION ALL SELECT batch_id, idx1, idx2, 'self' FROM self_neg
        UNION ALL SELECT batch_id, idx1, idx2, 'hard' FROM hard_neg""",
    "clip_contacts": f"""WITH {_LISTS}
        SELECT l_orderkey, i, j FROM items JOIN lists USING (l_orderkey)
        WHERE i < least(len1, 32) AND j < least(len2, 32)""",
    "labelled_cells": f"""WITH {_LISTS},
        hits AS (SELECT DISTINCT l_orderkey, i, j FROM items JOIN lists USING (l_orderkey)
                 WHERE i < least(len1, 512) AND j < least(len2, 512)),
        maps AS (SELECT l_orderkey, least(len1, 512)::BIGINT * least(len2, 512) AS n_cells FROM lists
                 WHERE len1 > 0 AND len2 > 0)
        SELECT m.l_orderkey, n_cells, count(h.i) AS n_targets, coalesce(sum(h.i), 0)::BIGINT AS sum_i,
               coalesce(sum(h.j), 0)::BIGINT AS sum_j
        FROM maps m LEFT JOIN hits h ON h.l_orderkey = m.l_orderkey GROUP BY m.l_orderkey, n_cells
        UNION ALL SELECT -l_orderkey - 1, n_cells, 0, 0, 0 FROM maps""",
    "swap_augment": f"""WITH {_LISTS},
        s AS (SELECT *, {_uniform(f"'{SEED}:' || l_orderkey")} < 0.5::DOUBLE AS swapped FROM lists)
        SELECT l_orderkey, swapped, CASE WHEN swapped THEN len2 ELSE len1 END AS len1,
               CASE WHEN swapped THEN len1 ELSE len2 END AS len2,
               CASE WHEN swapped THEN j ELSE i END AS i, CASE WHEN swapped THEN i ELSE j END AS j
        FROM s JOIN items USING (l_orderkey)""",
    "training_records": f"""
        WITH r AS (SELECT a.doc_id, a.text AS t1, coalesce(b.text, '') AS t2, coalesce(l.quality, -1)::BIGINT AS c1,
                          coalesce(l.toxic, -1)::BIGINT AS c2,
                          {_uniform(f"'{SEED}:' || a.doc_id")} < 0.5::DOUBLE AS swapped
                   FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id - 1
                   LEFT JOIN labels l ON l.doc_id = a.doc_id),
        n AS (SELECT r.doc_id, count(*) AS n FROM r JOIN lineitem ON l_orderkey = r.doc_id
              WHERE l_linenumber < length(t1) AND l_quantity::INTEGER < length(t2)
              GROUP BY r.doc_id)
        SELECT doc_id, swapped,
               length(CASE WHEN swapped THEN t2 ELSE t1 END)::INTEGER AS len1,
               length(CASE WHEN swapped THEN t1 ELSE t2 END)::INTEGER AS len2,
               CASE WHEN swapped THEN c2 ELSE c1 END AS seq1_cluster,
               CASE WHEN swapped THEN c1 ELSE c2 END AS seq2_cluster,
               coalesce(n, 0)::INTEGER AS n_contacts,
               md5(CASE WHEN swapped THEN t2 ELSE t1 END) AS seq1_md5,
               md5(CASE WHEN swapped THEN t1 ELSE t2 END) AS seq2_md5
        FROM r LEFT JOIN n USING (doc_id)""",
    "cluster_sample": f"""WITH {_MEMBERS},
        loose AS (SELECT {', '.join(EXAMPLE)}, row_number() OVER (ORDER BY {', '.join(EXAMPLE)}) - 1 AS slot
                  FROM inter WHERE seq1_cluster IS NULL),
        slots AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {', '.join(EXAMPLE)}) - 1 AS slot
                  FROM members),
        clusters AS (SELECT cluster, n, row_number() OVER (ORDER BY cluster) - 1 AS cluster_idx
                     FROM (SELECT cluster, count(*) AS n FROM members GROUP BY cluster)),
        draws AS (SELECT draw, {_uniform(f"'{SEED + 1}:' || draw || ':side'")} AS u0,
                         {_uniform(f"'{SEED + 1}:' || draw || ':cluster'")} AS u1,
                         {_uniform(f"'{SEED + 1}:' || draw || ':slot'")} AS u2
                  FROM (SELECT unnest(range((SELECT count(*) FROM lineitem))) AS draw))
        SELECT draw, (-1)::BIGINT AS cluster, {', '.join('l.' + c for c in EXAMPLE)}
        FROM draws d JOIN loose l ON d.u0 < 0.5::DOUBLE
             AND l.slot = floor(d.u2 * (SELECT count(*) FROM loose))::BIGINT
        UNION ALL
        SELECT draw, s.cluster, {', '.join('s.' + c for c in EXAMPLE)}
        FROM draws d JOIN clusters c ON d.u0 >= 0.5::DOUBLE
             AND c.cluster_idx = floor(d.u1 * (SELECT count(*) FROM clusters))::BIGINT
        JOIN slots s ON s.cluster = c.cluster AND s.slot = floor(d.u2 * c.n)::BIGINT""",
}
