"""Losses and retrieval metrics."""

from pyspark.sql import functions as F

from pairscreen.operators import cell_losses, in_batch, metrics
from pairscreen.queries.views import SQL_PAIRS, SQL_WHOLE, batched_pairs, same_label, whole_batch
from pairscreen.session import materialise
from pairscreen.sources.tables import load

SCALE = 1 / 0.07


def in_batch_topk(spark, d):
    top = in_batch.in_batch_topk(batched_pairs(spark, d), 3)
    return top.withColumn("sim", F.round("sim", 6))


def _losses(spark, d):
    return in_batch.in_batch_losses(batched_pairs(spark, d), SCALE, same_label(spark, d))


def top1_accuracy(spark, d):
    return in_batch.top1_accuracy(_losses(spark, d)).withColumn("top1_acc", F.round("top1_acc", 6))


def info_nce(spark, d):
    return in_batch.info_nce(_losses(spark, d)).withColumn("loss", F.round("loss", 6))


def mean_batch_loss(spark, d):
    mean = in_batch.mean_batch_loss(in_batch.info_nce(_losses(spark, d)))
    return mean.withColumn("loss", F.round("loss", 6))


#: Tiles of the whole table as one batch: several at every scale of the given tables.
WHOLE_TILE = 64


def in_batch_topk_whole(spark, d):
    top = in_batch.in_batch_topk(whole_batch(spark, d), 3, tile=WHOLE_TILE)
    return top.withColumn("sim", F.round("sim", 6))


def _whole_losses(spark, d):
    return in_batch.in_batch_losses(whole_batch(spark, d), SCALE, same_label(spark, d), tile=WHOLE_TILE)


def info_nce_whole(spark, d):
    return in_batch.info_nce(_whole_losses(spark, d)).withColumn("loss", F.round("loss", 6))


def top1_accuracy_whole(spark, d):
    return in_batch.top1_accuracy(_whole_losses(spark, d)).withColumn("top1_acc", F.round("top1_acc", 6))


def _table_pairs(spark, d):
    return batched_pairs(spark, d).select(F.col("pair").alias("idx"), "q", "k", "c1", "c2")


def first_valid_rank(spark, d):
    p = _table_pairs(spark, d)
    queries = p.select(F.col("idx").alias("q_id"), F.col("q").alias("vec"), F.col("c1").alias("cluster"))
    keys = p.select(F.col("idx").alias("c_id"), F.col("k").alias("vec"), F.col("c2").alias("cluster"))
    return metrics.first_valid_rank(queries, keys, same_label(spark, d))


def retrieval_metrics(spark, d):
    found = metrics.retrieval_metrics(_table_pairs(spark, d), same_label(spark, d))
    return found.withColumn("value", F.round("value", 6))


def _line_cells(spark, d):
    """Line items as cells: a logit from discount and tax, returned or not."""
    logit = (F.col("l_discount") - F.col("l_tax")) * F.lit(40.0)
    return load(spark, d, "lineitem").select(
        "l_linestatus",
        logit.alias("logit"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("target"),
    )


def contact_bce(spark, d):
    return cell_losses.contact_bce(_line_cells(spark, d), ["l_linestatus"]).withColumn(
        "bce", F.round("bce", 6)
    )


def contact_focal(spark, d):
    return cell_losses.contact_focal(_line_cells(spark, d), ["l_linestatus"]).withColumn(
        "focal", F.round("focal", 6)
    )


def metrics_long(spark, d):
    """What an evaluation step logs: own-partner retrieval and the losses."""
    pairs = materialise(_table_pairs(spark, d), "pairs")
    ranks = metrics.retrieval_metrics(pairs)
    clip = in_batch.mean_batch_loss(in_batch.info_nce(_losses(spark, d)))
    contact = cell_losses.contact_bce(_line_cells(spark, d))
    one = F.lit(1).alias("one")
    both = clip.select(F.col("loss").alias("clip"), one).join(
        contact.select(F.col("bce").alias("contact"), one), "one"
    )
    weighted, total = cell_losses.total_loss("clip", "contact", 1.0, 0.5)
    losses = both.select("clip", "contact", weighted, total)
    names = {"loss_clip": "clip", "loss_contact": "contact", "loss_total": "loss_total", "loss_weighted": "loss_weighted"}
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in names.items()])
    every = ranks.unionByName(losses.select(F.inline(cells)))
    return metrics.metrics_long(every, 1000).withColumn("value", F.round("value", 6))


QUERIES = {
    "in_batch_topk": in_batch_topk,
    "in_batch_topk_whole": in_batch_topk_whole,
    "info_nce_whole": info_nce_whole,
    "top1_accuracy_whole": top1_accuracy_whole,
    "top1_accuracy": top1_accuracy,
    "info_nce": info_nce,
    "mean_batch_loss": mean_batch_loss,
    "first_valid_rank": first_valid_rank,
    "retrieval_metrics": retrieval_metrics,
    "contact_bce": contact_bce,
    "contact_focal": contact_focal,
    "metrics_long": metrics_long,
}

_SCALED = f"""{SQL_PAIRS},
m AS (SELECT x.batch_id, x.idx AS i, y.idx AS j,
             CASE WHEN x.idx <> y.idx AND x.c1 = y.c2 THEN -10000.0::DOUBLE
                  ELSE (1.0::DOUBLE / 0.07::DOUBLE) * list_inner_product(x.q, y.k) END AS x
      FROM pairs x JOIN pairs y USING (batch_id)),
rt AS (SELECT batch_id, i, max(x) AS top FROM m GROUP BY batch_id, i),
ct AS (SELECT batch_id, j, max(x) AS top FROM m GROUP BY batch_id, j),
rl AS (SELECT batch_id, m.i, any_value(top) + ln(sum(exp(x - top))) - max(CASE WHEN m.i = j THEN x END) AS ce
       FROM m JOIN rt USING (batch_id, i) GROUP BY batch_id, m.i),
cl AS (SELECT batch_id, m.j, any_value(top) + ln(sum(exp(x - top))) - max(CASE WHEN i = m.j THEN x END) AS ce
       FROM m JOIN ct USING (batch_id, j) GROUP BY batch_id, m.j),
per AS (SELECT r.batch_id, (r.ce + c.ce) / 2 AS loss, r.n AS n_rows
        FROM (SELECT batch_id, avg(ce) AS ce, count(*) AS n FROM rl GROUP BY batch_id) r
        JOIN (SELECT batch_id, avg(ce) AS ce FROM cl GROUP BY batch_id) c USING (batch_id))"""


def _ranks(valid):
    return f"""
sim AS (SELECT x.pair AS i, y.pair AS j, list_inner_product(x.q, y.k) AS s, ({valid}) AS ok
        FROM pairs x CROSS JOIN pairs y),
fr AS (SELECT i, j, ok, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM sim),
br AS (SELECT i, j, ok, row_number() OVER (PARTITION BY j ORDER BY s DESC, i) AS r FROM sim),
f AS (SELECT i AS q_id, min(r) AS rank FROM fr WHERE ok GROUP BY i),
b AS (SELECT j AS q_id, min(r) AS rank FROM br WHERE ok GROUP BY j)"""


def _metric_rows():
    rows = []
    for name, table in (("seq1_to_seq2", "f"), ("seq2_to_seq1", "b")):
        rows.append(f"SELECT '{name}_mean_rank' AS metric, avg(rank) AS value FROM {table}")
        rows.append(f"SELECT '{name}_median_rank', floor(median(rank)) FROM {table}")
        rows += [
            f"SELECT '{name}_R@{k}', avg((rank <= {k})::INTEGER) FROM {table}" for k in metrics.KS
        ]
    return " UNION ALL ".join(rows)


_CELLS = """
c AS (SELECT l_linestatus, (l_discount - l_tax) * 40.0::DOUBLE AS x, (l_returnflag = 'R')::INTEGER AS y
      FROM lineitem),
l AS (SELECT l_linestatus, x, y, greatest(x, 0.0::DOUBLE) - x * y + ln(1.0::DOUBLE + exp(-abs(x))) AS bce FROM c)"""

SQL = {
    "in_batch_topk": f"""WITH {SQL_PAIRS},
        r AS (SELECT x.batch_id, x.idx, y.idx AS match, list_inner_product(x.q, y.k) AS s,
                     row_number() OVER (PARTITION BY x.batch_id, x.idx
                                        ORDER BY list_inner_product(x.q, y.k) DESC, y.idx) AS rank
              FROM pairs x JOIN pairs y USING (batch_id))
        SELECT batch_id, idx, match, round(s, 6) AS sim, rank FROM r WHERE rank <= 3""",
    "top1_accuracy": f"""WITH {_SCALED},
        t AS (SELECT batch_id, i, j FROM m
              QUALIFY row_number() OVER (PARTITION BY batch_id, i ORDER BY x DESC, j) = 1)
        SELECT batch_id, round(avg((i = j)::INTEGER), 6) AS top1_acc FROM t GROUP BY batch_id""",
    "info_nce": f"WITH {_SCALED} SELECT batch_id, round(loss, 6) AS loss, n_rows FROM per",
    "mean_batch_loss": f"WITH {_SCALED} SELECT round(avg(loss), 6) AS loss, count(*) AS n_batches FROM per",
    "first_valid_rank": f"WITH {SQL_PAIRS}, {_ranks('x.pair = y.pair OR x.c1 = y.c2')} SELECT q_id, rank FROM f",
    "retrieval_metrics": f"""WITH {SQL_PAIRS}, {_ranks('x.pair = y.pair OR x.c1 = y.c2')},
        a AS ({_metric_rows()}) SELECT metric, round(value, 6) AS value FROM a""",
    "contact_bce": f"WITH {_CELLS} SELECT l_linestatus, round(avg(bce), 6) AS bce FROM l GROUP BY l_linestatus",
    "contact_focal": f"""WITH {_CELLS}
        SELECT l_linestatus, round(sum((CASE WHEN y > 0 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END)
                       * pow(1.0::DOUBLE - exp(-bce), 2.0::DOUBLE) * bce)
                   / greatest(sum(y), 1)::DOUBLE, 6) AS focal
        FROM l GROUP BY l_linestatus""",
    "metrics_long": f"""WITH {_SCALED}, {_ranks('x.pair = y.pair')}, {_CELLS},
        lc AS (SELECT avg(loss) AS v FROM per), lb AS (SELECT avg(bce) AS v FROM l),
        a AS ({_metric_rows()}
              UNION ALL SELECT 'loss_clip', v FROM lc UNION ALL SELECT 'loss_contact', v FROM lb
              UNION ALL SELECT 'loss_total', lc.v + lb.v FROM lc CROSS JOIN lb
              UNION ALL SELECT 'loss_weighted', lc.v + 0.5::DOUBLE * lb.v FROM lc CROSS JOIN lb)
        SELECT 1000::BIGINT AS step, 'eval/' || metric AS metric, round(value, 6) AS value FROM a""",
}

for _name in ("in_batch_topk", "info_nce", "top1_accuracy"):
    SQL[f"{_name}_whole"] = SQL[_name].replace(SQL_PAIRS, SQL_WHOLE)
