"""Ranking, naming and splitting of results over the given tables."""

from pyspark.sql import functions as F

from pairscreen.functions import cross_entropy, temperature
from pairscreen.operators import knowns, resolve, sweep
from pairscreen.operators.indexing import cyclic_partner
from pairscreen.operators.retrieval import topk_rank
from pairscreen.queries.views import SQL_INTERACTIONS, interactions, vectors
from pairscreen.sources.tables import load

BEST = 3
SHIFTS = (1, 5, 17)
REPORT = 100
#: The logarithm that the temperature is learned as; about ln(1 / 0.07).
LOG_SCALE = 2.65926
LARGE_ORDER = 200_000.0


def named_orders(spark, d):
    """Customer numbers of orders swapped for their names."""
    customers = load(spark, d, "customer").select("c_custkey", "c_name")
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    named = resolve.with_ids(orders, customers, "o_custkey", "customer", id_col="c_name", name_key="c_custkey")
    return named.select("o_orderkey", "o_custkey", "customer")


def best_events(spark, d):
    """The events of highest value of each user, with their place."""
    events = load(spark, d, "events").select("event_id", "user_id", "value")
    return topk_rank(events, "user_id", "value", "event_id", BEST)


def first_best_event(spark, d):
    """The first event of the highest value of each type."""
    events = load(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    return resolve.argmax_first(events, "event_type", "value", "event_id")


def top_orders(spark, d):
    """A report of the largest orders."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return resolve.order_results(orders, "o_totalprice", ["o_orderkey"]).limit(REPORT)


def cyclic_neighbours(spark, d):
    """Each vector with those a fixed number of places on, round the end."""
    v = vectors(spark, d).select(F.col("vec_id").alias("pos"))
    return cyclic_partner(v, SHIFTS, v.count())


def restricted_inventory(spark, d):
    """Customers as an inventory, only those that a work list of large orders names."""
    inventory = load(spark, d, "customer").select(F.col("c_custkey").alias("host_proteome"), "c_name")
    large = load(spark, d, "orders").where(F.col("o_totalprice") > LARGE_ORDER)
    return sweep.restrict(inventory, large.select(F.col("o_custkey").alias("host_proteome")))


def largest_cluster(spark, d):
    """The largest cluster id, which the key multiplier must exceed."""
    top = knowns.check_multiplier(interactions(spark, d), multiplier=None)
    return spark.createDataFrame([(top,)], "largest bigint")


def split_keys(spark, d):
    """Known cluster pairs of a training and a validation part together."""
    rows = interactions(spark, d)
    heavy = F.col("l_quantity") > 25
    return knowns.interaction_keys(rows.where(~heavy), rows.where(heavy | heavy.isNull()))


def order_cross_entropy(spark, d):
    """Each item against the items of its order: minus the log of its softmax share."""
    items = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (temperature(F.lit(LOG_SCALE)) * F.col("l_discount")).alias("x")
    )
    peaks = items.groupBy("l_orderkey").agg(F.max("x").alias("row_max"))
    shifted = items.join(peaks, "l_orderkey")
    sums = shifted.groupBy("l_orderkey").agg(F.sum(F.exp(F.col("x") - F.col("row_max"))).alias("sum_exp"))
    loss = cross_entropy("x", "row_max", "sum_exp")
    return shifted.join(sums, "l_orderkey").select("l_orderkey", "l_linenumber", F.round(loss, 6).alias("loss"))


QUERIES = {
    "named_orders": named_orders,
    "best_events": best_events,
    "first_best_event": first_best_event,
    "top_orders": top_orders,
    "cyclic_neighbours": cyclic_neighbours,
    "restricted_inventory": restricted_inventory,
    "largest_cluster": largest_cluster,
    "split_keys": split_keys,
    "order_cross_entropy": order_cross_entropy,
}

SQL = {
    "named_orders": """
        SELECT o_orderkey, o_custkey, c_name AS customer FROM orders JOIN customer ON c_custkey = o_custkey""",
    "best_events": f"""
        SELECT event_id, user_id, value, (row_number() OVER w)::INTEGER AS rank FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id)
        QUALIFY row_number() OVER w <= {BEST}""",
    "first_best_event": """
        SELECT event_id, event_type, user_id, value FROM events
        QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) = 1""",
    "top_orders": f"""
        SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT {REPORT}""",
    "cyclic_neighbours": f"""
        SELECT vec_id AS pos, s.shift::INTEGER AS shift,
               (vec_id + s.shift) % (SELECT count(*) FROM embeddings) AS partner
        FROM embeddings CROSS JOIN (SELECT unnest([{', '.join(map(str, SHIFTS))}]) AS shift) s""",
    "restricted_inventory": f"""
        SELECT c_custkey AS host_proteome, c_name FROM customer
        WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > {LARGE_ORDER}::DOUBLE)""",
    "largest_cluster": f"""WITH {SQL_INTERACTIONS}
        SELECT max(greatest(seq1_cluster, seq2_cluster))::BIGINT AS largest FROM inter
        WHERE seq1_cluster IS NOT NULL AND seq2_cluster IS NOT NULL""",
    "split_keys": f"""WITH {SQL_INTERACTIONS},
        one AS (SELECT seq1_cluster AS a, seq2_cluster AS b FROM inter
                WHERE seq1_cluster IS NOT NULL AND seq2_cluster IS NOT NULL)
        SELECT a AS c1, b AS c2 FROM one UNION SELECT b, a FROM one""",
    "order_cross_entropy": f"""
        WITH i AS (SELECT l_orderkey, l_linenumber, exp({LOG_SCALE}::DOUBLE) * l_discount AS x FROM lineitem),
             p AS (SELECT l_orderkey, max(x) AS top FROM i GROUP BY l_orderkey),
             s AS (SELECT l_orderkey, sum(exp(x - top)) AS total FROM i JOIN p USING (l_orderkey) GROUP BY l_orderkey)
        SELECT l_orderkey, l_linenumber, round(top + ln(total) - x, 6) AS loss
        FROM i JOIN p USING (l_orderkey) JOIN s USING (l_orderkey)""",
}
