"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line.  Each query runs to completion into a sink that keeps
nothing, twice; the better time counts (the first one includes code generation
and the start of Python workers).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from pairscreen.operators import contacts
from pairscreen.queries import all_queries
from pairscreen.session import build_session

HEADLINE = (
    "topk_self topk_union dedupe_pairs best_host contact_scores contact_map all_vs_all cross_screen "
    "pair_inventory pending_pairs merge_first_wins interaction_keys cluster_index known_mask "
    "all_negatives labelled_cells training_records cluster_sample info_nce retrieval_metrics "
    "info_nce_whole contact_scores_batched "
    "contact_bce contact_focal residue_rows encode_documents stream_dedupe"
).split()


RUNS = 2


def run(query, spark, folder):
    times = []
    for _ in range(RUNS):
        start = time.time()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        times.append(time.time() - start)
    return min(times)


def scored_pairs(spark, folder, proteins=64, length=300):
    """Pairs of proteins of ``length`` residues scored in a second, by the default scorer
    and by one of padded batches.  Residues are vectors of the embeddings table."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    n = vectors.count()
    place = spark.range(proteins * length).select(
        (F.col("id") / length).cast("int").cast("long").alias("protein"),
        F.col("id").alias("at"),
        F.pmod(F.xxhash64("id"), F.lit(n)).alias("vec_id"),
    )
    rows = place.join(vectors, "vec_id").groupBy("protein")
    maps = rows.agg(F.sort_array(F.collect_list(F.struct("at", "embedding"))).alias("r"))
    maps = maps.select("protein", F.transform("r", lambda x: x["embedding"]).alias("residues")).cache()
    ids = maps.select(F.col("protein").alias("q_id"))
    pairs = ids.withColumn("c_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(proteins - 1).cast("long")))).cache()
    sides = (maps.withColumnRenamed("protein", "q_id"), maps.withColumnRenamed("protein", "c_id"))
    out, count = {}, pairs.count()
    for name, scorer in (("scored_pairs_per_sec", contacts.MultiHeadDot()), ("scored_pairs_per_sec_padded", contacts.PaddedDot())):
        seconds = run(lambda s, f, scorer=scorer: contacts.contact_scores(pairs, *sides, scorer=scorer), spark, folder)
        out[name] = round(count / seconds)
    return out


def rates(spark, folder, seconds):
    """Work per second, so that runs at other scales can be compared."""
    n = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    candidates = all_queries()["topk_union"](spark, folder).count()
    cells = all_queries()["contact_map"](spark, folder).count()
    plan = all_queries()["pair_inventory"](spark, folder).count()
    return {
        "retrieval_pairs_per_sec": round(n * n / seconds["topk_self"]),
        "resolved_candidates_per_sec": round(candidates / seconds["best_host"]),
        "map_cells_per_sec": round(cells / seconds["contact_map"]),
        "resolution_rows_per_sec": round(events / seconds["merge_first_wins"]),
        "sweep_plan_rows_per_sec": round(plan / seconds["pending_pairs"]),
        **scored_pairs(spark, folder),
    }


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        app="bench",
        master=f"local[{cpus}]",
        shuffle_partitions=cpus,
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = all_queries()
    seconds = {name: round(run(queries[name], spark, folder), 3) for name in HEADLINE}
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "best_of": RUNS,
        "rates": rates(spark, folder, seconds),
        "sf": os.path.basename(folder.rstrip("/")),
    }
    spark.stop()
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
