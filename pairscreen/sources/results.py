"""Result tables: predictions, per-pair results with their status, metrics."""

import uuid

from pyspark.sql import functions as F

from pairscreen.functions import basename
from pairscreen.schemas import CROSS_RESULTS, METRICS, PAIR_STATUS
from pairscreen.sources.listing import list_files

PAIR = ["host_proteome", "viral_proteome"]


def write_predictions(df, path, fmt="csv", score="contact_score", mode="overwrite"):
    """Best first.  The sort is by range, so the files are in order and none of
    them holds everything.  An empty result leaves an empty, readable table."""
    writer = df.orderBy(F.desc(score), *[c for c in df.columns if c != score]).write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_pair_results(results, pairs, path, candidates=None, fmt="csv"):
    """Results of one run below ``path/results``, one folder per run and pair,
    then one status row per pair below ``path/status`` that names the run.
    ``pairs`` are the pairs that were worked on; one without results has no
    folder but is done all the same.  Readers go by a pair's newest status row,
    so rows of an interrupted or replaced run never show."""
    run = uuid.uuid4().hex
    (
        results.withColumn("run_id", F.lit(run))
        .orderBy(*PAIR, F.desc("contact_score"), "viral_id")
        .write.mode("append")
        .option("header", True)
        .partitionBy("run_id", *PAIR)
        .format(fmt)
        .save(f"{path}/results")
    )
    counts = results.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_results"))
    status = pairs.select(*PAIR).distinct().join(counts, PAIR, "left")
    if candidates is not None:
        status = status.join(candidates.select(*PAIR, "n_candidates"), PAIR, "left")
    else:
        status = status.withColumn("n_candidates", F.lit(None).cast("bigint"))
    status.select(
        *PAIR,
        F.coalesce("n_candidates", F.lit(0)).cast("bigint").alias("n_candidates"),
        F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        F.current_timestamp().alias("finished_at"),
        F.lit(run).alias("run_id"),
    ).write.mode("append").parquet(f"{path}/status")


def read_pair_status(spark, path):
    """The newest status row of each pair."""
    rest = ["finished_at", "run_id", "n_candidates", "n_results"]
    rows = spark.read.schema(PAIR_STATUS).parquet(f"{path}/status")
    newest = rows.groupBy(*PAIR).agg(F.max(F.struct(*rest)).alias("newest"))
    return newest.select(*PAIR, *[F.col(f"newest.{c}").alias(c) for c in rest]).select(*PAIR_STATUS.fieldNames())


def read_partitioned_results(spark, path, fmt="csv"):
    """Results of every finished pair, of the run that its status names."""
    schema = (
        "viral_id string, host_id string, contact_score double, host_is_best_contact boolean, "
        "run_id string, host_proteome string, viral_proteome string"
    )
    rows = spark.read.schema(schema).option("header", True).format(fmt).load(f"{path}/results")
    finished = read_pair_status(spark, path).select("run_id", *PAIR)
    return rows.join(finished, ["run_id", *PAIR], "left_semi").drop("run_id")


def from_file_name(df, path_col="_metadata.file_name"):
    """Add the pair that a ``<host>__<viral>.csv`` file name spells."""
    parts = F.split(basename(F.col(path_col)), "__", 2)
    return df.select(
        F.element_at(parts, 1).alias("host_proteome"),
        F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("viral_proteome"),
        *[f.name for f in CROSS_RESULTS],
    )


def read_pair_results(spark, folder):
    """Every finished ``<host>__<viral>.csv``; logs and other files are left
    alone.  A file with a header only has no rows: see ``finished_pairs``."""
    rows = (
        spark.read.schema(CROSS_RESULTS)
        .option("header", True)
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )
    return from_file_name(rows)


def finished_pairs(spark, folder):
    """Pairs that have a file, empty or not, by name only."""
    parts = F.split("name", "__", 2)
    return list_files(spark, folder, "*.csv").select(basename("path").alias("name")).select(
        F.element_at(parts, 1).alias("host_proteome"), F.element_at(parts, -1).alias("viral_proteome")
    ).distinct()


def write_metrics(df, path):
    df.select(*METRICS.fieldNames()).write.mode("append").parquet(path)


def read_metrics(spark, path):
    return spark.read.schema(METRICS).parquet(path)
