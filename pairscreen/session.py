"""Session defaults and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app="pairscreen", master=None, shuffle_partitions=None, **conf):
    """A session with the settings the operators are written for; keyword
    ``conf`` wins.  On a cluster leave ``master`` unset."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        b = b.config(key, str(value))
    return b.getOrCreate()


def is_local(spark):
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark):
    """The folder every executor can reach, as the cluster names it.  Only a
    local session may fall back to a temporary folder of its own."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if path:
        return path.rstrip("/")
    if not is_local(spark):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="pairscreen-")
    spark.conf.set(CHECKPOINT_CONF, path)
    return path


def scratch(spark, label):
    """A new path below the shared folder; never reused."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df, label):
    """Write once, read many: cuts the lineage with a table in the shared
    folder, which survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark):
    """Task slots to aim for: the cores of a local session, and on a cluster
    the configured shuffle width, if that is more than the cores known so far."""
    cores = spark.sparkContext.defaultParallelism
    if is_local(spark):
        return max(1, cores)
    return max(1, cores, int(spark.conf.get("spark.sql.shuffle.partitions")))


# What one task of a scan reads by default.
SCAN_TASK_BYTES = 128 << 20


def spread(df):
    """Deal a small input out over all task slots before work that is heavy per
    row: it may sit in a single file.  The size is the optimiser's estimate; an
    input that fills the slots by itself is left alone, so no large table is
    ever shuffled for this."""
    slots = parallelism(df.sparkSession)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(slots) if size < slots * SCAN_TASK_BYTES else df
