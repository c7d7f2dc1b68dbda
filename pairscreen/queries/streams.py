"""Streams over ``events`` and ``documents``, each run to the end of its input
into a table, so that the batch SQL applies to them."""

from pyspark.sql import functions as F

from pairscreen.queries.texts import SMALL, proteins
from pairscreen.session import scratch
from pairscreen.sources.store import EncodedStore
from pairscreen.sources.tables import load
from pairscreen.streaming.encoding import stream_encode_rows
from pairscreen.streaming.results import (
    keep_latest,
    keep_running,
    read_latest,
    start,
    stream_table,
)
from pairscreen.streaming.results import stream_dedupe as first_arrivals
from pairscreen.streaming.results import stream_progress as running_progress


def _results(spark, d):
    """Events as finished pairs, arriving as a stream."""
    schema = load(spark, d, "events").schema
    return stream_table(spark, d, "events.parquet", schema).select(
        "event_id",
        "ts",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host_proteome"),
        F.col("event_type").alias("viral_proteome"),
        "value",
    )


def _to_table(spark, stream):
    path = scratch(spark, "stream")
    run = start(stream, path, scratch(spark, "progress"), once=True)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_ingest(spark, d):
    stored = _to_table(spark, _results(spark, d))
    return stored.select("event_id", "host_proteome", "viral_proteome", "value")


CSV_ROWS = "event_id bigint, host_proteome string, value double"


def stream_ingest_csv(spark, d):
    """The same from CSV files in a folder for each viral proteome, by the loop that
    outlives failed passes; the second pass finds nothing new."""
    src, path, progress = (scratch(spark, n) for n in ("csv", "stream", "progress"))
    rows = _rows_of_files(load(spark, d, "events"))
    rows.write.option("header", True).partitionBy("viral_proteome").csv(src)
    schema = f"{CSV_ROWS}, viral_proteome string"
    arriving = spark.readStream.schema(schema).option("header", True).csv(src)
    keep_running(lambda: start(arriving, path, progress, once=True), interval=0, passes=2)
    return spark.read.schema(schema).parquet(path)


def _rows_of_files(events):
    host = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host_proteome")
    return events.select("event_id", host, "value", F.col("event_type").alias("viral_proteome"))


def stream_dedupe(spark, d):
    keys = ["host_proteome", "viral_proteome"]
    return _to_table(spark, first_arrivals(_results(spark, d), keys)).select(*keys)


def stream_progress(spark, d):
    path = scratch(spark, "progress-rows")
    counts = running_progress(_results(spark, d), ["viral_proteome"])
    run = (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", scratch(spark, "progress"))
        .foreachBatch(keep_latest(path, ["viral_proteome"]))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return read_latest(spark, path, ["viral_proteome"])


def stream_encode(spark, d):
    store = EncodedStore(spark, scratch(spark, "store"), SMALL, max_len=None)
    rows = proteins(spark, d)
    docs = stream_table(spark, d, "documents.parquet", load(spark, d, "documents").schema)
    arriving = docs.select(
        F.col("lang").alias("proteome_id"),
        F.col("doc_id").cast("int").alias("seq_idx"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("protein_id"),
        F.col("text").alias("sequence"),
    )
    stream_encode_rows(arriving, store, scratch(spark, "progress"), once=True).awaitTermination()
    left = store.missing(rows).select("protein_id", F.lit(1).alias("left"))
    return (
        store.read()
        .join(left, "protein_id", "left")
        .where(F.col("left").isNull())
        .select("proteome_id", "protein_id", "length")
    )


QUERIES = {
    "stream_ingest": stream_ingest,
    "stream_ingest_csv": stream_ingest_csv,
    "stream_dedupe": stream_dedupe,
    "stream_progress": stream_progress,
    "stream_encode": stream_encode,
}

_EV = """
ev AS (SELECT event_id, ts, 'u' || user_id AS host_proteome, event_type AS viral_proteome, value FROM events)"""

SQL = {
    "stream_ingest": f"WITH {_EV} SELECT event_id, host_proteome, viral_proteome, value FROM ev",
    "stream_ingest_csv": f"WITH {_EV} SELECT event_id, host_proteome, viral_proteome, value FROM ev",
    "stream_dedupe": f"WITH {_EV} SELECT DISTINCT host_proteome, viral_proteome FROM ev",
    "stream_progress": f"""WITH {_EV}
        SELECT viral_proteome, count(DISTINCT host_proteome) AS n_done FROM ev GROUP BY viral_proteome""",
    "stream_encode": """
        SELECT lang AS proteome_id, 'd' || doc_id AS protein_id, length(text)::INTEGER AS length FROM documents""",
}
