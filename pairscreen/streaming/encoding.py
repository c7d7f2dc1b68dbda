"""Encode proteomes as they arrive."""

from pairscreen.sources.fasta import stream_fasta
from pairscreen.sources.store import of_proteomes
from pairscreen.streaming.results import INTERVAL


def stream_encode_rows(stream, store, checkpoint, interval=INTERVAL, once=False):
    """Bring ``store`` up to date with proteins that arrive as rows.  Arriving rows
    are kept beside the store, by batch, so that a proteome may come in parts: it is
    encoded from all of its rows so far.  A replayed batch replaces its own rows,
    and the store skips what it has."""
    arrived = f"{store.path}-arrived"

    def arrive(batch, number):
        rows = batch.select("proteome_id", "seq_idx", "protein_id", "sequence")
        rows.write.mode("overwrite").parquet(f"{arrived}/batch={number}")
        kept = store.spark.read.schema(rows.schema).parquet(arrived).select(*rows.columns)
        touched = store.spark.read.parquet(f"{arrived}/batch={number}").select("proteome_id").distinct()
        whole = of_proteomes(kept, touched).distinct()
        store.write(store.encode(store.missing(whole)))

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(arrive)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def stream_encode(spark, folder, store, checkpoint, interval=INTERVAL, once=False, suffix=".faa"):
    """The same for a folder of FASTA files: only new files are read."""
    return stream_encode_rows(stream_fasta(spark, folder, suffix), store, checkpoint, interval, once)
