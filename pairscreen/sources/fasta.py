"""FASTA files as tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairscreen.functions import basename
from pairscreen.sources.listing import list_files

_HEADER = r"^>?(\S*)"


def read_fasta(spark, path, glob=None):
    """``(proteome_id, seq_idx, protein_id, sequence, length)`` of every record,
    in file order.  Files are split between records, so a file of any size is
    read in parallel; ``seq_idx`` is the number of records in the file's earlier
    blocks plus the place in its own, and only the counts per block are
    shuffled.  Text before the first ">" of a file is no record."""
    reader = spark.read.option("lineSep", "\n>")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # Ids grow by one within a partition and a block is never shared by two, so
    # an id less the smallest of its block is the place in the block.
    rows = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    blocks = rows.groupBy("file", "block").agg(
        F.min("id").alias("first_id"),
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.startswith("value", F.lit(">")).cast("int"), "id").alias("first_is_record"),
    )
    # The separator eats the ">" of every record but a file's first.
    blocks = blocks.withColumn("preamble", F.when(F.col("block") == 0, 1 - F.col("first_is_record")).otherwise(0))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.col("n") - F.col("preamble")).over(before), F.lit(0)) - F.col("preamble")
    placed = rows.join(
        blocks.select("file", "block", "first_id", "preamble", shift.alias("shift")), ["file", "block"]
    ).withColumn("place", F.col("id") - F.col("first_id"))
    opens = (F.col("block") == 0) & (F.col("place") == 0)
    records = placed.where((F.col("preamble") == 0) | (F.col("place") > 0)).select(
        basename(F.element_at(F.split(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "/"), -1)).alias("proteome_id"),
        (F.col("shift") + F.col("place")).alias("seq_idx"),
        F.when(opens, F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("record"),
    )
    return _parsed(records)


def stream_fasta(spark, folder, suffix=".faa", max_files=None):
    """The records of files as they arrive, each file as one value."""
    reader = spark.readStream.option("pathGlobFilter", f"*{suffix}")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_files(reader.text(folder, wholetext=True))


def parse_files(files):
    """Whole files in ``value`` to records."""
    named = files.select(basename(F.col("_metadata.file_name")).alias("proteome_id"), "value")
    # A record starts with ">" at the start of a line; what comes before the
    # first one is no record.
    parts = F.split("value", r"(?m)^>")
    rows = named.select(
        "proteome_id",
        F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias(
            "seq_idx", "record"
        ),
    )
    return _parsed(rows)


def _parsed(rows):
    first_line = F.regexp_extract("record", r"^[^\r\n]*", 0)
    sequence = F.regexp_replace(F.expr("substring(record, length(first_line) + 1)"), r"\s+", "")
    return (
        rows.withColumn("first_line", first_line)
        .select(
            "proteome_id",
            F.col("seq_idx").cast("int").alias("seq_idx"),
            F.regexp_extract("first_line", _HEADER, 1).alias("protein_id"),
            sequence.alias("sequence"),
        )
        .withColumn("length", F.length("sequence"))
    )


def scan_proteomes(spark, folder, suffix=".faa"):
    """The sorted inventory of proteome files: ``(proteome_id, path, size)``.
    Contents are not read; an empty file is a proteome without proteins."""
    files = list_files(spark, folder, f"*{suffix}")
    return files.select(basename("path").alias("proteome_id"), "path", "size").orderBy("proteome_id")
