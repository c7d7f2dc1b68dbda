"""The store of encoded proteomes: encode once, read many times.

A proteome is current if its content, the encoder version and the length limit
all match; anything else is encoded again and replaces the old partition.
"""

from pyspark.sql import functions as F

from pairscreen.operators.encode import HashedKmerEncoder, default_heads, encode
from pairscreen.schemas import ENCODED
from pairscreen.session import parallelism
from pairscreen.sources.fingerprint import content_hash

_KEY = ["proteome_id", "content_hash", "encoder_version", "max_len"]
MAX_ROWS_PER_FILE = 100_000
CHUNK = 2_000  # proteins of one proteome that one task encodes in a row
PARTS = 1_024  # a proteome's proteins are joined in so many parts at most


def of_proteomes(rows, found):
    """``rows`` of the proteomes in ``found``, which has one row for each, with its
    columns.  Proteins are dealt by their ids, and only the numbers of the parts that
    occur are brought together by proteome: the sequences of a large one never meet in
    one task, and nothing is sent to all."""
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64("seq_idx", "protein_id"), F.lit(PARTS)))
    parts = dealt.select("proteome_id", "__part").distinct().join(found, "proteome_id")
    return dealt.join(parts, ["proteome_id", "__part"]).drop("__part")


class EncodedStore:
    def __init__(self, spark, path, encoder=None, heads=None, max_len=None):
        self.spark, self.path = spark, path
        self.encoder = encoder or HashedKmerEncoder()
        self.heads = heads or default_heads(self.encoder)
        self.max_len = max_len

    def _exists(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, ids=None):
        """Everything, or the given proteomes only (a list, or a frame with
        ``proteome_id``); other partitions are not read."""
        if not self._exists():
            return self.spark.createDataFrame([], ENCODED)
        df = self.spark.read.schema(ENCODED).parquet(self.path)
        if ids is None:
            return df
        if isinstance(ids, (list, tuple, set)):
            return df.where(F.col("proteome_id").isin(*ids))
        return of_proteomes(df, ids.select("proteome_id").distinct()).select(df.columns)

    def write(self, encoded):
        """Replace the partitions of the proteomes in ``encoded``, and only those."""
        (
            encoded.select(*ENCODED.fieldNames())
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
            .partitionBy("proteome_id")
            .parquet(self.path)
        )

    def missing(self, proteins):
        """Proteins of every proteome the store has no current encoding of."""
        key = content_hash(proteins, "proteome_id", ["seq_idx", "protein_id", "sequence"])
        wanted = key.withColumns(
            {
                "encoder_version": F.lit(self.encoder.version),
                "max_len": F.lit(-1 if self.max_len is None else self.max_len),
            }
        )
        have = self.read().select(*_KEY).distinct()
        return of_proteomes(proteins, wanted.join(have, _KEY, "left_anti"))

    def encode(self, proteins):
        """Proteins of a proteome are brought together, a few thousand to a
        task, while they are still short strings: few files per proteome, and a
        proteome of any size is shared out."""
        chunk = F.floor(F.col("seq_idx") / CHUNK)
        dealt = proteins.repartition(parallelism(self.spark), "proteome_id", chunk)
        return encode(
            dealt,
            ["proteome_id", "content_hash", "encoder_version", "max_len", "seq_idx", "protein_id"],
            "sequence",
            self.encoder,
            self.heads,
            self.max_len,
            deal=False,
        )

    def ensure(self, proteins):
        """Encode what is missing, then read it all."""
        self.write(self.encode(self.missing(proteins)))
        return self.read(proteins)
