"""What is left of a grid of pairs, without building the grid.

Both sides are numbered.  The finished numbers of a host leave gaps, and the gaps are
the pending pairs: ranges of numbers, as many as there are finished pairs at most (and
one for each untouched stretch).  A range becomes pairs only when they are worked on.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairscreen.functions import percent_done
from pairscreen.operators.indexing import with_offsets, with_position

#: Numbers of a host that one window group covers at most.
STRETCH = 65_536


class PairGrid:
    """Every host with every viral proteome, by number, in the order of the names.
    Nulls are no names; repeated names count once."""

    def __init__(self, hosts, virals, host="host_proteome", viral="viral_proteome", stretch=STRETCH):
        self.host, self.viral, self.stretch = host, viral, stretch
        self.hosts = _numbered(hosts, host, "host_idx")
        self.virals = _numbered(virals, viral, "viral_idx")
        self.n_hosts, self.n_virals = self.hosts.count(), self.virals.count()

    def finished(self, done):
        """Finished pairs of the grid as distinct ``(host_idx, viral_idx)``."""
        return (
            done.select(self.host, self.viral)
            .distinct()
            .join(self.hosts, self.host)
            .join(self.virals, self.viral)
            .select("host_idx", "viral_idx")
        )

    def free(self, done):
        """Pending pairs as ranges ``(host_idx, first, last, n)``, both ends included."""
        size, n = self.stretch, self.n_virals
        start = F.col("stretch") * size
        end = F.least(start + size, F.lit(n)) - 1
        cells = self.finished(done).withColumn("stretch", F.floor(F.col("viral_idx") / size))
        order = Window.partitionBy("host_idx", "stretch").orderBy("viral_idx")
        before = F.coalesce(F.lag("viral_idx").over(order), start - 1) + 1
        is_last = F.lead("viral_idx").over(order).isNull()
        walked = cells.select(
            "host_idx",
            "viral_idx",
            before.alias("before"),
            F.when(is_last, end).alias("end"),
        )
        gaps = F.array(
            F.struct(F.col("before").alias("first"), (F.col("viral_idx") - 1).alias("last")),
            F.struct((F.col("viral_idx") + 1).alias("first"), F.col("end").alias("last")),
        )
        between = walked.select("host_idx", F.inline(gaps))
        stretches = F.sequence(F.lit(0).cast("bigint"), F.lit((n - 1) // size).cast("bigint"))
        untouched = (
            self.hosts.where(F.lit(n) > 0)
            .select("host_idx", F.explode(stretches).alias("stretch"))
            .join(cells.select("host_idx", "stretch").distinct(), ["host_idx", "stretch"], "left_anti")
            .select("host_idx", start.alias("first"), end.alias("last"))
        )
        ranges = between.where("first <= last").unionByName(untouched)
        return ranges.withColumn("n", F.col("last") - F.col("first") + 1)

    def placed(self, done):
        """``free`` with ``before``: how many pending pairs, in order, come before the range."""
        return with_offsets(self.free(done), ["host_idx", "first"], "n", out="before")

    def pairs(self, ranges):
        """The pairs of the ranges, by name."""
        cells = ranges.select("host_idx", F.explode(F.sequence("first", "last")).alias("viral_idx"))
        return (
            cells.join(self.virals, "viral_idx")
            .join(self.hosts, "host_idx")
            .select(self.host, self.viral, "host_idx", "viral_idx")
        )

    def progress(self, done):
        """One row: finished pairs, all pairs, whole per cent."""
        total = F.lit(self.n_hosts * self.n_virals).cast("bigint")
        counted = self.finished(done).agg(F.count(F.lit(1)).alias("n_done")).withColumn("n_total", total)
        return counted.withColumn("percent", percent_done("n_done", "n_total"))


def _numbered(df, name, out):
    return with_position(df.select(name).where(F.col(name).isNotNull()).distinct(), [name], out=out)


def cut(placed, start, stop):
    """The part of ``placed`` ranges that holds pending pairs ``start`` to ``stop - 1``."""
    low, high = F.lit(start).cast("bigint"), F.lit(stop).cast("bigint")
    inside = placed.where((F.col("before") < high) & (F.col("before") + F.col("n") > low))
    return inside.select(
        "host_idx",
        (F.col("first") + F.greatest(low - F.col("before"), F.lit(0))).alias("first"),
        F.least(F.col("last"), F.col("first") + high - F.col("before") - 1).alias("last"),
    )
