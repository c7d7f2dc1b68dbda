"""Pending ranges of a grid of pairs against the plain complement."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pairscreen.operators.grid import PairGrid, cut

DONE = "host_proteome string, viral_proteome string"


def names(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("stretch", [1, 4, 65_536])
def test_ranges_are_the_complement(spark, stretch):
    hosts, virals = [f"h{i:02d}" for i in range(9)], [f"v{i:02d}" for i in range(13)]
    rnd = random.Random(3)
    done = {(h, v) for h in hosts for v in virals if rnd.random() < 0.5}
    done |= {("h00", v) for v in virals}  # all done
    done = {p for p in done if p[0] != "h01"}  # none done
    rows = sorted(done) * 2 + [("h03", "elsewhere"), ("gone", "v01"), (None, "v01"), ("h03", None)]
    grid = PairGrid(
        names(spark, hosts + hosts[:3] + [None], "host_proteome"),
        names(spark, virals + [None], "viral_proteome"),
        stretch=stretch,
    )
    given = spark.createDataFrame(rows, DONE)
    want = sorted(set(itertools.product(hosts, virals)) - done)
    got = [(r.host_proteome, r.viral_proteome) for r in grid.pairs(grid.free(given)).collect()]
    assert sorted(got) == want
    p = grid.progress(given).first()
    assert (p.n_done, p.n_total) == (len(done), len(hosts) * len(virals))
    # Cut into waves, every pending pair comes once and in order.
    placed = grid.placed(given).cache()
    waves = [
        sorted((r.host_proteome, r.viral_proteome) for r in grid.pairs(cut(placed, s, s + 10)).collect())
        for s in range(0, len(want), 10)
    ]
    assert sum(waves, []) == want and all(len(w) == 10 for w in waves[:-1])
    placed.unpersist()


def test_empty_sides(spark):
    hosts, none = names(spark, ["h"], "host_proteome"), names(spark, [], "viral_proteome")
    done = spark.createDataFrame([], DONE)
    assert PairGrid(hosts, none).free(done).count() == 0
    assert PairGrid(hosts.limit(0), names(spark, ["v"], "viral_proteome")).free(done).count() == 0


def test_the_grid_is_never_built(spark):
    """A million pairs, three of them finished: a handful of rows."""
    n = 1000
    hosts = spark.range(n).select(F.format_string("h%04d", "id").alias("host_proteome"))
    virals = spark.range(n).select(F.format_string("v%04d", "id").alias("viral_proteome"))
    done = spark.createDataFrame([("h0005", "v0000"), ("h0005", "v0500"), ("h0009", "v0999")], DONE)
    ranges = PairGrid(hosts, virals).free(done)
    assert ranges.count() == n + 1 and ranges.agg(F.sum("n")).first()[0] == n * n - 3
