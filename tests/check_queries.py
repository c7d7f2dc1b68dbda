"""Run every registered query next to its SQL and compare the rows.

    python tests/check_queries.py [sf folder] [query ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry
from pairscreen.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def rows(df):
    """Rows as a sorted list of tuples, columns by name."""
    cols = sorted(df.columns)
    out = []
    for r in df[cols].itertuples(index=False):
        out.append(tuple(v.item() if hasattr(v, "item") else v for v in r))
    return cols, sorted(out, key=repr)


def compare(spark, con, folder, name):
    """``None`` if equal, else what differs."""
    got = entry.queries()[name](spark, folder)
    sql = entry.oracle_sql().get(name)
    pdf = got.toPandas()
    if sql is None:
        return None if len(pdf) else "no rows"
    want = con.execute(sql).df()
    (gc, gr), (wc, wr) = rows(pdf), rows(want)
    if gc != wc:
        return f"columns {gc} against {wc}"
    if len(gr) != len(wr):
        return f"{len(gr)} rows against {len(wr)}"
    bad = [(a, b) for a, b in zip(gr, wr) if repr(a) != repr(b)]
    if bad:
        return f"{len(bad)} of {len(gr)} rows differ, first {bad[0]}"
    types = [(c, str(pdf[c].dtype), str(want[c].dtype)) for c in gc if str(pdf[c].dtype) != str(want[c].dtype)]
    return f"ok but types {types}" if types else None


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark = build_session(
        master="local[8]",
        shuffle_partitions=os.environ.get("CHECK_PARTITIONS", "8"),
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    failed = 0
    for name in wanted:
        t = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as e:  # keep going: one report for all queries
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{name:22s} {time.time() - t:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} ok")
    spark.stop()
