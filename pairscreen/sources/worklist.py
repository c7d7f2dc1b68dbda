"""Work lists: one name per line."""

from pyspark.sql import functions as F

from pairscreen.operators.sweep import worklist_report


def read_worklist(spark, path, inventory, name="host_proteome"):
    """Names of the list with ``found``: whether the inventory has a file of
    that name.  Blank lines are skipped; a last line without newline counts."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return worklist_report(lines, inventory, "line", name)
