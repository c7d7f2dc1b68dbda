"""Files of a folder by name and size.

Spark's scans leave out empty files; an inventory must not.
"""

from fnmatch import fnmatch

from pyspark.sql import functions as F

FILE = "path string, size bigint"


def list_files(spark, path, pattern="*"):
    """``(path, size)`` of the files in ``path`` (a folder, a file or a glob of
    them) whose names match ``pattern``.  Names only pass through the driver,
    which lists them for every scan anyway."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm_path)
    if not found:
        raise FileNotFoundError(path)
    rows = []
    for status in found:
        for f in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            name = f.getPath().getName()
            if f.isFile() and fnmatch(name, pattern) and not name.startswith(("_", ".")):
                rows.append((f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(rows, FILE)
