"""A keyed table in buckets: a load rewrites the buckets it touches, and readers see a load whole or not at all.

Rows lie in ``files/load=N/bucket=B`` by the hash of their key. ``manifest/version=N`` names, for every bucket, the load
that wrote it last; it is written after the files, and its _SUCCESS file commits the load. A load that fails leaves
files that no manifest names, and its number is used again. One writer at a time; readers keep the version they opened.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.sources import sinks

BUCKETS = 256  # chosen once, by the first load; a bucket of a large table should be some hundred MB
_B = "bucket"


def _manifest(spark: SparkSession, path: str) -> tuple[int, int, dict[int, int]]:
    """Version (-1 before the first load), number of buckets, and the load of each bucket that has rows."""
    newest = sinks.latest_version(spark, f"{path}/manifest")
    if newest is None:
        return -1, 0, {}
    rows = spark.read.parquet(newest).collect()  # one row for each bucket
    return int(newest.rsplit("=", 1)[1]), rows[0].buckets, {r.bucket: r.load for r in rows if r.bucket is not None}


def _folders(path: str, loads: dict[int, int]) -> list[str]:
    return [f"{path}/files/load={load}/{_B}={b}" for b, load in sorted(loads.items())]


def load(points: DataFrame, path: str, key: str, *, order: Sequence[Column] | None = None, recreate: bool = False, prune: bool = False,
         buckets: int = BUCKETS) -> int:
    """Upsert rows (of several with one key the last in the order stays) and return the version; only touched buckets are rewritten.

    ``recreate`` starts over; ``prune`` keeps only keys of this load, so untouched buckets are dropped without being read.
    """
    spark = points.sparkSession
    version, count, loads = _manifest(spark, path)
    count = buckets if recreate or not count else count
    old = {} if recreate else loads
    number = version + 1
    once = sinks.last_write(points, key, order) if order else points
    placed = once.withColumn(_B, F.pmod(F.xxhash64(key), F.lit(count)).cast("int"))
    out = f"{path}/files/load={number}"
    # The new rows are written once; their folders say which buckets they touch.
    arrived = f"{path}/arrived/load={number}"
    placed.hint("rebalance", F.col(_B)).write.mode("overwrite").partitionBy(_B).parquet(arrived)
    new = spark.read.option("basePath", arrived).schema(placed.schema).parquet(arrived)
    touched = {r[0] for r in new.select(_B).distinct().collect()}  # at most one row for each bucket
    before = {b: n for b, n in old.items() if b in touched}
    rows = new
    if before and not prune:
        kept = _read(spark, path, before, placed.schema).join(new.select(_B, key), [_B, key], "left_anti")
        rows = kept.select(*placed.columns).unionByName(new)
    rows.hint("rebalance", F.col(_B)).write.mode("overwrite").partitionBy(_B).parquet(out)
    left = {} if prune else {b: n for b, n in old.items() if b not in touched}
    named = sorted((left | dict.fromkeys(touched, number)).items()) or [(None, None)]
    spark.createDataFrame([(b, n, count) for b, n in named], "bucket int, load int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")
    sinks.drop_folder(spark, arrived)
    return number


def _read(spark: SparkSession, path: str, loads: dict[int, int], schema) -> DataFrame:
    return spark.read.option("basePath", f"{path}/files").schema(schema).parquet(*_folders(path, loads))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest committed version; None before the first load. A table without rows has no columns to show, hence None as well."""
    _, _, loads = _manifest(spark, path)
    return spark.read.option("basePath", f"{path}/files").parquet(*_folders(path, loads)).drop("load", _B) if loads else None


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete files that the newest version does not name and return how many folders went; older versions can no longer be read."""
    _, _, loads = _manifest(spark, path)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/files")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = {f.split("/files/", 1)[1] for f in _folders(path, loads)}
    gone = 0
    for one in fs.listStatus(root):
        for folder in fs.listStatus(one.getPath()):
            at = folder.getPath()
            if folder.isDirectory() and f"{one.getPath().getName()}/{at.getName()}" not in named:
                fs.delete(at, True)
                gone += 1
    return gone
