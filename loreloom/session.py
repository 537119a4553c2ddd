"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SMALL_ROWS = 1 << 16  # rows of numbers that make a partition worth a task
TEXT_ROWS = 1 << 12  # rows of texts or sets that do
TEXT_PART = 8 << 20  # bytes of text that make one


def local_session(app: str = "loreloom", cpus: int | str = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if "SPARK_CHECKPOINT_DIR" in os.environ:
        builder = builder.config(CHECKPOINT_KEY, os.environ["SPARK_CHECKPOINT_DIR"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session with the setting unset (tests) gets a folder of its own.
    """
    shared = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    current = spark.sparkContext.getCheckpointDir()
    if shared:
        if current is None:
            spark.sparkContext.setCheckpointDir(shared)
        return
    if current is not None:
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loreloom-checkpoint-"))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, on storage every executor reaches."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What an action in this block shuffles is removed when the action ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """*df* as a compressed table in the shared folder, so that its rows are made once and only the table stays."""
    return written_in_parts([df], name)


def written_in_parts(parts: Sequence[DataFrame], name: str) -> DataFrame:
    """The rows of all *parts* as one such table. Parts are written one by one, so that only what one part shuffles is held at a time."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    folder = work_folder(spark, name)
    with shuffles_removed(spark):
        for part in parts:
            part.write.mode("append").option("compression", "zstd").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def drop_written(table: DataFrame) -> None:
    """Delete the files of a table that :func:`written` made; nothing that is to be read later may depend on it."""
    files = table.inputFiles()
    if files:
        spark = table.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Share a scan of few splits among all cores; a scan with enough splits stays as it is.

    Meant for plain scans: their number of partitions is known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def in_few_parts(df: DataFrame, rows: int, each: int = SMALL_ROWS) -> DataFrame:
    """*df*, of at most *rows* rows, in no more partitions than one for *each* rows or one a core.

    A table of few rows out of many partitions is many files, and each file costs its task a process or a request.
    Partitions are put together where they are, nothing moves; with as few partitions or fewer, *df* stays as it is.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def gathered(df: DataFrame, text: str, part_bytes: int = TEXT_PART) -> DataFrame:
    """A scan of many small splits in tasks of about *part_bytes* of text, at least one a core; other scans stay as they are."""
    if df.rdd.getNumPartitions() <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return in_few_parts(df, int(df.agg(F.sum(F.octet_length(text)).alias("s")).first().s or 0), part_bytes)


class Scratch:
    """Tables in the shared folder that a loop of rounds writes, and deletes once the next round has what it needs.

    Reliable like a checkpoint: executors can be lost, what is kept is on shared storage.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rows: int | None = None  # that a table has at most, where it is known
        self.folders: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, bounded: bool = True) -> DataFrame:
        if bounded and self.rows is not None:
            df = in_few_parts(df, self.rows)
        folder = work_folder(self.spark, "round")
        df.write.parquet(folder)
        table = self.spark.read.schema(df.schema).parquet(folder)
        self.folders[id(table)] = (table, folder)
        return table

    def clear(self, *still: DataFrame | None) -> None:
        """Delete all tables but *still*; nothing that is to be read later may depend on the others."""
        jvm = self.spark.sparkContext._jvm
        for key in [k for k in self.folders if not any(t is self.folders[k][0] for t in still)]:
            path = jvm.org.apache.hadoop.fs.Path(self.folders.pop(key)[1])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
