"""Continuous ingest: new post files -> chunks -> points, idempotent per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loreloom.operators import ordered
from loreloom.sources import sinks

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State processors need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def ingest(posts: DataFrame, path: str, checkpoint: str, to_points: Callable[[DataFrame], DataFrame], *, document: str = "post_id",
           available_now: bool = True) -> StreamingQuery:
    """Append the points of every micro-batch as one version; readers take each document's newest version whole.

    Posts are unique by *document* inside a micro-batch (of several the least row stays), and *to_points* keeps that column. A post
    that yields no points leaves one row with a NULL ``point_id``, so that its earlier points go.
    """

    def load(batch: DataFrame, number: int) -> None:
        once = ordered.first_per_key(batch, [document], [F.struct(*[c for c in batch.columns if c != document])])
        sinks.append_version(once.select(document).join(to_points(once), document, "left"), path, number)

    writer = posts.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_files(rows: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Rows of a stream as Parquet, one folder per micro-batch; a repeated batch replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
