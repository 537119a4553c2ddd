"""Readers: posts, manifests, whole documents, chunks with vectors, collections, operational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom import schemas
from loreloom.functions import text as tx
from loreloom.sources import json_arrays


def read_posts(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Posts from JSON arrays (one or many files, each read by many tasks), or from JSON lines; Parquet folders are read as they are."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.schema(schemas.POSTS).json(path) if lines else json_arrays.read_array(spark, path, schemas.POSTS)


def read_manifest(spark: SparkSession, path: str, *, array: bool = False) -> DataFrame:
    """Items from JSON lines, which split, or from files that hold one JSON array each."""
    return spark.read.schema(schemas.MANIFEST).option("multiLine", array).json(path)


def write_manifest(items: DataFrame, path: str) -> None:
    """JSON lines, one item per row."""
    items.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with their content fingerprint and modification time."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        "path",
        F.decode("content", "UTF-8").alias("text"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"),
        tx.fingerprint(F.col("content"), F.to_utc_timestamp("modificationTime", F.current_timezone()))
        .alias("source_version"),
    )


def read_table(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """An operational table: a catalog name, or a Parquet file of that name in a folder."""
    return spark.table(name) if folder is None else spark.read.parquet(f"{folder}/{name}.parquet")


def scan_collection(points: DataFrame, collection: str, columns: list[str] | None = None) -> DataFrame:
    """One collection; naming columns prunes the rest at the scan."""
    rows = points.where(F.col("collection") == collection)
    return rows.select(*columns) if columns else rows


def collections(points: DataFrame) -> DataFrame:
    return points.select("collection").distinct()


def pair_vectors(chunks: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.join(vectors, keys, "inner")


def pairing_report(chunks: DataFrame, vectors: DataFrame, keys: list[str], vector: str, dim: int) -> DataFrame:
    """One row: chunks, vectors, unpaired on either side, vectors of another length."""
    c = chunks.select(*keys, F.lit(1).alias("__c"))
    v = vectors.select(*keys, F.size(vector).alias("__dim"))
    both = c.join(v, keys, "full_outer")
    has_c, has_v = F.col("__c").isNotNull(), F.col("__dim").isNotNull()
    return both.agg(
        F.count_if(has_c).alias("chunks"), F.count_if(has_v).alias("vectors"),
        F.count_if(has_c & ~has_v).alias("chunks_without_vector"),
        F.count_if(has_v & ~has_c).alias("vectors_without_chunk"),
        F.count_if(F.col("__dim") != dim).alias("wrong_dimension"),
    )


def assert_paired(report: DataFrame) -> None:
    row = report.first()
    bad = {k: row[k] for k in ("chunks_without_vector", "vectors_without_chunk", "wrong_dimension") if row[k]}
    if bad:
        raise ValueError(f"chunks and vectors do not pair up: {bad}")
