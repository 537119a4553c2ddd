"""JSON arrays of objects, read by many tasks.

A file that holds one array is no line format, so Spark gives it to one task. Here the text source cuts the file after every
closing brace, which it does by byte ranges; what is left is to say which braces are inside strings and which close an
object of the array. Each piece is summed up by its quotes and by the braces it opens if it begins inside or outside a
string; sums over the pieces of a byte range, then over the ranges of a file, give every piece its state. The pieces
between two closed objects are one object and meet by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.session import cut_lineage

_STRING = '"[^"]*("|$)'  # a string, or one that goes on in the next piece


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the byte range), n (from 1 inside the range), value."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))
    order = Window.partitionBy("file", "start").orderBy("i")
    return raw.withColumn("n", F.row_number().over(order)).drop("i")


def _before(ranges: DataFrame, total: Column, name: str) -> DataFrame:
    """Sum over the earlier byte ranges of a file: a file has one row for each range."""
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn(name, F.coalesce(F.sum(total).over(w), F.lit(0))).select("file", "start", name)


def _running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Sum over the earlier pieces of the byte range."""
    w = Window.partitionBy("file", "start").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def _numbered(pieces: DataFrame) -> DataFrame:
    """file, start, n, object: how many objects of the array are closed before the piece."""
    keys = ["file", "start"]
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped characters; no closing brace is one
    opens = lambda c: F.regexp_count(F.regexp_replace(c, _STRING, ""), F.lit(r"\{"))
    slim = cut_lineage(pieces.withColumn("bare", bare).select(
        *keys, "n", F.regexp_count("bare", F.lit('"')).alias("quotes"), opens(F.col("bare")).alias("outside"), opens(F.concat(F.lit('"'), "bare")).alias("inside")))
    quotes = _before(slim.groupBy(*keys).agg(F.sum("quotes").alias("q")), F.col("q"), "q0")
    started = _running(slim, F.col("quotes"), "q").join(quotes, keys).withColumn("within", (F.col("q") + F.col("q0")) % 2 == 1)
    closes = F.when((F.col("quotes") % 2 == 1) == F.col("within"), 1).otherwise(0)
    moved = cut_lineage(started.select(*keys, "n", closes.alias("closes"), (F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside")) - closes).alias("step")))
    depth = _before(moved.groupBy(*keys).agg(F.sum("step").alias("s")), F.col("s"), "d0")
    deep = _running(moved, F.col("step"), "d").join(depth, keys).withColumn("ends", ((F.col("d") + F.col("d0") + F.col("step") == 0) & (F.col("closes") == 1)).cast("long"))
    deep = cut_lineage(deep.select(*keys, "n", "ends"))
    done = _before(deep.groupBy(*keys).agg(F.sum("ends").alias("e")), F.col("e"), "e0")
    return _running(deep, F.col("ends"), "e").join(done, keys).select(*keys, "n", (F.col("e") + F.col("e0")).alias("object"))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``file, object, json``: the objects of the array in every file of the path, numbered from 0 in their order."""
    pieces = _pieces(spark, path)
    placed = pieces.join(_numbered(pieces), ["file", "start", "n"])
    whole = placed.groupBy("file", "object").agg(F.sort_array(F.collect_list(F.struct("start", "n", "value"))).alias("p"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    # What follows the last object holds no brace that opens one.
    return whole.select("file", "object", F.regexp_extract(text, r"(?s)\{.*", 0).alias("json")).where("json != ''")


def read_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of the arrays; what a schema does not name is left out, as with Spark's JSON reader."""
    return read_objects(spark, path).select(F.from_json("json", schema).alias("o")).select("o.*")
