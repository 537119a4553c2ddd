"""Exact dedup by two-pass Bloom filtering.

Pass one hashes every text and marks, in a Bloom filter that counts to two, which filter positions were
hit at least twice. Pass two looks every text up: a text whose positions were not all hit twice is unique
and passes straight through. Only the other rows shuffle, by SHA-256, which decides.

The filter takes 16 bits a row up to ``MAX_BITS`` (16 MB), the bound of what is broadcast. A corpus beyond
that fills the filter more, so more unique rows shuffle their 64-character hash; the result stays the same.

Defined results: null texts count as empty; a null id is smaller than every id; of rows equal in text and
id one is kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import fresh
from loreloom.session import TEXT_ROWS, cut_lineage, in_few_parts

MAX_BITS = 1 << 27
SEGMENT = 1 << 16  # filter positions merged by one group
FLUSH = 1 << 21  # hashes a task gathers before it sends them on


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two filter positions of each 64-bit hash."""
    h = hashes.view(np.uint64)
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(33)) & np.uint64(bits - 1)]).astype(np.uint32)


def _pack(pos: np.ndarray) -> pa.RecordBatch:
    """Rows of (segment, positions hit), each position once; the top bit tells that it was hit again."""
    hit, times = np.unique(pos, return_counts=True)
    coded = hit | np.where(times > 1, np.uint32(1 << 31), np.uint32(0))
    cuts = np.flatnonzero(np.diff(hit // SEGMENT, prepend=-1)) if len(hit) else np.empty(0, int)
    parts = np.split(coded, cuts[1:]) if len(hit) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(hit[cuts] // SEGMENT, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
        ["segment", "hits"])


def _hit_twice(table: pa.Table) -> pa.Table:
    """One segment of the filter: bits of the positions hit at least twice."""
    coded = np.frombuffer(b"".join(table["hits"].to_pylist()), np.uint32)
    at = (coded & np.uint32((1 << 31) - 1)) % SEGMENT
    times = np.bincount(at, 1 + (coded >> np.uint32(31)).astype(np.int64), minlength=SEGMENT)
    return pa.table({"segment": table["segment"][:1], "bits": pa.array([np.packbits(times > 1).tobytes()], pa.binary())})


def repeat_filter(hashes: DataFrame) -> tuple[int, np.ndarray]:
    """Bits of the filter and its bytes, from a table with one column of 64-bit hashes."""
    bits = 1 << int(np.clip(int(max(hashes.count(), 1) * 16 - 1).bit_length(), 16, MAX_BITS.bit_length() - 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= FLUSH:
                yield _pack(positions(np.concatenate(held), bits))
                held = []
        if held:
            yield _pack(positions(np.concatenate(held), bits))

    segments = (hashes.mapInArrow(pack, "segment int, hits binary").groupBy("segment")
                .applyInArrow(_hit_twice, "segment int, bits binary"))
    filled = np.zeros(bits // 8, np.uint8)
    for row in segments.collect():  # at most MAX_BITS / 8 bytes
        filled[row.segment * SEGMENT // 8:(row.segment + 1) * SEGMENT // 8] = np.frombuffer(row.bits, np.uint8)
    return bits, filled


def perhaps_repeated(df: DataFrame, key: Column) -> Column:
    """A column that is false only where no other row of *df* has the same key."""
    hashed = F.xxhash64(key)
    bits, filled = repeat_filter(df.select(hashed.alias("h")))
    shared = df.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def look_up(h):
        import pandas as pd

        at = positions(h.to_numpy(), bits)
        seen = shared.value[at >> np.uint32(3)] >> (np.uint32(7) - (at & np.uint32(7))) & 1
        return pd.Series(reduce(np.logical_and, seen.astype(bool)))

    return look_up(hashed)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of *docs*: doc_id, keep_id, group_size, kept, text_sha256."""
    key = F.coalesce(F.col(text), F.lit(""))
    keys = cut_lineage(docs.withColumn("__again", perhaps_repeated(docs, key)).select(
        F.col(doc_id).alias("doc_id"), F.sha2(key, 256).alias("text_sha256"), "__again"))
    alone = keys.where(~F.col("__again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rows = keys.where("__again").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("__n"))
    # Written once, both sides of the join are plain shuffles, which Spark splits where one text is in a third of all rows.
    groups = cut_lineage(rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("__n").alias("group_size")))
    again = (rows.join(groups, "text_sha256").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
             .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__i") == 1)).alias("kept"), "text_sha256"))
    return alone.unionByName(again)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """*docs* without exact copies, all columns as they were; of equal texts the largest id stays."""
    key, again, sha = F.coalesce(F.col(text), F.lit("")), fresh(docs, "__again"), fresh(docs, "__sha")
    flagged = docs.withColumn(again, perhaps_repeated(docs, key))
    suspects = flagged.where(again).drop(again).withColumn(sha, F.sha2(key, 256))
    keep = suspects.groupBy(sha).agg(F.max(doc_id).alias("__keep"))
    same = (suspects[sha] == keep[sha]) & suspects[doc_id].eqNullSafe(keep["__keep"])
    # (hash, id) are the join's keys, so a text that a third of all rows share does not meet in one task.
    stay = in_few_parts(suspects.join(keep, same, "left_semi").dropDuplicates([sha, doc_id]).drop(sha), docs.count(), TEXT_ROWS)
    return flagged.where(~F.col(again)).drop(again).unionByName(stay)
