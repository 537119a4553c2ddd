"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a unit vector; its hash is the
signed axis it is nearest to. Each of several tables rotates anew; with ``digits`` above one a table's hash is several axes.
Every vector is stored in one bucket of each table. A query looks into the buckets of its ``probes`` nearest axes in each table,
as many on a small table as on a large one, and what it finds there is ranked exactly, by Euclidean distance in double precision on the original vectors.

Buckets meet queries in groups of at most about ``GROUP`` vectors: counts per bucket, of which there are at most
tables x (2 x dimension) ** digits, decide into how many groups a bucket is cut. A query that finds fewer than k
neighbours where more exist looks into all buckets, so its result is exact. The index is not fitted on data.

Defined results: vectors that are null, zero or hold a null or non-finite component, and rows without an id, take no
part; vectors of another length than the query's are no candidates; rows with one id count once, with their
nearest vector; ties go to the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.session import cut_lineage

TABLES = 4
PROBES = 40
LEAST = 0  # read nowhere; a test sets it
DIGITS = 1
GROUP = 512
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, which have a power of two components."""
    size, half = x.shape[1], 1
    while half < size:
        x = x.reshape(len(x), -1, 2, half)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(len(x), size)
        half *= 2
    return x / np.sqrt(size)


def rotated(x: np.ndarray, table: int, digit: int, seed: int = SEED) -> np.ndarray:
    """Unit vectors of the rows, padded to a power of two and pseudo-rotated."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), size))
    out[:, :x.shape[1]] = x / np.abs(x).max(1, keepdims=True)
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    signs = np.random.default_rng([seed, table, digit, size]).choice([-1.0, 1.0], (3, size))
    for s in signs:
        out = hadamard(out * s)
    return out


def probed(x: np.ndarray, table: int, probes: int, digits: int, seed: int = SEED) -> np.ndarray:
    """Codes of the *probes* best buckets of each row, best first; the first is the row's own."""
    codes, scores = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for digit in range(digits):
        turned = rotated(x, table, digit, seed)
        signed = np.concatenate([turned, -turned], 1)
        best = np.argsort(-signed, axis=1, kind="stable")[:, :probes]
        sums = (scores[:, :, None] + np.take_along_axis(signed, best, 1)[:, None, :]).reshape(len(x), -1)
        joined = (codes[:, :, None] * signed.shape[1] + best[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-sums, axis=1, kind="stable")[:, :probes]
        codes, scores = np.take_along_axis(joined, order, 1), np.take_along_axis(sums, order, 1)
    return codes


def usable(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows that take part, by length of their vectors: places and a matrix each."""
    found = {}
    sizes = np.array([-1 if v is None else v for v in pc.list_value_length(vectors).to_pylist()], int)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        flat = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), size)
        good = np.isfinite(flat).all(1) & (flat != 0).any(1)
        if good.any():
            found[int(size)] = (at[good], flat[good])
    return found


def nearest(queries: np.ndarray, ids: np.ndarray, stored: np.ndarray, stored_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, stored id, distance) of each query's k nearest stored vectors with another id."""
    out = []
    norms = (stored * stored).sum(1)
    for q, own in zip(queries, ids, strict=True):
        rough = norms - 2 * (stored @ q) + q @ q
        rough[stored_ids == own] = np.inf
        # The product's rounding only chooses whom to measure exactly.
        slack = 1e-9 * (norms.max(initial=0) + q @ q)
        bound = np.partition(rough, k - 1)[k - 1] if len(rough) > k else np.inf
        at = np.flatnonzero((rough <= bound + slack) & (stored_ids != own))
        score = np.sqrt(((stored[at] - q) ** 2).sum(1))
        best = np.lexsort((stored_ids[at], score))[:k]
        out.append((np.full(len(best), own), stored_ids[at][best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(vectors: DataFrame, is_query, k: int, tables: int, probes: int, digits: int) -> DataFrame:
    """(query_id, vec_id, score) found; vectors: id, vector."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, (_, x) in usable(batch.column(1)).items():
                for table in range(tables):
                    codes, n = np.unique(probed(x, table, 1, digits)[:, 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), v), pa.int32()) for v in (size, table)] + [pa.array(codes), pa.array(n)],
                                                     ["size", "place", "code", "n"])

    counts = vectors.select("id", "vector").mapInArrow(code, "size int, place int, code long, n long").groupBy("size", "place", "code").agg(F.sum("n").alias("n"))
    rows = counts.collect()
    cuts = {(r.size, r.place, r.code): -(-r.n // GROUP) for r in rows}
    shared = vectors.sparkSession.sparkContext.broadcast(cuts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in batches:
            ids, asks = batch.column(0).to_numpy(), np.array(batch.column(2).to_pylist(), bool)
            for size, (at, x) in usable(batch.column(1)).items():
                for table in range(tables):
                    rows = []  # (row of x, code, group, whether it asks)
                    codes = probed(x, table, 1, digits)[:, 0].tolist()
                    rows += [(i, c, (int(ids[at[i]]) * 0x9E3779B1 >> 7) % cuts[size, table, c], False) for i, c in enumerate(codes)]
                    asking = np.flatnonzero(asks[at])
                    if len(asking):
                        wanted = probed(x[asking], table, probes, digits).tolist()
                        rows += [(i, c, g, True) for i, cs in zip(asking.tolist(), wanted, strict=True) for c in cs for g in range(cuts.get((size, table, c), 0))]
                    which = np.array([r[0] for r in rows], int)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), v), pa.int32()) for v in (size, table)] + [pa.array([r[j] for r in rows], t) for j, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.bool_()))]
                        + [pa.array(ids[at[which]], pa.int64()), pa.array([x[i].tobytes() for i in which], pa.binary())],
                        ["size", "place", "code", "cut", "asks", "id", "vector"])

    def rank(table: pa.Table) -> pa.Table:
        asks, ids = np.array(table["asks"].to_pylist(), bool), table["id"].to_numpy()
        x = np.frombuffer(b"".join(table["vector"].to_pylist())).reshape(len(ids), -1)
        if not asks.any() or asks.all():
            found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        else:
            found = nearest(x[asks], ids[asks], x[~asks], ids[~asks], k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    placed = vectors.select("id", "vector", is_query.alias("asks")).mapInArrow(
        place, "size int, place int, code long, cut int, asks boolean, id long, vector binary")
    found = placed.groupBy("size", "place", "code", "cut").applyInArrow(rank, "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def neighbours(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", *,
               tables: int = TABLES, probes: int = PROBES, digits: int = DIGITS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row for which the column *is_query* holds."""
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("q"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = cut_lineage(best(_search(rows, F.col("q"), k, tables, probes, digits)))
    full = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") == k).select(F.col("query_id").alias("id"))
    short = cut_lineage(rows.where("q").join(full, "id", "left_anti").select("id").distinct())
    if not short.isEmpty():
        # Every bucket: exact, for the few that found too little.
        again = rows.drop("q").join(short.withColumn("q", F.lit(True)), "id", "left").withColumn("q", F.coalesce("q", F.lit(False)))
        first = first.join(short, first["query_id"] == short["id"], "left_anti").unionByName(best(_search(again, F.col("q"), k, 1, 1 << 30, 1)))
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
