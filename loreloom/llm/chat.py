"""Chat formatting after collapsing cumulative snapshots, in DataFrame operations only.

A service that logs a conversation after every turn leaves snapshots that are beginnings of longer ones. Every
turn gets a hash of its place, role and text; the exclusive-or of a conversation's first k such hashes, in two
64-bit words, stands for its beginning of k turns. An anti-join against all proper beginnings keeps the
conversations that begin no longer one; of equal conversations the smallest id stays. Texts are shuffled once, for rendering.

Turns are worked on in parts of ``PART`` turn numbers, so a conversation with a third of all rows is no single task, and
long conversations are rendered in as many rows. Defined results: turns are ordered by turn number, role and text,
nulls first; repeated turns count once; a null text is empty, a null role is written ``none``; rows without a
conversation id belong to no conversation and are not rendered; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.session import cut_lineage

PART = 1_024
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _part(turn: str) -> Column:
    return F.coalesce(F.floor(F.col(turn) / PART), F.lit(-(1 << 62)))


def beginnings(turns: DataFrame) -> DataFrame:
    """(conv_id, k, x1, x2): every beginning of every conversation; turns: conv_id, turn, role, text."""
    # Texts are replaced by hashes before anything moves; equal turns become one.
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = turns.select("conv_id", "turn", "role", _part("turn").alias("part"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")).distinct()
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "t1", "t2")
    numbered = cut_lineage(slim.withColumn("place", F.row_number().over(inside)))
    sizes = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = numbered.join(starts, ["conv_id", "part"]).withColumn("k", F.col("start") + F.col("place"))
    role = F.coalesce(F.concat(F.lit("r"), "role"), F.lit(""))
    hashed = placed.select("conv_id", "part", "k", F.xxhash64("k", role, "t1").alias("h1"), F.xxhash64(role, "t2", "k").alias("h2"))
    run = Window.partitionBy("conv_id", "part").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rolled = cut_lineage(hashed.select("conv_id", "part", "k", F.bit_xor("h1").over(run).alias("x1"), F.bit_xor("h2").over(run).alias("x2")))
    ends = rolled.groupBy("conv_id", "part").agg(F.max_by("x1", "k").alias("e1"), F.max_by("x2", "k").alias("e2"))
    carry = ends.select("conv_id", "part", F.coalesce(F.bit_xor("e1").over(before), F.lit(0)).alias("c1"), F.coalesce(F.bit_xor("e2").over(before), F.lit(0)).alias("c2"))
    return rolled.join(carry, ["conv_id", "part"]).select("conv_id", "k", F.col("x1").bitwiseXOR(F.col("c1")).alias("x1"), F.col("x2").bitwiseXOR(F.col("c2")).alias("x2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal) of the conversations that are no beginning of a longer one, equal ones once."""
    begun = cut_lineage(beginnings(turns))
    whole = begun.groupBy("conv_id").agg(F.max("k").alias("n"), F.max_by("x1", "k").alias("x1"), F.max_by("x2", "k").alias("x2"))
    lengths = whole.select("conv_id", "n")
    proper = begun.join(lengths, "conv_id").where("k < n").select("k", "x1", "x2").distinct()
    once = whole.groupBy("n", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    longer = proper.withColumnRenamed("k", "n")
    return once.join(longer, ["n", "x1", "x2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_equal")


def rendered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, part, n_turns, n_equal, text: the maximal conversations, rendered; one row for each ``PART`` turn numbers."""
    turns = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kept = cut_lineage(maximal(turns))
    line = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("none")), F.lit(MIDDLE), t["text"], F.lit(CLOSE))
    order = F.sort_array(F.collect_set(F.struct("turn", "role", "text")))
    rows = turns.withColumn("part", _part("turn")).join(kept, "conv_id").groupBy("conv_id", "part").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_equal").alias("n_equal"), F.concat_ws("", F.transform(order, line)).alias("text"))
    return rows.withColumn("part", F.when(F.col("part") > -(1 << 62), F.col("part")))
