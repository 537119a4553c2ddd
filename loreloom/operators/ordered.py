"""Ordered scans that survive a hot key.

A plain window over a key sorts the whole key in one task. These scans cut every key into blocks of
consecutive positions, work inside the blocks, carry one summary row per block across, and join the
carry back, so the largest unit of work is a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536
_B = "__block"


def _blocked(df: DataFrame, position: str, block: int) -> DataFrame:
    return df.withColumn(_B, F.floor(F.col(position) / F.lit(block)))


def _carry_join(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(carry, [*keys, _B], "left")


def fill_forward(df: DataFrame, keys: Sequence[str], position: str, value: Column, out: str,
                 *, block: int = BLOCK) -> DataFrame:
    """Last non-NULL *value* strictly before or at each row, per key, by integer *position*."""
    keys = list(keys)
    tmp = f"__v_{out}"
    b = _blocked(df.withColumn(tmp, value), position, block)
    inside = Window.partitionBy(*keys, _B).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.when(F.col(tmp).isNotNull(), F.col(position))
    ends = b.groupBy(*keys, _B).agg(F.max_by(tmp, filled).alias("__end"))
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    local = b.withColumn(out, F.last(tmp, ignorenulls=True).over(inside))
    return (_carry_join(local, carry, keys)
            .withColumn(out, F.coalesce(out, "__carry")).drop(tmp, _B, "__carry"))


def running_sum(df: DataFrame, keys: Sequence[str], position: str, value: Column, out: str,
                *, inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Prefix sum of *value* per key by integer *position*."""
    keys = list(keys)
    tmp = f"__v_{out}"
    b = _blocked(df.withColumn(tmp, value), position, block)
    inside = Window.partitionBy(*keys, _B).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = (b.groupBy(*keys, _B).agg(F.sum(tmp).alias("__total"))
             .withColumn("__carry", F.sum("__total").over(before)).drop("__total"))
    local = b.withColumn(out, F.sum(tmp).over(inside))
    total = F.col(out) + F.coalesce("__carry", F.lit(0))
    return (_carry_join(local, carry, keys)
            .withColumn(out, total if inclusive else total - F.coalesce(tmp, F.lit(0)))
            .drop(tmp, _B, "__carry"))


def row_numbers(df: DataFrame, keys: Sequence[str], position: str, out: str, *, block: int = BLOCK) -> DataFrame:
    """0-based rank by *position* inside each key."""
    return running_sum(df, keys, position, F.lit(1).cast("bigint"), out, inclusive=False, block=block)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, last: bool = False) -> DataFrame:
    """One whole row per key, the first (or last) in the order.

    A min/max over structs combines on the map side, so a key that holds a third of all rows sends
    one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    named = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    pick = F.max if last else F.min
    # Map-typed and other unordered columns must not take part in the comparison.
    ordered = F.struct(*named)
    choose = (F.max_by if last else F.min_by)(F.struct(*rest), ordered) if rest else pick(ordered)
    grouped = df.groupBy(*keys).agg(choose.alias("__row"))
    return grouped.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First *k* rows per key. ``row_number() <= k`` becomes a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
