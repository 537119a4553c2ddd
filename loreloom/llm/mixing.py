"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected ``target / source size`` times. Documents are laid in a row by
size class and hash; the expected copies are prefix-summed, one random offset per source is added, and a
document is emitted once for each integer its interval crosses. Neighbours in the row have nearly the
same size, so the words taken differ from the target by about one document. Documents of more than
1 / ``LONG_PART`` of the target are sampled first; the rate of the rest makes up for what they took.

The prefix sum has two levels (runs of a source's row, then places inside a run), so a source with a
third of all rows is no single task. Only sums per source and run reach a window.

Defined results: null texts have size 0; null is a source of its own, after all others; a source
without words has target 0 and takes nothing; equal rows are rows of their own; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.common import word_count
from loreloom.session import TEXT_ROWS, cut_lineage, in_few_parts

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20_240_607
LONG_PART = 64
RUN = 512  # documents of one size class that are numbered together


def targets(sources: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets for a table of (source, source_size), one row per source.

    Filling by weight, cutting at ``most`` times a source's size and sharing the excess anew ends where each
    target is min(cap, level * weight) for one level. In the order of cap / weight the capped sources come
    first, so the level follows from prefix sums.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1
    weighed = sources.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("__cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_first())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.least(F.lit(share), F.lit(most)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    left = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    level = weighed.withColumn("__level", rest / left)
    # Setting a source to its cap raises the level while the cap binds and lowers it after that.
    return level.select("source", "source_size", F.least("__cap", F.max("__level").over(everything) * F.col("__w")).cast("double").alias("target"))


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """__row (all columns of docs), __id, __source, __size and __h."""
    return docs.select(F.struct("*").alias("__row"), F.col(doc_id).alias("__id"), F.col(source).alias("__source"), word_count(text).alias("__size"),
                       F.xxhash64(F.lit(seed), F.col(doc_id)).alias("__h"))


def _crossed(place: Column, rate: Column, seed: int) -> Column:
    """Integers in the place's interval of the prefix sum of expected copies, moved by the source's offset."""
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("__source")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor((place + 1) * rate + offset) - F.floor(place * rate + offset)).cast("int")


def copies(rows: DataFrame, keys: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST,
           long_part: int = LONG_PART, seed: int = SEED) -> DataFrame:
    """*rows* with __source_size, __target and __copies, how often the mix takes the row.

    *keys* are __id, __source, __size and __h of the same rows, written once, for the sums.
    """
    sums = keys.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    wanted = cut_lineage(targets(sums, weights=weights, share=share, most=most)).select(
        F.col("source").alias("__t"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    target_rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    kind = F.when(F.col("__size") * long_part > F.col("__target"), -1).otherwise(F.floor(64 * F.log2(1 + F.col("__size")))).cast("int")

    def classed(df: DataFrame) -> DataFrame:
        return df.join(wanted, df["__source"].eqNullSafe(wanted["__t"])).drop("__t").withColumn("__class", kind)

    inside = ["__size", "__h", "__id"]
    slim = classed(keys)
    of_long = Window.partitionBy("__source").orderBy(*inside)  # fewer than long_part * source size / target rows
    long_taken = (slim.where("__class = -1").withColumn("__copies", _crossed(F.row_number().over(of_long) - 1, target_rate, seed))
                  .groupBy(F.col("__source").alias("__t")).agg(F.sum(F.col("__copies") * F.col("__size")).alias("__long")))
    # Classes and runs are at most sources x size classes, so they need no more than a partition a core.
    classes = cut_lineage(in_few_parts(slim.groupBy("__source", "__class", "__target").agg(F.count("*").alias("__n"), F.sum("__size").alias("__sum")), 0))
    rest = classes.groupBy("__source", "__target").agg(F.sum(F.when(F.col("__class") >= 0, F.col("__sum")).otherwise(0)).alias("__rest"))
    made_up = rest.join(long_taken, rest["__source"].eqNullSafe(long_taken["__t"]), "left").select(
        F.col("__source").alias("__t"),
        F.when(F.col("__rest") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), (F.col("__target") - F.coalesce("__long", F.lit(0))) / F.col("__rest"))))
        .otherwise(F.lit(0.0)).alias("__rest_rate"))
    runs = classes.join(made_up, classes["__source"].eqNullSafe(made_up["__t"])).select(
        F.col("__source").alias("__s"), F.col("__class").alias("__c"), "__rest_rate",
        F.when(F.col("__class") >= 0, F.ceil(F.col("__n") / RUN)).otherwise(1).alias("__runs"))
    runs = cut_lineage(in_few_parts(runs, 0))

    def in_runs(df: DataFrame) -> DataFrame:
        same = df["__source"].eqNullSafe(runs["__s"]) & (df["__class"] == runs["__c"])
        return df.join(runs, same).drop("__s", "__c").withColumn("__run", F.pmod(F.col("__h"), F.col("__runs")))

    counts = in_runs(slim).groupBy("__source", "__class", "__run").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy("__source", F.col("__class") < 0).orderBy("__class", "__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__source").alias("__s"), F.col("__class").alias("__c"), F.col("__run").alias("__r"),
                           F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    in_run = Window.partitionBy("__source", "__class", "__run").orderBy(*inside)
    ranked = in_runs(classed(rows)).withColumn("__rank", F.row_number().over(in_run) - 1)
    placed = ranked.join(starts, ranked["__source"].eqNullSafe(starts["__s"]) & (ranked["__class"] == starts["__c"]) & (ranked["__run"] == starts["__r"]))
    rate = F.when(F.col("__class") < 0, target_rate).otherwise(F.col("__rest_rate"))
    return placed.withColumn("__copies", _crossed(F.col("__start") + F.col("__rank"), rate, seed))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, seed: int = SEED, **how) -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted), copies, source."""
    keys = cut_lineage(_keyed(docs, doc_id, text, source, seed).select("__id", "__source", "__size", "__h"))
    return copies(keys, keys, seed=seed, **how).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__copies").alias("copies"), F.col("__source").alias("source"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, seed: int = SEED, **how) -> DataFrame:
    """The rows of the mix: every row of *docs* as often as it is taken, all columns as they were."""
    rows = _keyed(docs, doc_id, text, source, seed)
    keys = cut_lineage(rows.select("__id", "__source", "__size", "__h"))
    out = copies(rows, keys, seed=seed, **how)
    repeated = in_few_parts(out, keys.count(), TEXT_ROWS).where("__copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select("__row.*")
