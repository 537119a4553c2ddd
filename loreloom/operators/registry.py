"""The registry of collections: competitions x document types of a year, groups, expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.functions import fixed_values as fixed
from loreloom.functions import text as tx


def competitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.COMPETITION_LABELS.items()), "competition string, competition_label string")


def document_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.DOCUMENT_TYPE_LABELS.items()), "document_type string, document_type_label string")


def collection_key(competition: Column, document_type: Column, year: str, prefix: str = "rules") -> Column:
    return F.concat_ws("-", F.lit(prefix), tx.slug(competition), tx.slug(document_type), F.lit(year))


def build(names: DataFrame, kinds: DataFrame, year: str, *, prefix: str = "rules", suffix: str = "v2") -> DataFrame:
    """One row per competition and document type.

    Both sides are name lists of a handful of rows; the types are carried as one array per name.
    """
    listed = kinds.agg(F.collect_list(F.struct("document_type", "document_type_label"))).scalar()
    rows = names.withColumn("__t", F.explode(listed)).select(
        F.col("competition").alias("competition_key"), "competition_label",
        F.col("__t.document_type").alias("document_type_key"), F.col("__t.document_type_label").alias("document_type_label"))
    key = collection_key(F.col("competition_key"), F.col("document_type_key"), year)
    named = collection_key(F.col("competition_key"), F.col("document_type_key"), year, prefix)
    label = F.concat(F.lit("규정 "), F.col("competition_label"), F.lit(" - "), F.col("document_type_label"), F.lit(f" ({year})"))
    text = F.concat(F.col("competition_label"), F.lit(" 종목 "), F.col("document_type_label"), F.lit(f" 문서 집합 ({year} 규정 기준)."))
    return rows.select(
        key.alias("key"), F.concat_ws("-", named, F.lit(suffix)).alias("collection"), "competition_key", "competition_label",
        "document_type_key", "document_type_label", label.alias("label"), text.alias("description"),
        F.lit("rules").alias("source_type"), F.lit(True).alias("supports_filters"), F.lit(year).alias("year"))


def with_groups(detail: DataFrame, groups: DataFrame | Sequence[tuple] = fixed.COLLECTION_GROUPS) -> DataFrame:
    """Detail collections and the groups above them: a table of key, collection, label and source_type, or such tuples."""
    rows = groups if isinstance(groups, DataFrame) else detail.sparkSession.createDataFrame(
        list(groups), "key string, collection string, label string, source_type string")
    return detail.unionByName(rows.withColumn("supports_filters", F.lit(False)), allowMissingColumns=True)


def public(registry: DataFrame) -> DataFrame:
    return registry.where(~F.col("supports_filters")).select("key", "label", "description", "source_type")


def resolve(registry: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Sorted distinct keys: all of them, or the requested ones; an unknown key is an error."""
    if requested is None:
        return registry.select("key").distinct().orderBy("key")
    wanted = requested.select("key").distinct()
    unknown = wanted.join(registry.select("key"), "key", "left_anti").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("key")).alias("keys")).first()
    if unknown["n"]:
        raise ValueError(f"{unknown['n']} unknown collections: {', '.join(unknown['keys'])}")
    return wanted.orderBy("key")


def active(registry: DataFrame, available: DataFrame) -> DataFrame:
    """Groups always, detail collections when they exist."""
    present = registry.join(available.select("collection").distinct(), "collection", "left_semi")
    return registry.where(~F.col("supports_filters")).unionByName(present.where("supports_filters").select(registry.columns))


def expand(registry: DataFrame, requested: DataFrame, available: DataFrame, *, group: str = "rules") -> DataFrame:
    """Requested keys; the rules group also brings its populated detail collections."""
    alive = active(registry, available).select("key", "supports_filters", "source_type")
    asked = requested.select("key").distinct()
    direct = alive.join(asked, "key", "left_semi").select("key")
    wants_group = asked.agg(F.max(F.col("key") == group)).scalar()
    members = alive.where(F.col("supports_filters") & (F.col("source_type") == "rules") & wants_group).select("key")
    return direct.unionByName(members).distinct()
