"""Saved board pages -> posts: parsing, incremental selection, replies, answers, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import fixed_values as fixed
from loreloom.functions import text as tx
from loreloom.operators import ordered


def new_by_key(held: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not held yet."""
    return incoming.join(held.select(*keys).distinct(), keys, "left_anti")


def accumulate(held: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Held rows and the incoming rows with new keys (repeats inside *incoming* stay)."""
    return held.unionByName(new_by_key(held, incoming, keys))


def merge_posts(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Union by key: old rows win over new ones, the first new row wins inside the batch."""
    fresh = ordered.first_per_key(new_by_key(old, new, keys), keys, order)
    return old.unionByName(fresh.select(*old.columns))


def attach_parent(rows: DataFrame, *, board: str = "board", position: str = "pos", number: str = "number",
                  is_reply: str = "is_reply", out: str = "parent", block: int = ordered.BLOCK) -> DataFrame:
    """Number of the nearest question above each row of a board; questions get their own."""
    question = F.when(~F.col(is_reply), F.col(number))
    return ordered.fill_forward(rows, [board], position, question, out, block=block)


def new_questions(rows: DataFrame, stored: DataFrame, *, board: str = "board", position: str = "pos",
                  number: str = "number", is_reply: str = "is_reply", key: str = "id") -> DataFrame:
    """Rows of questions whose key is not stored, with the replies that follow them."""
    linked = attach_parent(rows, board=board, position=position, number=number, is_reply=is_reply)
    wanted = (
        linked.where(~F.col(is_reply)).join(stored.select(key).distinct(), key, "left_anti")
        .select(board, F.col(number).alias("parent")).distinct()
    )
    return linked.join(wanted, [board, "parent"], "left_semi")


def split_details(rows: DataFrame, details: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows joined with their detail, keys without a detail)."""
    return rows.join(details, keys, "inner"), rows.join(details.select(*keys).distinct(), keys, "left_anti")


def answer_body(body: Column | str, separator: str = fixed.ORIGINAL_TEXT_SEPARATOR) -> Column:
    """The part of a reply above the quoted original, cleaned."""
    col = F.col(body) if isinstance(body, str) else body
    return tx.clean_text(F.split(col, separator, 2)[0])


def answers_of(replies: DataFrame, *, keys: list[str], position: str = "pos", body: str = "body",
               url: Column | str = "url", block: int = ordered.BLOCK) -> DataFrame:
    """One row per non-empty answer, numbered in list order inside its question."""
    cleaned = (
        replies.select(*keys, position, answer_body(body).alias("answer_body"),
                       (F.col(url) if isinstance(url, str) else url).alias("answer_url"))
        .where(F.col("answer_body") != "")
    )
    return ordered.row_numbers(cleaned, keys, position, "answer_pos", block=block)


def nest_answers(answers: DataFrame, keys: list[str], *, page: int = 1_000) -> DataFrame:
    """Answers as arrays of at most *page* entries: (keys, part, answers), part 0 for nearly all."""
    paged = answers.withColumn("part", F.floor(F.col("answer_pos") / page).cast("bigint"))
    entry = F.struct("answer_pos", F.col("answer_body").alias("body"), F.col("answer_url").alias("url"))
    return (
        paged.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(entry)).alias("answers"))
        .withColumn("answers", F.transform("answers", lambda a: F.struct(a["body"].alias("body"), a["url"].alias("url"))))
    )


def crawl_summary(rows: DataFrame, *, failed: Column, at: Column) -> DataFrame:
    """One row: time, rows that succeeded, rows that failed."""
    return rows.agg(
        F.first(at).alias("crawled_at"),
        F.count_if(~failed).alias("total_count"),
        F.count_if(failed).alias("failed_count"),
    )


def failed_keys(rows: DataFrame, *, failed: Column, key: str) -> DataFrame:
    """Keys of the failed rows, as rows: their number is not bounded."""
    return rows.where(failed).select(F.col(key).alias("failed_id"))


def dedupe_manifest(items: DataFrame, year: str, *, order: list[Column], key: str = "source_key",
                    text: Column | None = None) -> DataFrame:
    """Items that name the target year, first per source key."""
    named = F.concat_ws(" ", "title", "source_filename", "date") if text is None else text
    return ordered.first_per_key(items.where(tx.is_target_year(named, year)), [key], order)
