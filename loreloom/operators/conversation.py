"""Conversation-aware query preparation over a table of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions import classify as cl
from loreloom.functions import fixed_values as fixed
from loreloom.functions import text as tx
from loreloom.operators import ordered

RECENT = 10
TRANSCRIPT = 6
SHORT_QUERY = 18
MIN_QUESTION = 4
CONTEXT_CHARS = 240
ANSWER_CHARS = 500


def recent_messages(turns: DataFrame, *, keys: list[str], order: list[str], n: int = RECENT) -> DataFrame:
    """Last *n* messages of every session; ``position`` counts them oldest first."""
    newest = ordered.top_per_key(turns, keys, [F.desc(c) for c in order], n, "__r")
    w = Window.partitionBy(*keys).orderBy(F.desc("__r"))
    return newest.withColumn("position", F.row_number().over(w).cast("bigint")).drop("__r")


def needs_clarification(query: Column) -> Column:
    q = tx.squash(query)
    return (F.length(q) < MIN_QUESTION) | q.rlike(fixed.INCOMPLETE_PATTERN)


def is_follow_up(query: Column, has_history: Column, pattern: str = fixed.FOLLOW_UP_PATTERN) -> Column:
    q = tx.strip(query)
    return has_history & (q.rlike(pattern) | (F.length(q) < SHORT_QUERY))


def with_previous_questions(turns: DataFrame, *, key: str, position: str, role: str = "role", text: str = "text",
                            block: int = ordered.BLOCK) -> DataFrame:
    """Adds ``previous``: the last non-empty user message above that differs from this one.

    Runs of one repeated question share the question before the run, so two scans answer it: the
    start of each run of equal questions, then the question above that start.
    """
    questions = turns.where((F.col(role) == "user") & (tx.strip(tx.or_empty(text)) != "")).select(
        key, position, tx.strip(text).alias("__q"))
    digest = F.sha2("__q", 256)
    above = ordered.row_numbers(questions, [key], position, "__n", block=block)
    before = above.select(key, (F.col("__n") + 1).alias("__n"), F.col("__q").alias("__before"))
    linked = above.join(before, [key, "__n"], "left")
    starts = F.when(~F.coalesce(F.col("__before").eqNullSafe(F.col("__q")), F.lit(False)), F.struct(
        F.coalesce("__before", F.lit("")).alias("q")))
    runs = ordered.fill_forward(linked, [key], position, starts, "__start", block=block)
    found = runs.select(key, position, tx.non_empty(F.col("__start.q")).alias("__same"), F.col("__q"))
    # A row that is no question itself looks at the last question above it.
    filled = ordered.fill_forward(turns.join(found, [key, position], "left"), [key], position,
                                  F.when(F.col("__q").isNotNull(), F.struct("__q", "__same")), "__last", block=block)
    mine = tx.strip(tx.or_empty(text))
    own = F.col("__last.__q") == mine
    return filled.withColumn("previous", F.when(own, F.col("__last.__same")).otherwise(F.col("__last.__q"))).drop(
        "__q", "__same", "__last")


def contextual_query(previous: Column, query: Column) -> Column:
    """Second search wording: the previous question (240 characters) and this one, normalized."""
    return F.when(previous.isNotNull(), cl.normalize_query(F.concat(tx.cut(previous, CONTEXT_CHARS), F.lit(" "), query)))


def compress_message(role: Column, text: Column) -> Column:
    """Assistant texts lose links, document marks and similarity notes, and are cut to 500 characters."""
    short = tx.strip(tx.rewrite(text, [
        (r"(?U)https?://\S+", ""), (r"(?U)\[문서\s*\d+\]", ""), (r"(?U)\(유사도:\s*[\d.]+%?\)", ""), (r"\n{3,}", "\n\n")]))
    return F.when(role == "user", text).otherwise(tx.ellipsis(short, ANSWER_CHARS))


def transcript(turns: DataFrame, *, key: str, position: str, role: str = "role", text: str = "text",
               n: int = TRANSCRIPT) -> DataFrame:
    """Last *n* messages of a conversation as labelled lines."""
    last = ordered.top_per_key(turns, [key], [F.desc(position)], n, "__r")
    label = F.when(F.col(role) == "user", "사용자").otherwise("어시스턴트")
    body = F.when(F.col(role) == "assistant", tx.ellipsis(F.col(text), ANSWER_CHARS)).otherwise(F.col(text))
    line = F.concat(label, F.lit(": "), body)
    grouped = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(position, line.alias("line")))).alias("l"))
    return grouped.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))
