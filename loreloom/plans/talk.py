"""Conversation turns prepared for search."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreloom.operators import conversation as cv
from loreloom.functions import text as tx
from loreloom.plans.registry import query, table

EN_FOLLOW_UP = r"(?i)\b(and|the)\b"


@query("CNV-1", """
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3""")
def recent_messages(spark, d):
    return cv.recent_messages(table(spark, d, "conversations"), keys=["conv_id"], order=["turn"], n=3).select(
        "conv_id", "turn", "role", "position")


@query("CNV-2 CNV-3", r"""
SELECT conv_id, turn, turn > 0 AND (regexp_matches(text, '(?i)\b(and|the)\b') OR length(trim(text, E' \n')) < 18) AS follow_up,
  length(trim(regexp_replace(text, '\s+', ' ', 'g'))) < 4 AS unclear FROM conversations WHERE role = 'user'""")
def question_kinds(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").where(F.col("role") == "user").select(
        "conv_id", "turn", cv.is_follow_up(t, F.col("turn") > 0, EN_FOLLOW_UP).alias("follow_up"), cv.needs_clarification(t).alias("unclear"))


@query("CNV-4", r"""
WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
p AS (SELECT a.conv_id, a.turn, a.text, arg_max(b.text, b.turn) AS previous FROM q a LEFT JOIN q b
      ON b.conv_id = a.conv_id AND b.turn < a.turn AND trim(b.text, E' \n') <> '' AND trim(b.text, E' \n') <> trim(a.text, E' \n') GROUP BY ALL)
SELECT conv_id, turn, nfc_normalize(trim(regexp_replace(substr(trim(previous, E' \n'), 1, 240) || ' ' || text, '\s+', ' ', 'g'))) AS contextual FROM p""")
def contextual_queries(spark, d):
    c = table(spark, d, "conversations")
    linked = cv.with_previous_questions(c, key="conv_id", position="turn", block=3).where(F.col("role") == "user")
    return linked.select("conv_id", "turn", cv.contextual_query(F.col("previous"), F.col("text")).alias("contextual"))


@query("CNV-7", r"""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN t WHEN length(s) > 500 THEN substr(s, 1, 500) || '...' ELSE s END AS text FROM (
  SELECT conv_id, turn, role, t, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'https?://\S+', '', 'g'), '\[문서\s*\d+\]', '', 'g'), '\(유사도:\s*[\d.]+%?\)', '', 'g'), '\n{3,}', E'\n\n', 'g'), E' \n') AS s
  FROM (SELECT conv_id, turn, role, text || ' [문서 ' || CAST(turn AS VARCHAR) || '] (유사도: 81.5%) see https://x.example/' || role AS t FROM conversations))""")
def compressed_history(spark, d):
    noisy = F.concat("text", F.lit(" [문서 "), "turn", F.lit("] (유사도: 81.5%) see https://x.example/"), "role")
    return table(spark, d, "conversations").select("conv_id", "turn", cv.compress_message(F.col("role"), noisy).alias("text"))


@query("CNV-8", r"""
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '사용자: ' || text WHEN role = 'assistant' AND length(text) > 500 THEN '어시스턴트: ' || substr(text, 1, 500) || '...' ELSE '어시스턴트: ' || text END, E'\n' ORDER BY turn) AS transcript
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 GROUP BY conv_id""")
def transcripts(spark, d):
    return cv.transcript(table(spark, d, "conversations"), key="conv_id", position="turn")
