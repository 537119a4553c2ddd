"""Registered queries of the operators, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.llm import chat, exact_dedup, language_id, mixing, neighbours, ngram_join, packing, periodic_runs, piece_codec, prefix_trie, sharding, token_counts, toxicity
from loreloom.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, folder))


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_groups(documents(spark, folder))


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return neighbours.neighbours(vectors, F.col("vec_id") % 100 == 0, 10)


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, folder))


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rendered(spark.read.parquet(f"{folder}/conversations.parquet"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxic_scores(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.languages(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"), shared_openings=True)


def op12_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.round_trips(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.run_table(periodic_runs.with_planted_runs(documents(spark, folder))))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_sharding, op2_ngram_jaccard, op3_neighbours, op4_token_counts, op5_best_fit_packing, op6_mix_sources, op7_chat, op8_toxicity, op9_language_id, op10_exact_dedup,
                                                   op11_prefix_trie, op12_sentencepiece, op13_periodic_runs)}

ORACLES = {
    "op7_chat": """
        WITH turns AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        whole AS (
          SELECT conv_id, count(*) AS n_turns,
                 list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS said
          FROM turns GROUP BY conv_id),
        proper AS (
          SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS k FROM whole)),
        once AS (SELECT min(conv_id) AS conv_id, count(*) AS n_equal, any_value(n_turns) AS n_turns FROM whole
                 WHERE said NOT IN (SELECT said FROM proper) GROUP BY said)
        SELECT conv_id, floor(turn / 1024)::BIGINT AS part, any_value(n_turns) AS n_turns, any_value(n_equal) AS n_equal,
               string_agg('<|im_start|>' || coalesce(role, 'none') || chr(10) || text || '<|im_end|>' || chr(10), ''
                          ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS text
        FROM turns JOIN once USING (conv_id) GROUP BY conv_id, floor(turn / 1024)""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    # The checksum of an id is folded bit by bit; turns are compared by the SHA-256 of role and text.
    "op11_prefix_trie": r"""
        WITH turns AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS k
          FROM conversations WHERE conv_id IS NOT NULL),
        own AS (
          SELECT conv_id, list(struct_pack(said := sha256(length(role) || ':' || role || text), words := len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) ORDER BY k) AS talk,
                 xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
                       lambda i: [ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                     lambda a, b: CASE WHEN xor(a, b) % 2 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END), 4294967295) % 4 AS h
          FROM turns GROUP BY conv_id),
        rebuilt AS (
          SELECT c.conv_id, list_concat(coalesce(b.talk[1:c.h], []), c.talk[c.h + 1:]) AS talk
          FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
        begun AS (SELECT conv_id, talk, len(talk) AS n, unnest(range(0, len(talk) + 1)) AS depth FROM rebuilt),
        nodes AS (
          SELECT list_transform(talk[1:depth], lambda t: t.said) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(coalesce(talk[depth].words, 0)) AS words,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
          FROM begun GROUP BY ALL),
        kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
        below AS (SELECT path[1:d] AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
                  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted) GROUP BY ALL)
        SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
        FROM counted c JOIN below USING (path) LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.path = c.path[1:c.depth - 1]""",
}
