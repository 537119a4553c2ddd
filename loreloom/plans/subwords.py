"""Counts, windows and chunks of documents by the pieces of a public vocabulary, beside a Viterbi search in SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from loreloom.functions import subword, text as tx
from loreloom.operators import qna_chunks as qna
from loreloom.plans.chunking import PACKING
from loreloom.plans.registry import query, texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JOINED = "replace(array_to_string({0}, chr(8288)), chr(8288) || '▁', ' ▁')"


def vocabulary_sql(model_file: str) -> str:
    """Pieces in the order of their ranks, as a list in SQL."""
    with open(model_file, "rb") as f:
        costs = subword.piece_costs(f.read())
    listed = chr(30).join(sorted(costs, key=costs.get)).replace("'", "''")
    return f"unnest(string_split('{listed}', chr(30)))"


# Best paths of all distinct words: for every end the cheapest start, folded from left to right; of equal costs the
# earlier start. The path is carried as text. Then the words are put back between their white space.
MARKED = r"""WITH vocabulary AS (SELECT piece, CAST(round(ln(rank * ln(n)) * 1000000) AS BIGINT) AS cost FROM (SELECT piece, row_number() OVER () AS rank, count(*) OVER () AS n FROM (SELECT {vocabulary} AS piece))),
runs AS (SELECT doc_id, generate_subscripts(r, 1) AS i, unnest(r) AS run FROM (SELECT doc_id, regexp_extract_all(translate(text, '▁' || chr(8288), '  '), '\S+|\s+') AS r FROM documents)),
words AS (SELECT DISTINCT run AS word, '▁' || run AS w FROM runs WHERE regexp_matches(run, '\S')),
parts AS (SELECT word, w, b, unnest(range(b + 1, least(length(w), b + 16) + 1)) AS e FROM (SELECT word, w, unnest(range(0, length(w))) AS b FROM words)),
edges AS (
  SELECT word, e, list({{c: c, b: b, t: t}}) AS l FROM (
    SELECT word, b, e, cost AS c, substr(w, b + 1, e - b) AS t FROM parts JOIN vocabulary ON piece = substr(w, b + 1, e - b)
    UNION ALL SELECT word, b, e, (SELECT max(cost) FROM vocabulary) + 10000000, substr(w, b + 1, 1) FROM parts WHERE e = b + 1) GROUP BY word, e),
paths AS (
  SELECT word, list_reduce(list_prepend([{{c: CAST(0 AS BIGINT), b: CAST(0 AS BIGINT), t: ''}}], list(l ORDER BY e)),
    lambda s, l: list_append(s, list_min(list_transform(l, lambda x: {{c: s[x.b + 1].c + x.c, b: x.b, t: s[x.b + 1].t || CASE WHEN x.b > 0 THEN chr(8288) ELSE '' END || x.t}}))))[-1].t AS marked
  FROM edges GROUP BY word),
docs AS (SELECT doc_id, coalesce(string_agg(coalesce(marked, run), '' ORDER BY i), '') AS text FROM documents LEFT JOIN runs USING (doc_id) LEFT JOIN paths ON word = run GROUP BY doc_id)
"""
MARKED = MARKED.format(vocabulary=vocabulary_sql(MODEL))
COUNT = r"CAST(len(regexp_extract_all(text, '[^\s\x{2060}]+')) AS BIGINT)"
WITHOUT_MARKS = "translate({0}, '▁' || chr(8288), '')"


def _packing() -> str:
    """The SQL of the packing with tokens in place of words."""
    sql = PACKING.replace(r"'\S+'", r"'[^\s\x{{2060}}]+'")
    for cut in ("t[i + 1:i + {size}]", r"regexp_extract_all(a.cur, '[^\s\x{{2060}}]+')[-{overlap}:]"):
        sql = sql.replace(f"array_to_string({cut}, ' ')", JOINED.format(cut))
    return sql.format(keys="doc_id", docs="docs", size=384, overlap=75, least=384)


def _marked(spark, d):
    pieces = subword.pieces_of(spark, MODEL)
    return pieces, texts(spark, d, "documents", "doc_id", "text").withColumn("text", pieces.mark("text"))


@query("CHK-1 UDF-2", MARKED + f"SELECT doc_id, {COUNT} AS tokens FROM docs")
def subword_counts(spark, d):
    _, docs = _marked(spark, d)
    return docs.select("doc_id", tx.token_count("text", subword.MARKED).alias("tokens"))


@query("CHK-2 UDF-2", MARKED + rf"""
SELECT doc_id, CAST(i AS BIGINT) // 309 AS i, {WITHOUT_MARKS.format(JOINED.format('t[i + 1:i + 384]'))} AS text FROM (
  SELECT doc_id, t, unnest(range(0, greatest(len(t) - 75, 1), 309)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\s\x{{2060}}]+') AS t FROM docs) WHERE len(t) > 0)""")
def subword_windows(spark, d):
    pieces, docs = _marked(spark, d)
    windows = docs.select("doc_id", F.posexplode(tx.token_windows(F.col("text"), 384, 309, tokenizer=pieces.tokenizer)).alias("i", "text"))
    return windows.select("doc_id", F.col("i").cast("bigint").alias("i"), pieces.unmark(F.col("text")).alias("text"))


@query("CHK-3 CHK-4 CHK-5 UDF-2", MARKED + "," + _packing() + f"""
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, {COUNT} AS n_tokens, {WITHOUT_MARKS.format('text')} AS text FROM exploded""")
def subword_chunks(spark, d):
    pieces, docs = _marked(spark, d)
    chunks = qna.chunk_documents(docs, "text", tokenizer=pieces.tokenizer)
    return chunks.withColumn("n_tokens", tx.token_count("text", pieces.tokenizer)).withColumn("text", pieces.unmark(F.col("text")))
