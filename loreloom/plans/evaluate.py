"""Retrieval quality on the given vectors (label = gold class) and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreloom.operators import evaluation as ev, retrieval as rt
from loreloom.plans import tables as tb
from loreloom.plans.registry import query, table, texts
from loreloom.plans.search import ARMS, DBSF, RRF, neighbours, search_arms
from loreloom.session import cut_lineage, spread



CODES = r"""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b(?:[A-Za-z0-9]*\d[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*|[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*\d[A-Za-z0-9]*)\b')) AS token FROM documents),
t AS (SELECT DISTINCT token FROM w WHERE length(token) >= 5)
SELECT token, min(doc_id) AS key FROM t JOIN documents ON contains(text, token) GROUP BY token HAVING count(*) = 1"""
# Codes as a pattern without look-around, which both engines know.
MIXED = r"(\b(?:[A-Za-z0-9]*\d[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*|[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*\d[A-Za-z0-9]*)\b)"


@query("EVL-1", CODES)
def unique_codes(spark, d):
    return ev.unique_codes(texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text", pattern=MIXED)


@query("EVL-1", f"""
SELECT token AS query, key AS gold FROM (SELECT token, key, row_number() OVER (PARTITION BY key ORDER BY strpos(text, token), token) AS r
FROM ({CODES}) JOIN documents ON doc_id = key) WHERE r = 1""")
def lexical_queries(spark, d):
    return ev.lexical_queries(texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text", cap=None, pattern=MIXED)


@query("EVL-2", r"""
SELECT query, gold FROM (SELECT doc_id AS gold, trim(regexp_extract(text, '(?m)^(.{25,110})', 1)) AS query, substr(source, 1, 8) AS t FROM documents)
WHERE query <> '' AND NOT contains(query, t)""")
def semantic_queries(spark, d):
    return ev.semantic_queries(table(spark, d, "documents"), "doc_id", "text", "source", cap=None, pattern=r"(?m)^(.{25,110})")


@query("EVL-3", r"""
WITH once AS (SELECT lang, source, arg_min(text, doc_id) AS text FROM documents GROUP BY lang, source),
q AS (SELECT lang, source, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean FROM once),
f AS (SELECT *, regexp_extract(clean, '^(.*?[.!?])\s', 1) AS first FROM q)
SELECT '제' || lang || '조 ' || source AS query, 'title' AS task, source AS section FROM f
UNION ALL SELECT CASE WHEN first = '' THEN CASE WHEN length(clean) >= 20 THEN clean ELSE substr(clean, 1, 120) END WHEN length(first) >= 20 THEN first ELSE substr(clean, 1, 120) END, 'body', source FROM f""")
def section_queries(spark, d):
    chunks = table(spark, d, "documents").select(
        F.col("lang").alias("chapter_num"), F.col("source").alias("section"), F.lit("").alias("section_num"), F.lit("").alias("chapter"),
        F.lit(0).alias("chunk_index"), "text", "doc_id")
    return ev.section_queries(chunks, order=[F.col("doc_id")]).select("query", "task", "section")


TOP = tb.with_views(tb.PAIRS, "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM pairs) WHERE rank <= 10)")


@query("EVL-4", TOP + """
SELECT t.qid, t.id, t.label = t.q_label OR contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), 'the') AS relevant
FROM top t JOIN documents d ON d.doc_id = t.id""")
def relevance(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("label").cast("string").alias("q_section"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("section"))
    h = neighbours(spark, d).join(docs, "id").join(e, "id").join(q, "qid").withColumns({
        "chapter_num": F.lit(1), "q_chapter_num": F.lit("1"), "section_num": F.lit(None).cast("string"), "q_section_num": F.lit(""), "q_anchor": F.lit("The ")})
    return h.select("qid", "id", ev.is_relevant(h).alias("relevant"))


def _labelled_hits(spark, d):
    """Queries with their class, and their ten nearest with theirs."""
    q = tb.vector_queries(spark, d).select("qid", F.col("label").alias("gold"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return q, neighbours(spark, d).join(e, "id").join(q, "qid")


def _quality(q, h, k):
    return ev.metrics(q.withColumnRenamed("gold", "task"), h, F.col("label") == F.col("gold"), by=["task"], k=k)


def _vector_quality(spark, d, k=10):
    return _quality(*_labelled_hits(spark, d), k)


QUALITY = """, quality_{k} AS (SELECT q.label AS task, count(*) AS n, avg(CASE WHEN r = 1 THEN 1.0 ELSE 0 END) AS recall_1,
  avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END) AS recall_5, avg(coalesce(1.0 / r, 0)) AS mrr
  FROM embeddings q LEFT JOIN (SELECT qid, min(rank) AS r FROM top WHERE label = q_label AND rank <= {k} GROUP BY qid) ON qid = q.vec_id GROUP BY q.label)
"""


@query("EVL-5", TOP + QUALITY.format(k=10) + "SELECT task, n, round(recall_1, 6) AS recall_1, round(recall_5, 6) AS recall_5, round(mrr, 6) AS mrr FROM quality_10")
def search_quality(spark, d):
    return _vector_quality(spark, d).select("task", "n", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "mrr")])


@query("EVL-6", TOP + QUALITY.format(k=10) + QUALITY.format(k=3) + """
SELECT task, round(a.recall_1 - b.recall_1, 6) AS d_recall_1, round(a.recall_5 - b.recall_5, 6) AS d_recall_5, round(a.mrr - b.mrr, 6) AS d_mrr
FROM quality_10 a JOIN quality_3 b USING (task)""")
def quality_change(spark, d):
    # The three nearest are the head of the ten nearest: one search serves both runs.
    q, h = _labelled_hits(spark, d)
    h = cut_lineage(h)
    change = ev.compare(_quality(q, h, 3), _quality(q, h, 10), ["task"])
    return change.select("task", *[F.round(c, 6).alias(c) for c in ("d_recall_1", "d_recall_5", "d_mrr")])


RUNS = tb.with_views(tb.PAIRS, """
a AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM pairs) WHERE rank <= 7),
b AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM pairs WHERE label = q_label AND score >= 0.25) WHERE rank <= 7),
per AS (SELECT v.vec_id AS qid, CAST(coalesce(c, 0) AS BIGINT) AS common, coalesce(c, 0) / 7.0 AS overlap, n IS NULL AS empty FROM embeddings v
  LEFT JOIN (SELECT qid, count(*) AS c FROM a JOIN b USING (qid, id) GROUP BY qid) x ON x.qid = v.vec_id
  LEFT JOIN (SELECT qid, count(*) AS n FROM b GROUP BY qid) y ON y.qid = v.vec_id)""")


def _overlap(spark, d):
    same = tb.vector_queries(spark, d).withColumn("allow_label", F.array(F.col("label")))
    points = spread(table(spark, d, "embeddings")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    run = rt.topk(points, same, 7, filters=["label"], skip_self=True, min_score=0.25)
    return ev.overlap_per_query(tb.vector_queries(spark, d), neighbours(spark, d, 7), run, 7)


@query("EVL-7", RUNS + "SELECT round(avg(overlap), 6) AS overlap, CAST(count(*) FILTER (empty) AS BIGINT) AS empty, count(*) AS queries FROM per")
def run_overlap(spark, d):
    return ev.overlap_summary(_overlap(spark, d)).withColumn("overlap", F.round("overlap", 6))


@query("EVL-8", RUNS + "SELECT qid, common, empty FROM per ORDER BY common, qid LIMIT 3")
def divergent_queries(spark, d):
    return ev.most_divergent(_overlap(spark, d)).select("qid", "common", "empty")


@query("EVL-9", ARMS + RRF.format(arm="sparse_arm") + DBSF.format(arm="sparse_arm").replace("fused AS", "blended AS") + """
, modes AS (SELECT qid, id, rank, 'dense' AS mode FROM dense_arm UNION ALL SELECT qid, id, rank, 'sparse' FROM sparse_arm
  UNION ALL SELECT qid, id, rank, 'rrf' FROM fused UNION ALL SELECT qid, id, rank, 'dbsf' FROM blended),
names AS (SELECT * FROM (VALUES ('dense'), ('sparse'), ('rrf'), ('dbsf')) v(mode)),
firsts AS (SELECT mode, qid, min(rank) AS r FROM modes JOIN points p USING (id) JOIN embeddings q ON q.vec_id = qid WHERE p.label = q.label AND rank <= 10 AND p.id <> qid GROUP BY mode, qid)
SELECT mode, count(*) AS n, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr
FROM names JOIN bench ON true LEFT JOIN firsts USING (mode, qid) GROUP BY mode""")
def mode_grid(spark, d):
    p, q, dense, sparse = search_arms(spark, d)
    both = rt.arms(dense=dense, sparse=sparse)
    modes = {"dense": dense, "sparse": sparse, "rrf": rt.reciprocal_rank_fusion(both, 20), "dbsf": rt.distribution_fusion(both, 20)}
    labels = p.select("id", "label")
    gold = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("label").alias("gold"))
    asked = q.select("qid").join(gold, "qid")
    grid = ev.mode_grid(asked, modes, lambda h: h.join(labels, "id").join(gold, "qid"),
                        (F.col("label") == F.col("gold")) & (F.col("id") != F.col("qid")))
    return grid.select("mode", "n", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "mrr")])
