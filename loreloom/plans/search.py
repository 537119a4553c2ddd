"""Search over vectors and texts: every vector or benchmark text asks the whole point table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.functions.encode import dense_encoder
from loreloom.operators import postings as pt, qna_chunks as qna, ranking, retrieval as rt
from loreloom.plans import tables as tb
from loreloom.plans.chunking import SEGMENTS
from loreloom.plans.registry import query, table, texts
from loreloom.session import cut_lineage, spread

RANKED = "row_number() OVER (PARTITION BY {by} ORDER BY score DESC, id) AS rank"


def lexical_points(spark, d):
    return tb.documents_as_points(spark, d).withColumn("tokens", rt.words("content"))


def neighbours(spark, d, k=10, **options):
    """Nearest other vectors of every vector."""
    points = spread(table(spark, d, "embeddings")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return rt.topk(points, tb.vector_queries(spark, d), k, skip_self=True, **options)


@query("RET-1 RET-2", tb.with_views(tb.PAIRS) + f"SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, {RANKED.format(by='qid')} FROM pairs) WHERE rank <= 10")
def dense_neighbours(spark, d):
    return neighbours(spark, d).withColumn("score", F.round("score", 6))


@query("RET-3", tb.with_views(tb.PAIRS) + f"SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, {RANKED.format(by='qid')} FROM pairs WHERE score >= 0.3) WHERE rank <= 10")
def dense_above_minimum(spark, d):
    return neighbours(spark, d, min_score=0.3).withColumn("score", F.round("score", 6))


@query("RET-1", tb.with_views(tb.PAIRS) + f"SELECT qid, id, rank FROM (SELECT *, {RANKED.format(by='qid')} FROM pairs) WHERE rank <= 5")
def dense_neighbours_by_grid(spark, d):
    """The way beyond the broadcast bound: points in rings around pivots, queries sent to those that can matter."""
    return neighbours(spark, d, 5, max_broadcast=200, points_per_cell=300).select("qid", "id", "rank")


@query("RET-1", tb.with_views(tb.PAIRS) + f"SELECT qid, id, rank FROM (SELECT *, {RANKED.format(by='qid')} FROM pairs) WHERE rank <= 5")
def dense_neighbours_seeded(spark, d):
    return neighbours(spark, d, 5, seed_fraction=0.2).select("qid", "id", "rank")


def _filtered_queries(spark, d):
    """A query allows its own label; label 0 stands for 'other' and label 1 for 'any'."""
    label = F.col("label").cast("string")
    named = F.when(label == "1", F.lit(None)).when(label == "0", F.lit("other")).otherwise(label)
    return tb.vector_queries(spark, d).withColumn("allow_family", rt.allowed_competitions(named))


@query("RET-4 RET-5", tb.with_views(tb.PAIRS) + f"""
SELECT qid, id, rank FROM (SELECT *, {RANKED.format(by='qid')} FROM pairs
  WHERE q_label = 1 OR (q_label = 0 AND label = 0) OR (q_label > 1 AND label IN (q_label, 0))) WHERE rank <= 5""")
def filtered_neighbours(spark, d):
    family = F.when(F.col("label") == 0, "other").otherwise(F.col("label").cast("string"))
    points = spread(table(spark, d, "embeddings")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), family.alias("family"))
    return rt.topk(points, _filtered_queries(spark, d), 5, filters=["family"], skip_self=True).select("qid", "id", "rank")


MATCHED = tb.with_views(tb.DOCUMENTS_AS_POINTS, tb.LEXICAL) + "SELECT qid, id FROM matched"


def _match_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), tx.match_tokens("text").alias("match"))


@query("RET-6", MATCHED)
def text_matches(spark, d):
    return rt.text_match(lexical_points(spark, d), _match_queries(spark, d))


@query("RET-6", r"""
WITH held AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}')) AS term FROM documents),
asked AS (SELECT doc_id AS qid, list_distinct(regexp_extract_all(lower(array_to_string(regexp_extract_all(text, '\S+')[1:3], ' ')), '[\p{L}\p{N}]{2,}')) AS m FROM documents),
terms AS (SELECT qid, len(m) AS n, unnest(m) AS term FROM asked)
SELECT qid, id FROM terms JOIN held USING (term) GROUP BY qid, id, n HAVING count(*) = n""")
def text_matches_of_openings(spark, d):
    """The first three words of every document ask all documents; more queries than a task is sent at once."""
    p = tb.document_texts(spark, d).withColumn("tokens", rt.words("content"))
    words = F.regexp_extract_all("text", F.lit(r"(\S+)"))
    openings = texts(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("qid"), F.array_join(F.slice(words, 1, 3), " ").alias("opening"))
    q = openings.select("qid", tx.match_tokens("opening").alias("match"))
    return rt.text_match(p, q, max_broadcast=100)


@query("EMB-2", r"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}')) AS term FROM documents) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT doc_id, term, round((1 + ln(tf)) * ln(1.0 + (SELECT count(*) FROM documents) / df), 6) AS weight FROM t JOIN f USING (term)""")
def lexical_weights(spark, d):
    w = rt.lexical_weights(texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return w.withColumn("weight", F.round("weight", 6))


SPARSE_BEST = tb.with_views(tb.DOCUMENTS_AS_POINTS, tb.LEXICAL) + f"SELECT qid, id, round(score, 5) AS score, rank FROM (SELECT *, {RANKED.format(by='qid')} FROM (SELECT qid, id, round(score, 9) AS score FROM sparse)) WHERE rank <= 10"


@query("RET-7", SPARSE_BEST)
def sparse_search(spark, d):
    p = lexical_points(spark, d)
    return rt.topk(p, tb.text_queries(spark, d, p), 10, arm="sparse").withColumn("score", F.round("score", 5))


@query("RET-7", SPARSE_BEST)
def sparse_search_by_postings(spark, d):
    """The same result, reading only postings that can reach a query's floor."""
    p = tb.document_texts(spark, d).withColumn("tokens", rt.words("content"))
    postings, vectors = pt.prepared(p)
    queries = tb.text_queries(spark, d, p).select("qid", "terms", "weights").where(F.col("terms").isNotNull()).dropDuplicates(["qid"])
    return pt.topk(postings, vectors, queries, 10).withColumn("score", F.round("score", 5))


ARMS = tb.with_views(tb.DOCUMENTS_AS_POINTS, tb.LEXICAL, f"""
dense_arm AS (SELECT * FROM (SELECT qid, id, score, {RANKED.format(by='qid')} FROM dense) WHERE rank <= 20),
text_arm AS (SELECT * FROM (SELECT qid, id, score, {RANKED.format(by='qid')} FROM dense WHERE (qid, id) IN (SELECT qid, id FROM matched)) WHERE rank <= 20),
sparse_arm AS (SELECT * FROM (SELECT qid, id, score, {RANKED.format(by='qid')} FROM (SELECT qid, id, round(score, 9) AS score FROM sparse)) WHERE rank <= 20)
""")
RRF = """, fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT qid, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT * FROM dense_arm UNION ALL SELECT * FROM {arm}) GROUP BY qid, id))
"""
DBSF = """, scaled AS (SELECT qid, id, CASE WHEN coalesce(stddev_samp(score) OVER w, 0) > 1e-12
    THEN (score - (avg(score) OVER w - 3 * stddev_samp(score) OVER w)) / (6 * stddev_samp(score) OVER w) ELSE 0.5 END AS s
  FROM (SELECT *, 1 AS arm FROM dense_arm UNION ALL SELECT *, 2 FROM {arm}) WINDOW w AS (PARTITION BY qid, arm)),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(sum(s), 9) AS score FROM scaled GROUP BY qid, id))
"""


def search_arms(spark, d):
    """Points, queries and their dense and sparse arms of depth 20, from one scan.

    The arms are small and used several times, so they are kept.
    """
    p = lexical_points(spark, d)
    q = tb.text_queries(spark, d, p)
    both = cut_lineage(rt.search(p, q, 20, {"dense": rt.DENSE, "sparse": rt.SPARSE}))
    dense, sparse = (both.where(F.col("arm") == name).drop("arm") for name in ("dense", "sparse"))
    return p, q, dense, sparse


@query("RET-10", ARMS + RRF.format(arm="sparse_arm") + "SELECT qid, id, round(score, 9) AS score, rank FROM fused WHERE rank <= 10")
def rank_fusion(spark, d):
    _, _, dense, sparse = search_arms(spark, d)
    return rt.reciprocal_rank_fusion(rt.arms(dense=dense, sparse=sparse), 10).withColumn("score", F.round("score", 9))


@query("RET-11", ARMS + DBSF.format(arm="sparse_arm") + "SELECT qid, id, round(score, 6) AS score, rank FROM fused WHERE rank <= 10")
def distribution_fusion(spark, d):
    _, _, dense, sparse = search_arms(spark, d)
    return rt.distribution_fusion(rt.arms(dense=dense, sparse=sparse), 10).withColumn("score", F.round("score", 6))


RESCORED = """SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
FROM (SELECT f.qid, f.id, coalesce(d.score, 0) AS score FROM fused f LEFT JOIN dense d USING (qid, id) WHERE f.rank <= 10)"""


@query("RET-8 RET-12", ARMS + RRF.format(arm="text_arm") + RESCORED)
def hybrid_text_search(spark, d):
    p = lexical_points(spark, d)
    return rt.hybrid_text(p, tb.text_queries(spark, d, p), 10).withColumn("score", F.round("score", 6))


@query("RET-9 RET-12", ARMS + RRF.format(arm="sparse_arm") + RESCORED)
def hybrid_sparse_search(spark, d):
    p, q, dense, sparse = search_arms(spark, d)
    fused = rt.reciprocal_rank_fusion(rt.arms(dense=dense, sparse=sparse), 10)
    return rt.rescore(fused, p, q).withColumn("score", F.round("score", 6))


FILTERED = tb.with_views(tb.DOCUMENTS_AS_POINTS, tb.LEXICAL, f"""
own AS (SELECT doc_id AS qid, lang FROM documents),
dense_arm AS (SELECT * FROM (SELECT qid, id, score, {RANKED.format(by='qid')} FROM dense JOIN own USING (qid) WHERE collection = lang) WHERE rank <= 20),
sparse_arm AS (SELECT * FROM (SELECT qid, id, score, {RANKED.format(by='qid')} FROM (SELECT s.qid, s.id, round(s.score, 9) AS score FROM sparse s JOIN points p USING (id) JOIN own o ON o.qid = s.qid WHERE p.collection = o.lang)) WHERE rank <= 20)
""")


@query("RET-9", FILTERED + DBSF.format(arm="sparse_arm") + RESCORED)
def hybrid_sparse_search_filtered(spark, d):
    """One call, with the collection of a query's own document as its filter and the other fusion."""
    p = lexical_points(spark, d)
    langs = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), rt.allowed_values(F.col("lang")).alias("allow_collection"))
    q = tb.text_queries(spark, d, p).join(langs, "qid")
    return rt.hybrid_sparse(p, q, 10, filters=["collection"], fusion=rt.distribution_fusion).withColumn("score", F.round("score", 6))


GROUPED = tb.with_views(tb.POINTS, """
scored AS (
  SELECT q.vec_id AS qid, p.*, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), p.vector) AS score
  FROM embeddings q JOIN points p ON p.id <> q.vec_id),
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY score DESC, id) AS depth FROM scored) WHERE depth <= 24)
""")


# A question's other wording is the vector beside it.
OTHER_WORDING = """
other_scored AS (
  SELECT q.vec_id AS qid, p.*, list_cosine_similarity(CAST(o.embedding AS DOUBLE[]), p.vector) AS score
  FROM embeddings q JOIN embeddings o ON o.vec_id = xor(q.vec_id, 1) JOIN points p ON p.id <> q.vec_id),
other_hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY score DESC, id) AS depth FROM other_scored) WHERE depth <= 24)
"""


def other_wording(spark, d):
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("vec_id").bitwiseXOR(F.lit(1)).alias("other"))
    other = table(spark, d, "embeddings").select(F.col("vec_id").alias("other"), F.col("embedding").alias("vector"))
    return own.join(other, "other").drop("other")


def collection_hits(spark, d, queries=None, content=True, **derived):
    """Candidates of every vector (or of other queries) in every collection, with their payload; texts only where *content*, and what is *derived* from them."""
    p = tb.points(spark, d, **derived)
    queries = tb.vector_queries(spark, d).drop("label") if queries is None else queries
    hits = rt.multi_collection(p, queries, 5, skip_self=True)
    hits = hits.withColumnRenamed("group", "collection").withColumnRenamed("rank", "depth")
    return hits.join(p.drop("vector", "collection", *([] if content else ["content"])), "id")


def with_content(spark, d, hits):
    """Hits with the text of their document."""
    return hits.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")


@query("RET-16", GROUPED + "SELECT qid, collection, id, round(score, 6) AS score, depth FROM hits")
def multi_collection_search(spark, d):
    return collection_hits(spark, d).select("qid", "collection", "id", F.round("score", 6).alias("score"), "depth")


# Signed hashing of words, as hashing_encoder() does it; {rows}: key, text.
ENCODED = r"""
hashed AS (SELECT key, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS slot, sum(CASE WHEN substr(h, 9, 1) >= '8' THEN 1 ELSE -1 END) AS v
  FROM (SELECT key, md5(unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0d]+'))) AS h FROM {rows}) GROUP BY ALL),
encoded AS (SELECT key, list(CAST(coalesce(v / norm, 0) AS FLOAT) ORDER BY slot) AS vector FROM (SELECT key, slot FROM {rows}, range(256) r(slot))
  LEFT JOIN hashed USING (key, slot) LEFT JOIN (SELECT key, nullif(sqrt(sum(v * v)), 0) AS norm FROM hashed GROUP BY key) USING (key) GROUP BY key)
"""


@query("EMB-1 UDF-1", "WITH docs AS (SELECT doc_id AS key, text FROM documents)," + ENCODED.format(rows="docs") + "SELECT key AS doc_id, vector FROM encoded")
def encoded_documents(spark, d):
    encode = dense_encoder()
    return texts(spark, d, "documents", "doc_id", "text").select("doc_id", encode("text").alias("vector"))


RANKED_CHUNKS = "WITH " + SEGMENTS + """,
texts AS (SELECT 'c' || doc_id || '_' || chunk_index AS key, text FROM exploded UNION ALL SELECT 'q' || item_id, text FROM benchmark),""" + ENCODED.format(rows="texts") + """,
vectors AS (SELECT key[1] AS kind, substr(key, 2) AS id, CAST(vector AS DOUBLE[]) AS v FROM encoded),
scored AS (SELECT CAST(q.id AS BIGINT) AS qid, c.id, round(list_cosine_similarity(q.v, c.v), 15) AS score FROM vectors q, vectors c WHERE q.kind = 'q' AND c.kind = 'c'),
hits AS (SELECT *, CAST(split_part(id, '_', 1) AS BIGINT) AS post_id, CAST(split_part(id, '_', 2) AS BIGINT) AS chunk_index
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS depth FROM scored) WHERE depth <= 28),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, post_id ORDER BY score DESC, id) AS p FROM hits) WHERE p <= 2)
SELECT qid, id, post_id, chunk_index, source AS source_key, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
FROM capped JOIN documents ON doc_id = post_id"""


@query("CHK-5 EMB-1 RET-1 RET-23", RANKED_CHUNKS)
def ranked_chunks(spark, d):
    """Documents -> chunks -> vectors -> best chunks of every benchmark text, at most two per document."""
    encode = dense_encoder()
    chunks = qna.chunk_documents(texts(spark, d, "documents", "doc_id", "text"), "text")
    points = chunks.select(F.concat_ws("_", "doc_id", "chunk_index").alias("id"), encode("text").alias("vector"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), encode("text").alias("vector"))
    # The id names the document, so the chunks need not be made again for their payload.
    part = F.split("id", "_")
    hits = rt.topk(points, queries, rt.candidate_depth(7)).withColumns(
        {"post_id": part[0].cast("bigint"), "chunk_index": part[1].cast("bigint")})
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), F.col("source").alias("source_key"))
    joined = hits.join(sources, "post_id").withColumn("chapter", F.lit("")).withColumn("section", F.col("post_id").cast("string"))
    return ranking.cap_repeats(ranking.together(joined)).select(
        "qid", "id", "post_id", "chunk_index", "source_key", F.round("score", 6).alias("score"), "rank")
