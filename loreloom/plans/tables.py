"""The entities of the library on the given tables, once as DataFrames and once as SQL views.

users = customer, sessions = orders, messages = lineitem, ledger rows and turns = events,
payments = orders, points = embeddings with their documents, text queries = benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.operators import retrieval as rt
from loreloom.functions import text as tx
from loreloom.plans.registry import table
from loreloom.session import spread, written

# Moment the reports are made for; the data ends at 2024-01-30 (events) and 2001-11-04 (lineitem).
AS_OF = "2024-01-30 00:00:00"
AS_OF_SHIPPED = "2001-11-04 00:00:00"


def as_of(value: str = AS_OF) -> Column:
    return F.to_timestamp(F.lit(value))


def users(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    credits = F.greatest(F.lit(0), F.floor("c_acctbal")).cast("bigint")
    created = F.expr("timestamp'1998-01-01 00:00:00' + make_dt_interval(c_custkey, 0, 0, 0)")
    return c.select(
        F.col("c_custkey").alias("id"), F.concat(F.lower(F.translate("c_name", "#", "")), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("name"), credits.alias("credits"),
        F.floor(credits / 3).cast("bigint").alias("paid_credits"),
        created.alias("created_at"),
        F.when(F.col("c_mktsegment") == "FURNITURE", as_of()).alias("deleted_at"),
    )


USERS = """
users AS (
  SELECT c_custkey AS id, lower(replace(c_name, '#', '')) || '@example.com' AS email, c_name AS name,
         CAST(greatest(0, floor(c_acctbal)) AS BIGINT) AS credits,
         CAST(floor(greatest(0, floor(c_acctbal)) / 3) AS BIGINT) AS paid_credits,
         TIMESTAMP '1998-01-01 00:00:00' + to_days(CAST(c_custkey AS INTEGER)) AS created_at,
         CASE WHEN c_mktsegment = 'FURNITURE' THEN TIMESTAMP '2024-01-30 00:00:00' END AS deleted_at
  FROM customer)
"""


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("deleted_at"),
    )


SESSIONS = """
sessions AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS title, o_orderdate AS created_at,
         o_orderdate AS updated_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS deleted_at
  FROM orders)
"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines carry no input count, full-tax lines no model."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_partkey").alias("part"),
        F.when(F.col("l_linestatus") == "F", F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("bigint")).alias("input_tokens"),
        F.floor("l_extendedprice").cast("bigint").alias("output_tokens"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("thinking_tokens"),
        F.when(F.col("l_tax") < 0.075, F.concat(F.lit("model-"), F.round(F.col("l_tax") * 100).cast("int"))).alias("model"),
        F.col("l_shipdate").alias("created_at"),
    )


MESSAGES = """
messages AS (
  SELECT l_orderkey AS session_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part,
         CASE WHEN l_linestatus = 'F' THEN 'user' ELSE 'assistant' END AS role,
         CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) END AS input_tokens,
         CAST(floor(l_extendedprice) AS BIGINT) AS output_tokens,
         CAST(round(l_discount * 100) AS BIGINT) AS thinking_tokens,
         CASE WHEN l_tax < 0.075 THEN 'model-' || CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) END AS model,
         l_shipdate AS created_at
  FROM lineitem)
"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Price per million tokens by model, from the parts of each size up to 7."""
    p = table(spark, d, "part").groupBy("p_size").agg(F.round(F.avg("p_retailprice") / 100, 2).alias("p"))
    return p.where(F.col("p_size") <= 7).select(
        F.concat(F.lit("model-"), F.col("p_size")).alias("model"), F.col("p").alias("input"),
        (F.col("p") * 5).alias("output"), (F.col("p") * 5).alias("thinking"))


PRICES = """
prices AS (
  SELECT 'model-' || CAST(p_size AS VARCHAR) AS model, p AS input, p * 5 AS output, p * 5 AS thinking
  FROM (SELECT p_size, round(avg(p_retailprice) / 100, 2) AS p FROM part GROUP BY p_size) WHERE p_size <= 7)
"""


def ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    """Credit transactions: click = usage, error = refund, purchase, signup = refill, view = cancel."""
    e = table(spark, d, "events")
    whole = F.ceil("value").cast("bigint")
    kind = (F.when(F.col("event_type") == "click", "usage").when(F.col("event_type") == "error", "refund")
            .when(F.col("event_type") == "purchase", "purchase").when(F.col("event_type") == "signup", "monthly_refill")
            .otherwise("cancel"))
    k = F.get_json_object("props", "$.k")
    memo = F.when(kind == "refund", F.concat(F.lit("오류 환불 ("), k, F.lit(")"))).otherwise(
        F.concat(F.col("event_type"), F.lit(" "), k))
    return e.select(F.col("event_id").alias("id"), "user_id",
                    F.when(kind.isin("usage", "cancel"), -whole).otherwise(whole).alias("amount"),
                    kind.alias("type"), memo.alias("memo"), F.col("ts").alias("created_at"))


LEDGER = """
ledger AS (
  SELECT event_id AS id, user_id,
         CASE WHEN event_type IN ('click', 'view') THEN -CAST(ceil(value) AS BIGINT) ELSE CAST(ceil(value) AS BIGINT) END AS amount,
         CASE event_type WHEN 'click' THEN 'usage' WHEN 'error' THEN 'refund' WHEN 'purchase' THEN 'purchase'
                         WHEN 'signup' THEN 'monthly_refill' ELSE 'cancel' END AS type,
         CASE WHEN event_type = 'error' THEN '오류 환불 (' || json_extract_string(props, '$.k') || ')'
              ELSE event_type || ' ' || json_extract_string(props, '$.k') END AS memo,
         ts AS created_at
  FROM events)
"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Answer turns: view = success, click = fallback success, error = failed, purchase = partial, signup = pending."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    status = (F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "click", "success_fallback")
              .when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "partial_error")
              .otherwise("pending"))
    retrieval = F.when(k < 5, "failed").when(k < 20, "partial").otherwise("ok")
    return e.select(
        F.col("event_id").alias("id"), "user_id", status.alias("status"), retrieval.alias("retrieval_status"),
        F.when(status != "pending", F.floor("value").cast("bigint")).alias("first_token_ms"),
        F.when(status != "pending", F.floor(F.col("value") * 3).cast("bigint")).alias("total_ms"),
        F.col("ts").alias("created_at"))


TURNS = """
turns AS (
  SELECT event_id AS id, user_id,
         CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'success_fallback' WHEN 'error' THEN 'error'
                         WHEN 'purchase' THEN 'partial_error' ELSE 'pending' END AS status,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 5 THEN 'failed'
              WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 20 THEN 'partial' ELSE 'ok' END AS retrieval_status,
         CASE WHEN event_type <> 'signup' THEN CAST(floor(value) AS BIGINT) END AS first_token_ms,
         CASE WHEN event_type <> 'signup' THEN CAST(floor(value * 3) AS BIGINT) END AS total_ms,
         ts AS created_at
  FROM events)
"""


def payments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "pending").otherwise("cancelled")
    quantity = F.floor(F.col("o_totalprice") / 10000).cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").alias("user_id"), quantity.alias("quantity"), (quantity * 100).alias("amount"),
        F.lit(100).cast("bigint").alias("unit_price"),
        F.concat(F.lit("credits "), quantity).alias("goods_name"), status.alias("status"),
        F.lower("o_orderpriority").alias("method"), F.concat(F.lit("tid"), F.col("o_orderkey")).alias("tid"),
        F.when(status == "paid", quantity).alias("granted"), F.col("o_orderdate").alias("created_at"))


PAYMENTS = """
payments AS (
  SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS order_id, o_custkey AS user_id,
         CAST(floor(o_totalprice / 10000) AS BIGINT) AS quantity, CAST(floor(o_totalprice / 10000) AS BIGINT) * 100 AS amount,
         CAST(100 AS BIGINT) AS unit_price, 'credits ' || CAST(CAST(floor(o_totalprice / 10000) AS BIGINT) AS VARCHAR) AS goods_name,
         CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS status,
         lower(o_orderpriority) AS method, 'tid' || CAST(o_orderkey AS VARCHAR) AS tid,
         CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice / 10000) AS BIGINT) END AS granted, o_orderdate AS created_at
  FROM orders)
"""


def points(spark: SparkSession, d: str, **derived: Column) -> DataFrame:
    """Vectors with the payload of their document and its labels; ``lang`` is the collection.

    *derived* columns are made of ``text`` where documents are scanned, so who needs no more of a text does not move it.
    """
    e = spread(table(spark, d, "embeddings")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("collection"),
        F.col("source").alias("source_key"), "n_chars", *[c.alias(name) for name, c in derived.items()])
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return e.join(docs, "id").join(labels, "id", "left")


POINTS = """
points AS (
  SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS vector, e.label, d.text AS content, d.lang AS collection,
         d.source AS source_key, d.n_chars, l.quality, l.toxic
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id)
"""


def documents_as_points(spark: SparkSession, d: str, parts: int | None = None, here: Column | None = None) -> DataFrame:
    """Every document, with its vector where it has one; in *parts* partitions by ``id`` and only ids *here*, where given."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    docs = table(spark, d, "documents")
    docs = (spread(docs) if parts is None else docs).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("collection"))
    if here is not None:
        docs, e = docs.where(here), e.where(here)
    if parts is not None:
        docs, e = docs.repartition(parts, "id"), e.repartition(parts, "id")
    return docs.join(e, "id", "left")


def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """``id, content, collection`` of the rows of :func:`documents_as_points`, for work on words alone: no text moves to meet its vector.

    A document is as many rows as it has vectors, one where it has none.
    """
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("collection"))
    often = written(table(spark, d, "embeddings").groupBy(F.col("vec_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1"), "often")
    if often.isEmpty():
        return docs
    rows = docs.join(often, "id", "left").withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("n", F.lit(1).cast("bigint")))))
    return rows.drop("n")


DOCUMENTS_AS_POINTS = """
points AS (
  SELECT d.doc_id AS id, CAST(e.embedding AS DOUBLE[]) AS vector, e.label, d.text AS content, d.lang AS collection, d.source AS source_key
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)
"""


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector asks for its neighbours."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), "label")


PAIRS = """
pairs AS (
  SELECT q.vec_id AS qid, q.label AS q_label, p.vec_id AS id, p.label,
         list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score
  FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id)
"""


def text_queries(spark: SparkSession, d: str, docs: DataFrame) -> DataFrame:
    """Benchmark texts with the vector of the same number and their words."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    lexical = rt.query_terms(b, docs, qid="qid", query="query", text="content")
    return (b.join(vectors, "qid", "left").join(lexical, "qid", "left")
            .withColumn("match", tx.match_tokens("query")))


# Words of points and queries, document frequency, weights: needs points.
LEXICAL = r"""
bench AS (
  SELECT b.item_id AS qid, b.text AS query, CAST(e.embedding AS DOUBLE[]) AS vector
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id),
dterms AS (
  SELECT id, term, count(*) AS tf FROM (
    SELECT id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]{2,}')) AS term FROM points) GROUP BY id, term),
qterms AS (
  SELECT qid, term, count(*) AS tf FROM (
    SELECT qid, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]{2,}')) AS term FROM bench) GROUP BY qid, term),
freq AS (SELECT term, count(*) AS df, (SELECT count(*) FROM points) AS n FROM dterms GROUP BY term),
sparse AS (
  SELECT q.qid, d.id, sum((1 + ln(q.tf)) * (1 + ln(d.tf)) * power(ln(1.0 + n / df), 2)) AS score
  FROM qterms q JOIN dterms d USING (term) JOIN freq USING (term) GROUP BY q.qid, d.id),
matched AS (
  SELECT q.qid, d.id FROM qterms q JOIN dterms d USING (term) GROUP BY q.qid, d.id
  HAVING count(*) = (SELECT count(*) FROM qterms x WHERE x.qid = q.qid)),
dense AS (
  SELECT b.qid, p.id, p.collection, p.source_key, list_cosine_similarity(b.vector, p.vector) AS score
  FROM bench b CROSS JOIN points p WHERE p.vector IS NOT NULL AND b.vector IS NOT NULL)
"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(v.strip() for v in views) + "\n"
