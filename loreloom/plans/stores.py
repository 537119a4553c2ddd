"""Collections as tables: upsert, prune, payload, routing, enrich-copy, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreloom import schemas
from loreloom.operators import retrieval as rt
from loreloom.plans import tables as tb
from loreloom.plans.chunking import SEGMENTS, document_chunks
from loreloom.plans.registry import query, table
from loreloom.session import drop_written, work_folder, written_in_parts
from loreloom.sources import buckets, readers, sinks


def stored(spark, d):
    """A stored collection: documents outside one language, under their source."""
    return table(spark, d, "documents").where(F.col("lang") != "es").select(F.col("doc_id").cast("string").alias("id"), F.lit("old").alias("version"), F.col("n_chars").alias("size"))


def incoming(spark, d):
    """Labelled documents arrive, toxic ones twice."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    one = rows.select(F.col("doc_id").cast("string").alias("id"), F.lit("new").alias("version"), F.col("n_chars").alias("size"), F.lit(1).alias("pos"))
    return one.unionByName(rows.where(F.col("toxic") == 1).select(F.col("doc_id").cast("string").alias("id"), F.lit("newest").alias("version"), F.lit(0).cast("bigint").alias("size"), F.lit(2).alias("pos")))


STORED = """
stored AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'old' AS version, n_chars AS size FROM documents WHERE lang <> 'es'),
incoming AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'newest' ELSE 'new' END AS version, CASE WHEN toxic = 1 THEN 0 ELSE n_chars END AS size FROM labels JOIN documents USING (doc_id))
"""


@query("SNK-1", "WITH " + STORED + "SELECT * FROM stored WHERE id NOT IN (SELECT id FROM incoming) UNION ALL SELECT id, version, CAST(size AS BIGINT) FROM incoming")
def upserted_points(spark, d):
    return sinks.upsert(stored(spark, d), incoming(spark, d), "id", [F.col("pos")])


@query("SNK-3", "WITH " + STORED + "SELECT id, id IN (SELECT id FROM incoming) AS kept FROM stored")
def pruned_points(spark, d):
    old, new = stored(spark, d), incoming(spark, d)
    kept = sinks.pruned(old, new, "id").select("id", F.lit(True).alias("kept"))
    return kept.unionByName(sinks.stale(old, new, "id").select("id", F.lit(False).alias("kept")))


@query("SNK-2 SNK-3", "WITH " + STORED + "SELECT id AS point_id, version, CAST(size AS BIGINT) AS size FROM incoming")
def loaded_versions(spark, d):
    """Recreate, then load the incoming rows on top and prune the rest."""
    path = work_folder(spark, "collection")
    sinks.load(stored(spark, d).withColumnRenamed("id", "point_id"), path, recreate=True)
    out = sinks.load(incoming(spark, d).withColumnRenamed("id", "point_id"), path, recreate=False, order=[F.col("pos")], prune=True)
    return spark.read.parquet(out).select("point_id", "version", "size")


@query("SNK-1 SNK-2", """
SELECT doc_id AS point_id, sha256(CASE WHEN doc_id % 100 = 7 THEN text || ' again' ELSE text END) AS digest, CASE WHEN doc_id % 100 = 7 THEN 2 ELSE 1 END AS version FROM documents
UNION ALL SELECT -1 - doc_id, sha256(text), 2 FROM documents WHERE doc_id % 100 = 9""")
def bucketed_loads(spark, d):
    """All documents loaded, then one in a hundred changed and as many added; only the buckets of those are rewritten."""
    path = work_folder(spark, "buckets")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("point_id"), "text", F.lit(1).alias("version"))
    buckets.load(docs, path, "point_id")
    part = F.col("point_id") % 100
    changed = docs.where(part == 7).withColumns({"text": F.concat("text", F.lit(" again")), "version": F.lit(2)})
    added = docs.where(part == 9).withColumns({"point_id": -1 - F.col("point_id"), "version": F.lit(2)})
    buckets.load(changed.unionByName(added), path, "point_id")
    return buckets.current(spark, path).select("point_id", F.sha2("text", 256).alias("digest"), "version")


@query("SNK-4", """
SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, CAST(0 AS BIGINT) AS chunk_index, '' AS category, coalesce(CASE WHEN lang = 'de' THEN source END, '') AS title, '' AS author, lang = 'fr' AS has_answer FROM documents""")
def payload_points(spark, d):
    chunks = table(spark, d, "documents").select(
        F.col("doc_id").alias("post_id"), "text", F.lit(0).alias("chunk_index"), F.when(F.col("lang") == "de", F.col("source")).alias("title"), (F.col("lang") == "fr").alias("has_answer"))
    return sinks.payload(chunks, schemas.QNA_PAYLOAD).drop("point_id", "date", "url")


def routable(spark, d):
    docs = table(spark, d, "documents")
    competition = F.when(F.col("lang") == "en", "Formula Student").when(F.col("lang") == "fr", " baja ").otherwise(F.col("source"))
    kind = F.when(F.col("n_chars") % 2 == 0, "Judging").otherwise("safety ")
    return docs.select(F.col("source").alias("source_key"), F.col("doc_id").alias("chunk_index"), competition.alias("competition"), kind.alias("document_type"),
                       F.when(F.col("lang") == "de", "2025").otherwise("2026").alias("year"), "text")


@query("SNK-5", """
SELECT 'rules-' || CASE lang WHEN 'en' THEN 'formula' WHEN 'fr' THEN 'baja' ELSE 'other' END || CASE WHEN n_chars % 2 = 0 THEN '-judging' ELSE '-safety' END || '-2026' AS collection, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars
FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1""")
def routed_collections(spark, d):
    """Route everything, then only four collections again: two others go, a fifth never existed."""
    path = work_folder(spark, "collections")
    rows = routable(spark, d)
    sinks.route(rows, path, "2026")
    wanted = [f"rules-{c}-{t}-2026" for c in ("formula", "baja", "other") for t in ("judging", "safety")]
    sinks.route(rows.where(F.col("competition").isin("Formula Student", " baja ")), path, "2026", [*wanted, "rules-ev-safety-2026"])
    return spark.read.parquet(path).groupBy("collection").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).cast("bigint").alias("chars"))


COPY_SHARES = 6


@query("SNK-7 EMB-2", tb.with_views(tb.DOCUMENTS_AS_POINTS, tb.LEXICAL) + "SELECT p.id, count(term) AS terms, CAST(max(CASE WHEN p.vector IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS lost, CAST(0 AS BIGINT) AS changed FROM points p LEFT JOIN dterms d ON d.id = p.id GROUP BY p.id")
def enriched_copy(spark, d):
    vectors, parts = rt.lexical_vectors(tb.document_texts(spark, d), "id", "content", shares=COPY_SHARES)
    # Texts and vectors move by shares of the ids, each to as many partitions as bound what a task sorts.
    parts = 1 + parts // COPY_SHARES
    shares = [F.pmod(F.xxhash64("id"), F.lit(COPY_SHARES)).eqNullSafe(i) for i in range(COPY_SHARES)]
    copy = written_in_parts([sinks.enrich_copy(tb.documents_as_points(spark, d, parts, here), vectors.where(here).repartition(parts, "id"), "id") for here in shares], "copy")
    drop_written(vectors)
    source = tb.documents_as_points(spark, d)
    # Ids, payload and vectors of the written copy are those of the source.
    odd = sinks.copy_differences(source, copy, ["id", "vector", "content", "collection", "label"]).groupBy("id").agg(F.count("*").alias("changed"))
    sizes = copy.select("id", F.coalesce(F.size("terms"), F.lit(0)).cast("bigint").alias("terms"), F.col("vector").isNull().cast("bigint").alias("lost"))
    return sizes.join(odd, "id", "left").withColumn("changed", F.coalesce("changed", F.lit(0)))


@query("SRC-4", """
SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS chunks_without_vector,
  (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS vectors_without_chunk, (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS wrong_dimension""")
def vector_pairing(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"))
    return readers.pairing_report(chunks, table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), ["chunk_id"], "embedding", 64)


@query("SRC-6 SRC-2", tb.with_views(tb.DOCUMENTS_AS_POINTS) + "SELECT id FROM points WHERE collection = 'fr'")
def collection_ids(spark, d):
    return readers.scan_collection(tb.documents_as_points(spark, d), "fr", ["id"])


@query("SRC-7", "SELECT DISTINCT lang AS collection FROM documents")
def collection_names(spark, d):
    return readers.collections(table(spark, d, "documents").withColumnRenamed("lang", "collection"))


@query("SRC-8", """
SELECT c_nationkey AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, CAST(sum(l_quantity) AS DOUBLE) AS quantity, count(DISTINCT e.user_id) AS active
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
LEFT JOIN (SELECT DISTINCT user_id FROM events) e ON e.user_id = c_custkey GROUP BY 1""")
def operational_tables(spark, d):
    """Four operational tables read by name and brought together: customers, their orders, quantities and activity by nation."""
    customer, orders, lineitem, events = (readers.read_table(spark, t, d) for t in ("customer", "orders", "lineitem", "events"))
    quantity = lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    of_order = orders.join(quantity, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    of_customer = of_order.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("quantity").alias("quantity"))
    seen = events.groupBy("user_id").agg(F.lit(1).alias("active"))
    rows = customer.join(of_customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(seen, F.col("user_id") == F.col("c_custkey"), "left")
    return rows.groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count("*").alias("customers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.sum("quantity").cast("double").alias("quantity"), F.count("active").alias("active"))


@query("SRC-1", """
SELECT doc_id AS id, source AS category, sha256(text) AS digest, CAST(CASE WHEN lang = 'en' THEN 2 ELSE 0 END AS BIGINT) AS answers FROM documents""")
def posts_round_trip(spark, d):
    """Posts written as JSON lines and read with their schema."""
    path = work_folder(spark, "posts")
    given = F.array(F.struct(F.col("text").alias("body"), F.lit("u1").alias("url")), F.struct(F.col("source").alias("body"), F.lit("u2").alias("url")))
    table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), F.col("text").alias("question_body"),
                                        F.when(F.col("lang") == "en", given).alias("answers")).write.json(path)
    return readers.read_posts(spark, path, lines=True).select(
        "id", "category", F.sha2("question_body", 256).alias("digest"), F.coalesce(F.size("answers"), F.lit(0)).cast("bigint").alias("answers"))


@query("SRC-1", """
SELECT doc_id AS id, source AS category, sha256(text) AS digest, CAST(CASE WHEN lang = 'en' THEN 2 ELSE 0 END AS BIGINT) AS answers, doc_id % 7 AS file FROM documents""")
def posts_from_arrays(spark, d):
    """Posts in files that hold one JSON array each, as the crawler writes them, read by byte ranges."""
    path = work_folder(spark, "post-arrays")
    given = F.array(F.struct(F.col("text").alias("body"), F.lit("u1").alias("url")), F.struct(F.col("source").alias("body"), F.lit("u2").alias("url")))
    posts = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("category"), F.col("text").alias("question_body"), F.concat(F.lit("{"), F.col("doc_id") % 7, F.lit('}"\\')).alias("title"),
        F.when(F.col("lang") == "en", given).alias("answers"))
    # A line of the file is a row, so no array is built in memory: the first row opens it, the others begin with a comma.
    first = posts.groupBy((F.col("id") % 7).alias("file")).agg(F.min("id").alias("id")).select("id", F.lit(1).alias("opens"))
    lines = posts.join(first, "id", "left").select(
        (F.col("id") % 7).alias("file"), "id", F.concat(F.when(F.col("opens") == 1, "[").otherwise(","), F.to_json(F.struct(*posts.columns))).alias("value"))
    ends = first.select((F.col("id") % 7).alias("file"), F.lit((1 << 63) - 1).alias("id"), F.lit("]").alias("value"))
    lines.unionByName(ends).repartition("file").sortWithinPartitions("file", "id").select("file", "value").write.partitionBy("file").text(path)
    rows = readers.read_posts(spark, path)
    return rows.select("id", "category", F.sha2("question_body", 256).alias("digest"), F.coalesce(F.size("answers"), F.lit(0)).cast("bigint").alias("answers"),
                       F.regexp_extract("title", r"\{(\d)\}", 1).cast("bigint").alias("file"))


@query("SRC-2 CHK-5", "WITH " + SEGMENTS + "SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, sha256(text) AS digest FROM exploded")
def chunks_round_trip(spark, d):
    path = work_folder(spark, "chunks")
    document_chunks(spark, d).write.parquet(path)
    return readers.read_chunks(spark, path).select("doc_id", "chunk_index", F.sha2("text", 256).alias("digest"))


@query("SRC-5", "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, true AS matches FROM documents GROUP BY source")
def document_files(spark, d):
    """A folder of text files for each source, read whole with fingerprint and time."""
    path = work_folder(spark, "files")
    table(spark, d, "documents").select("source", "text").repartition("source").write.partitionBy("source").text(path)
    files = readers.read_documents(spark, f"{path}/*/*.txt")
    matches = F.col("source_version").endswith(F.substring("sha256", 1, 12)) & (F.sha2(F.encode("text", "UTF-8"), 256) == F.col("sha256"))
    return files.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.sum("bytes").alias("bytes"), F.bool_and(matches).alias("matches"))


@query("SRC-3", "SELECT page_id AS source_post_id, url AS source_url, '2026' AS year, true AS downloaded FROM pages")
def manifest_round_trip(spark, d):
    """Items written as JSON lines and read with their schema."""
    path = work_folder(spark, "manifest")
    p = table(spark, d, "pages").select(F.col("page_id").alias("source_post_id"), F.col("url").alias("source_url"), F.lit("2026").alias("year"), F.lit(True).alias("downloaded"))
    readers.write_manifest(p, path)
    return readers.read_manifest(spark, path).select("source_post_id", "source_url", "year", "downloaded")
