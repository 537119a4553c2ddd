"""From candidates to context: caps, balance, boosts, relevance, excerpts on derived candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreloom.functions import classify as cl
from loreloom.functions import fixed_values as fixed
from loreloom.operators import ranking as rk, registry
from loreloom.plans.registry import query, table
from loreloom.plans.search import GROUPED, OTHER_WORDING, collection_hits, other_wording, with_content

KEEP = ("qid", "collection", "id")
BY_SCORE = "ORDER BY score DESC, collection, id"


def _scored(found):
    return found.withColumn("score", F.round("score", 9)).withColumnRenamed("depth", "rank")


def hits(spark, d):
    """Candidates with scores to 9 places, so that order does not hang on summation; without their texts, which are joined to what is left."""
    return rk.together(_scored(collection_hits(spark, d, content=False)))


def second_hits(spark, d):
    """Candidates of the search with the other wording."""
    return rk.together(_scored(collection_hits(spark, d, other_wording(spark, d), content=False)))


def hits_with_texts(spark, d):
    """Candidates judged one by one by their text: they need not come together, so no text moves with a hit."""
    return _scored(collection_hits(spark, d))


HITS = GROUPED + ", h AS (SELECT * REPLACE (round(score, 9) AS score) FROM hits)\n"
BOTH = HITS + "," + OTHER_WORDING + ", h2 AS (SELECT * REPLACE (round(score, 9) AS score) FROM other_hits)\n"


@query("RET-13", HITS + "SELECT qid, collection, id FROM h WHERE collection <> 'fr' OR contains(content, ' les ')")
def answered_hits(spark, d):
    return rk.answered_only(hits_with_texts(spark, d), collection="fr", marker=" les ").select(*KEEP)


@query("RET-15", """
SELECT doc_id AS id, coalesce(nullif(CASE WHEN lang = 'en' THEN source ELSE '' END, ''), nullif(CASE WHEN lang = 'fr' THEN 'u' || source END, ''), CAST(doc_id AS VARCHAR)) AS source_key FROM documents""")
def stable_keys(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", F.col("source")).otherwise("").alias("source_key"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("u"), F.col("source"))).alias("url"))
    return rows.select("id", rk.stable_key(rows).alias("source_key"))


@query("RET-14", """
SELECT doc_id, CASE lang WHEN 'en' THEN '[AARK·단일제보] ' || CAST(doc_id % 9 AS VARCHAR) || '. en > ' || source WHEN 'fr' THEN '[규정(심사규정)]/formula ' || source
    WHEN 'de' THEN source ELSE '제' || CAST(doc_id % 9 AS VARCHAR) || '장 ' || lang || ' > ' || source END AS source,
  CASE lang WHEN 'fr' THEN 'https://x.example/' || source ELSE '' END AS url FROM documents""")
def source_labels(spark, d):
    kind = F.when(F.col("lang") == "en", "aark").when(F.col("lang") == "fr", "rules").otherwise("")
    rows = table(spark, d, "documents").select(
        "doc_id", kind.alias("source_type"), F.when(F.col("lang") == "de", F.col("source")).alias("title"), F.col("lang").alias("chapter"),
        (F.col("doc_id") % 9).alias("chapter_num"), F.col("source").alias("section"), F.lit("단일제보").alias("confidence"),
        F.lit("judging").alias("document_type"), F.lit("심사규정").alias("document_type_label"), F.col("source").alias("source_title"),
        F.lit("formula").alias("competition"), F.concat(F.lit("https://x.example/"), F.col("source")).alias("source_url"))
    return rk.source_label(rows).select("doc_id", "source", "url")


BOOSTED = HITS + """, boosted AS (
SELECT qid, collection, id, score, CAST(
    CASE WHEN qc IS NULL THEN 0 WHEN competition = qc THEN 0.18 WHEN competition <> '' THEN -0.08 ELSE 0 END
  + CASE WHEN ql <= 4 THEN 0 WHEN quality = 1 THEN 0.14 ELSE -0.04 END
  + CASE WHEN label = ql THEN 0.20 ELSE 0 END + CASE WHEN id % 3 = qid % 3 THEN 0.12 ELSE 0 END
  + least(0.35, 0.06 * (CAST(contains(s, qlang) AS INT) + CASE WHEN qsource <> qlang AND contains(s, qsource) THEN 1 ELSE 0 END)) AS DOUBLE) AS boost
FROM (SELECT h.*, q.label AS ql, qd.lang AS qlang, qd.source AS qsource,
        CASE q.label WHEN 0 THEN NULL WHEN 1 THEN 'formula' WHEN 2 THEN 'baja' ELSE 'ev' END AS qc,
        CASE h.label WHEN 0 THEN '' WHEN 1 THEN 'formula' WHEN 2 THEN 'baja' ELSE 'ev' END AS competition,
        lower(h.source_key || ' ' || h.collection || ' ' || CASE h.label WHEN 0 THEN '' WHEN 1 THEN 'formula' WHEN 2 THEN 'baja' ELSE 'ev' END) AS s
      FROM h JOIN embeddings q ON q.vec_id = h.qid JOIN documents qd ON qd.doc_id = h.qid))
"""


def hinted_hits(spark, d):
    """Candidates with the hints of their query."""
    names = {"0": "", "1": "formula", "2": "baja"}
    family = F.coalesce(cl.lookup(F.col("label").cast("string"), names), F.lit("ev"))
    q = table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select(
        F.col("vec_id").alias("qid"), F.when(F.col("label") != 0, family).alias("q_competition"),
        F.when(F.col("label") > 4, "judging").alias("q_document_type"), F.array_distinct(F.array("lang", "source")).alias("q_terms"),
        F.array(F.col("label").cast("bigint")).alias("q_sections"), F.array(F.col("vec_id") % 3).alias("q_chapters"))
    return hits(spark, d).join(q, "qid").withColumns({
        "competition": family, "document_type": F.when(F.col("quality") == 1, "judging").otherwise(""), "section": F.col("source_key"),
        "chapter": F.col("collection"), "section_num": F.col("label"), "chapter_num": F.col("id") % 3})


@query("RET-21", BOOSTED + "SELECT qid, collection, id, round(boost, 6) AS boost FROM boosted")
def boosted_hits(spark, d):
    h = hinted_hits(spark, d)
    return h.select(*KEEP, F.round(rk.query_boost(h), 6).alias("boost"))


@query("RET-21", BOOSTED + "SELECT qid, collection, id, round(score + CASE WHEN collection = 'fr' THEN boost * 0.2 ELSE 0 END, 9) AS score FROM boosted")
def boosted_scores(spark, d):
    """The boost's share reaches the scores of rule hits only."""
    h = hinted_hits(spark, d).withColumn("source_type", F.when(F.col("collection") == "fr", "rules").otherwise("qna"))
    return rk.adjust_scores(h, boost=rk.query_boost(h)).select(*KEEP, F.round("score", 9).alias("score"))


@query("RET-22 RET-3", HITS + """
SELECT qid, collection, id, round(score - CAST(0.04 AS DOUBLE) * p, 9) AS score FROM (
  SELECT *, CASE WHEN collection <> 'en' THEN 0 WHEN toxic = 1 OR contains(content, '답변 없음') THEN 2 WHEN quality = 0 THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS p FROM h)
WHERE p = 0 OR score - CAST(0.04 AS DOUBLE) * p >= 0.1""")
def penalized_hits(spark, d):
    h = hits_with_texts(spark, d).withColumn("confidence", F.when(F.col("toxic") == 1, "미해결").when(F.col("quality") == 0, "단일제보"))
    p = rk.evidence_penalty(h, kb_collection="en")
    return rk.adjust_scores(h, penalty=p, min_score=0.1).select(*KEEP, F.round("score", 9).alias("score"))


CAPPED = """, c AS (SELECT *, CASE WHEN collection <> 'es' THEN source_key END AS post_id FROM h),
c1 AS (SELECT *, CASE WHEN post_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY qid, post_id ORDER BY score DESC, collection, id) END AS p FROM c),
c2 AS (SELECT *, row_number() OVER (PARTITION BY qid, CAST(label AS VARCHAR) ORDER BY score DESC, collection, id) AS s FROM c1 WHERE p <= 2),
capped AS (SELECT * EXCLUDE (p, s), row_number() OVER (PARTITION BY qid ORDER BY score DESC, collection, id) AS rank FROM c2 WHERE s <= 2)
"""


def capped_hits(spark, d):
    h = hits(spark, d).withColumn("post_id", F.when(F.col("collection") != "es", F.col("source_key")))
    h = h.withColumn("chapter", F.lit("")).withColumn("section", F.col("label").cast("string"))
    return rk.cap_repeats(h.withColumnRenamed("source_key", "origin"))


@query("RET-23", HITS + CAPPED + "SELECT qid, collection, id, rank FROM capped")
def capped_duplicates(spark, d):
    return capped_hits(spark, d).select(*KEEP, "rank")


BALANCED = """, sized AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, row_number() OVER (PARTITION BY qid, collection ORDER BY score DESC, collection, id) AS r FROM h),
balanced AS (SELECT * FROM (SELECT * EXCLUDE (n, r), row_number() OVER (PARTITION BY qid ORDER BY score DESC, collection, id) AS rank
  FROM sized JOIN (SELECT qid AS q, count(DISTINCT collection) AS k FROM h GROUP BY qid) ON q = qid WHERE n <= 24 OR k = 1 OR r <= 12) WHERE rank <= 24)
"""


def balanced_hits(spark, d):
    return rk.balance(hits(spark, d), 24, group=F.col("collection"))


@query("RET-24", HITS + BALANCED + "SELECT qid, collection, id, rank FROM balanced")
def balanced_pool(spark, d):
    return balanced_hits(spark, d).select(*KEEP, "rank")


@query("RET-25", HITS + BALANCED + """
SELECT qid, CAST(count(*) FILTER (collection = 'en') AS BIGINT) AS en, CAST(count(*) FILTER (collection = 'fr') AS BIGINT) AS fr,
  CAST(count(*) FILTER (collection = 'de') AS BIGINT) AS de, CAST(count(*) FILTER (collection = 'es') AS BIGINT) AS es FROM balanced GROUP BY qid""")
def pool_counts(spark, d):
    return rk.candidate_counts(balanced_hits(spark, d), ("en", "fr", "de", "es"), group=F.col("collection"))


@query("RET-25", HITS + """
SELECT qid, CAST(count(*) FILTER (collection = 'fr' OR label = 3) AS BIGINT) AS rules, CAST(count(*) FILTER (collection = 'en' AND label <> 3) AS BIGINT) AS qna,
  CAST(count(*) FILTER (collection = 'de' AND label <> 3) AS BIGINT) AS aark, CAST(count(*) FILTER (collection = 'es' AND label <> 3) AS BIGINT) AS other FROM h GROUP BY qid""")
def pool_counts_by_source(spark, d):
    """The grouping by payload: names of collections, and the source type where the name says nothing."""
    names = {"fr": "rules-formula-2026", "en": "qna", "de": "kb", "es": "elsewhere"}
    named = F.when(F.col("label") == 3, "unnamed").otherwise(cl.lookup(F.col("collection"), names))
    h = hits(spark, d).withColumn("source_type", F.when(F.col("label") == 3, "rules")).withColumn("collection", F.when((F.col("collection") == "fr"), "rules").otherwise(named))
    return rk.candidate_counts(h)


@query("RET-26", BOTH + """, paths AS (SELECT *, 0 AS path FROM h UNION ALL SELECT *, 1 FROM h2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_key, content ORDER BY score DESC, path, collection, id) AS r FROM paths) WHERE r = 1),
sized AS (SELECT * EXCLUDE (r), count(*) OVER (PARTITION BY qid) AS n, row_number() OVER (PARTITION BY qid, collection ORDER BY score DESC, id) AS r FROM best)
SELECT qid, collection, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, collection, id) AS rank FROM sized WHERE n <= 24 OR r <= 12) WHERE rank <= 24""")
def merged_search_paths(spark, d):
    """The searches by both wordings, over all points each, as one pool."""
    # A text is told apart by its digest, made once a document; hits carry nothing else of it.
    digests = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    paths = (_scored(collection_hits(spark, d, queries, content=False)).select(*KEEP, "score", "rank", "source_key").join(digests, "id")
             for queries in (None, other_wording(spark, d)))
    merged = rk.merge_paths(*map(rk.together, paths), 24, group=F.col("collection"), text=F.col("digest"))
    return merged.select(*KEEP, "score", "rank")


@query("RET-27", HITS + r"""
SELECT qid, collection, id FROM (SELECT h.*, CASE q.label WHEN 1 THEN 'formula' WHEN 2 THEN 'baja' END AS qc,
    CASE h.label WHEN 1 THEN 'formula' WHEN 2 THEN 'baja' WHEN 3 THEN 'other' WHEN 4 THEN 'ev'
      ELSE CASE WHEN regexp_matches(c, '(?i)e[- ]?formula') THEN 'e_formula' WHEN regexp_matches(c, '(?i)formula') THEN 'formula'
                WHEN regexp_matches(c, '(?i)baja') THEN 'baja' WHEN regexp_matches(c, '(?i)\bev\b|electric\s+vehicle') THEN 'ev' END END AS k
  FROM (SELECT *, content AS c FROM h) h JOIN embeddings q ON q.vec_id = h.qid)
WHERE qc IS NULL OR k IS NULL OR k = 'other' OR k = qc""")
def hits_of_competition(spark, d):
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), cl.lookup(F.col("label").cast("string"), {"1": "formula", "2": "baja"}).alias("q_competition"))
    # A text is read once a document; hits carry what it names, not the text.
    found = _scored(collection_hits(spark, d, content=False, seen=rk.seen_competition(F.lit(""), F.col("text"))))
    h = found.withColumn("competition", cl.lookup(F.col("label").cast("string"), {"1": "formula", "2": "baja", "3": "other", "4": "ev"}))
    return rk.same_competition(h.join(q, "qid"), seen=F.col("seen")).select(*KEEP)


@query("RET-28", HITS + """
SELECT qid, CASE WHEN bad = 0 THEN 'ok' WHEN bad = n AND found = 0 THEN 'failed' ELSE 'partial' END AS status, CAST(bad AS BIGINT) AS failed_collections FROM (
  SELECT qid, count(*) AS n, count(*) FILTER (failed) AS bad, sum(hits) AS found FROM (
    SELECT qid, collection, max(score) < 0.25 AS failed, count(*) FILTER (score >= 0.25) AS hits FROM h GROUP BY qid, collection) GROUP BY qid)""")
def search_status(spark, d):
    attempts = hits(spark, d).groupBy("qid", "collection").agg(
        (F.max("score") < 0.25).alias("failed"), F.count_if(F.col("score") >= 0.25).alias("hits"))
    return rk.retrieval_status(attempts)


def _status(found, least):
    attempts = found.groupBy("qid", "collection").agg((F.max("score") < least).alias("failed"), F.count_if(F.col("score") >= least).alias("hits"))
    return rk.retrieval_status(attempts)


STATUS = """(SELECT qid, CASE WHEN bad = 0 THEN 'ok' WHEN bad = n AND found = 0 THEN 'failed' ELSE 'partial' END AS status FROM (
  SELECT qid, count(*) AS n, count(*) FILTER (failed) AS bad, sum(hits) AS found FROM (
    SELECT qid, collection, max(score) < 0.28 AS failed, count(*) FILTER (score >= 0.28) AS hits FROM {h} GROUP BY qid, collection) GROUP BY qid))"""


@query("RET-28", BOTH + f"""
SELECT qid, a.status AS first, b.status AS second, CASE WHEN (a.status = 'ok') <> (b.status = 'ok') THEN 'partial' ELSE a.status END AS status
FROM {STATUS.format(h='h')} a JOIN {STATUS.format(h='h2')} b USING (qid)""")
def two_path_status(spark, d):
    """Status of a search by two wordings; a collection whose best score lies below the bar counts as failed."""
    first, second = (_status(found, 0.28).select("qid", F.col("status").alias(name)) for found, name in ((hits(spark, d), "first"), (second_hits(spark, d), "second")))
    return first.join(second, "qid").withColumn("status", rk.merge_status(F.col("first"), F.col("second")))


RELEVANT = HITS + BALANCED + """, final AS (
SELECT * FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC NULLS LAST, score DESC, collection, id) AS rank FROM (
    SELECT b.* EXCLUDE (given, valid, n), CASE WHEN valid > 0 AND n > 1 THEN greatest(CAST(0 AS DOUBLE), coalesce(given, CAST(0 AS DOUBLE)) - CASE WHEN toxic = 1 THEN 2 ELSE 0 END) END AS rerank_score FROM (
      SELECT *, CAST(CASE WHEN quality = 1 THEN 4 + label WHEN quality = 0 THEN 2 + label END AS DOUBLE) AS given,
        count(quality) OVER (PARTITION BY qid) AS valid, count(*) OVER (PARTITION BY qid) AS n FROM balanced) b)
  WHERE rerank_score IS NULL OR rerank_score >= 3) WHERE rank <= 7)
"""


def final_hits(spark, d):
    """The list an answer is built from: the best seven by relevance."""
    given = F.when(F.col("quality").isNotNull(), F.when(F.col("quality") == 1, 4.0).otherwise(2.0) + F.col("label"))
    pen = F.when(F.col("toxic") == 1, 2.0).otherwise(0.0)
    return rk.apply_relevance(balanced_hits(spark, d), given, 7, penalty=pen)


@query("RET-29", RELEVANT + "SELECT qid, collection, id, rerank_score, rank FROM final")
def relevant_hits(spark, d):
    return final_hits(spark, d).select(*KEEP, "rerank_score", "rank")


@query("RET-30", r"""
SELECT doc_id, CASE WHEN i > 0 THEN substr(substr(t, 1, i - 1), 1, 300) || E'\n[답변]' || substr(substr(t, i + 4), 1, 900) ELSE substr(t, 1, 1000) END AS excerpt
FROM (SELECT doc_id, t, strpos(t, '[답변]') AS i FROM (SELECT doc_id, replace(text, E'\n', '[답변]') AS t FROM documents))""")
def excerpts(spark, d):
    t = F.replace(F.col("text"), F.lit("\n"), F.lit(fixed.ANSWER_MARK))
    return table(spark, d, "documents").select("doc_id", rk.excerpt(t).alias("excerpt"))


@query("RET-31", RELEVANT.replace("SELECT * FROM (SELECT * EXCLUDE (rank)", "SELECT *, CASE label WHEN 0 THEN '' WHEN 1 THEN 'formula' WHEN 2 THEN 'baja' ELSE 'ev' END AS competition FROM (SELECT * EXCLUDE (rank)", 1) + r"""
SELECT v.vec_id AS qid, coalesce('다음은 검색된 참고 문서입니다:' || E'\n\n' || docs || E'\n\n---\n\n', '질문에 직접 관련된 참고 문서를 찾지 못했습니다. 문서 근거가 필요한 허용 여부·검차 판단은 단정하지 마세요.' || E'\n\n')
  || E'(검색 상태: ok)\n' || CASE WHEN families > 1 THEN E'(서로 다른 종목의 자료가 검색되었습니다. 이를 하나의 규정처럼 합치지 말고 종목별 공통점과 차이를 명시하세요. 허용 여부가 달라지면 먼저 종목을 확인하세요.)\n' ELSE '' END
  || '사용자 질문: ' || 'near ' || CAST(v.vec_id AS VARCHAR) AS prompt, CAST(coalesce(n, 0) AS BIGINT) AS sources, coalesce(families, 0) > 1 AS mixed
FROM embeddings v LEFT JOIN (SELECT qid, count(*) AS n, count(DISTINCT nullif(competition, '')) AS families,
  string_agg('[문서 ' || CAST(rank AS VARCHAR) || '] ' || source_key || CASE WHEN collection = 'en' THEN E'\nURL: u' || CAST(id AS VARCHAR) ELSE '' END || E'\n' || content, E'\n\n---\n\n' ORDER BY rank) AS docs
  FROM final GROUP BY qid) f ON f.qid = v.vec_id""")
def context_packs(spark, d):
    names = {"0": "", "1": "formula", "2": "baja"}
    final = with_content(spark, d, final_hits(spark, d)).withColumns({
        "competition": F.coalesce(cl.lookup(F.col("label").cast("string"), names), F.lit("ev")), "source": F.col("source_key"),
        "url": F.when(F.col("collection") == "en", F.concat(F.lit("u"), F.col("id"))).otherwise("")})
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.concat(F.lit("near "), F.col("vec_id")).alias("query"))
    return rk.context_pack(final, q)


@query("RET-31", HITS + BALANCED + r"""
SELECT qid, string_agg('**' || source_key || '** (score: ' || printf('%.4f', score) || ')' || CASE WHEN collection = 'en' THEN E'\nu' || CAST(id AS VARCHAR) ELSE '' END || E'\n```\n' || content || E'\n```', E'\n\n---\n\n' ORDER BY rank) AS results
FROM balanced WHERE rank <= 7 GROUP BY qid""")
def result_lists(spark, d):
    final = with_content(spark, d, balanced_hits(spark, d).where(F.col("rank") <= 7)).withColumns({
        "source": F.col("source_key"), "url": F.when(F.col("collection") == "en", F.concat(F.lit("u"), F.col("id"))).otherwise("")})
    return rk.result_list(final)


@query("RET-14", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN source ELSE '' END AS content FROM documents")
def point_contents(spark, d):
    """Texts of points, some under the older name, some without any."""
    part = F.col("doc_id") % 3
    rows = table(spark, d, "documents").select("doc_id", F.when(part == 0, F.col("text")).otherwise("").alias("content"), F.when(part < 2, F.col("source")).alias("chunk_text"))
    return rows.select("doc_id", rk.content_of(rows).alias("content"))


# --- collection registry and routing ------------------------------------------------------------


@query("REG-1", r"""
SELECT 'rules-' || c.s || '-' || t.s || '-2026' AS key, 'rules-' || c.s || '-' || t.s || '-2026-v2' AS collection, c.r_name AS competition_key, t.n_name AS document_type_key
FROM (SELECT r_name, lower(replace(r_name, ' ', '-')) AS s FROM region) c, (SELECT n_name, regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9가-힣-]', '-', 'g'), '-+', '-', 'g') AS s FROM nation) t""")
def collection_registry(spark, d):
    names = table(spark, d, "region").select(F.col("r_name").alias("competition"), F.initcap("r_name").alias("competition_label"))
    kinds = table(spark, d, "nation").select(F.col("n_name").alias("document_type"), F.initcap("n_name").alias("document_type_label"))
    return registry.build(names, kinds, "2026").select("key", "collection", "competition_key", "document_type_key")


REGISTRY = """reg AS (SELECT 'rules-' || lower(replace(r_name, ' ', '-')) || '-' || regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9가-힣-]', '-', 'g'), '-+', '-', 'g') || '-2026' AS key, r_name, n_name, r_regionkey, n_regionkey FROM region, nation)"""


def _registry(spark, d):
    names = table(spark, d, "region").select(F.col("r_name").alias("competition"), F.col("r_name").alias("competition_label"))
    kinds = table(spark, d, "nation").select(F.col("n_name").alias("document_type"), F.col("n_name").alias("document_type_label"))
    return registry.build(names, kinds, "2026")


def _populated(spark, d):
    """A nation's collection exists in its own region."""
    own = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    reg = _registry(spark, d)
    return reg.join(own, (reg.competition_key == own.r_name) & (reg.document_type_key == own.n_name), "left_semi")


@query("REG-2", "WITH " + REGISTRY + "SELECT key FROM reg WHERE n_regionkey = r_regionkey")
def requested_collections(spark, d):
    wanted = _populated(spark, d).select("key")
    return registry.resolve(_registry(spark, d), wanted.unionByName(wanted))


@query("REG-3", "WITH " + REGISTRY + "SELECT key FROM reg WHERE n_regionkey = r_regionkey UNION ALL SELECT 'rules' UNION ALL SELECT 'qna'")
def expanded_collections(spark, d):
    reg, populated = registry.with_groups(_registry(spark, d)), _populated(spark, d).select("collection")
    asked = table(spark, d, "region").select(F.when(F.col("r_regionkey") == 0, "qna").otherwise("rules").alias("key"))
    return registry.expand(reg, asked, populated)


@query("REG-4", """
SELECT lower(r_name) AS key, r_name AS label, CASE WHEN last % 2 = 0 THEN 'rules' ELSE 'qna' END AS source_type
FROM region JOIN (SELECT n_regionkey AS r_regionkey, max(n_nationkey) AS last FROM nation GROUP BY 1) USING (r_regionkey)""")
def public_collections(spark, d):
    """One group of collections for each region; its detail collections stay hidden."""
    last = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.max("n_nationkey").alias("last"))
    groups = table(spark, d, "region").join(last, "r_regionkey").select(
        F.lower("r_name").alias("key"), F.lower("r_name").alias("collection"), F.col("r_name").alias("label"), F.when(F.col("last") % 2 == 0, "rules").otherwise("qna").alias("source_type"))
    return registry.public(registry.with_groups(_registry(spark, d), groups)).select("key", "label", "source_type")


@query("RET-17 RET-18", """
WITH a AS (SELECT bool_or(p_size < 20) AS formula, bool_or(p_size >= 20) AS smart FROM part),
q AS (SELECT conv_id, turn, text, CASE WHEN turn = 0 THEN 'e_formula' WHEN turn < 4 THEN 'ev' END AS competition, CASE WHEN turn < 2 THEN 'judging' WHEN turn < 6 THEN 'vehicle-technical' END AS document_type FROM conversations WHERE role = 'user'),
r AS (SELECT q.*, a.*, CASE WHEN competition = 'e_formula' AND formula THEN 'formula' WHEN competition = 'ev' AND smart THEN 'smart_e_mobility' ELSE competition END AS competition_filter FROM q, a)
SELECT conv_id, turn, competition, document_type, competition_filter, CASE WHEN document_type = 'vehicle-technical' AND (competition_filter IS NULL OR (competition_filter = 'formula' AND formula) OR (competition_filter = 'smart_e_mobility' AND smart)) THEN document_type END AS document_type_filter FROM r""")
def routed_queries(spark, d):
    """Conversation questions routed against the competitions and types found in the part table."""
    q = table(spark, d, "conversations").where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("query"),
        F.when(F.col("turn") == 0, "e_formula").when(F.col("turn") < 4, "ev").alias("competition"),
        F.when(F.col("turn") < 2, "judging").when(F.col("turn") < 6, "vehicle-technical").alias("document_type"))
    active = table(spark, d, "part").select(F.when(F.col("p_size") < 20, "formula").otherwise("smart_e_mobility").alias("competition_key"),
                                            F.lit("vehicle-technical").alias("document_type_key")).distinct()
    return rk.route_document_type(rk.route_competition(q, active), active).drop("query")
