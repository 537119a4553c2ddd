"""Normalization, classification, keys and token arithmetic on the given tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreloom.functions import classify as cl
from loreloom.functions import fixed_values as fixed
from loreloom.functions import text as tx
from loreloom.plans.registry import query, table, texts

# Classes for texts in the languages at hand; the operators take rule tables as data.
TOPIC_RULES = (("french", r"(?iU)\b(les|des|une)\b"), ("german", r"(?iU)\b(der|und|nicht)\b"),
               ("spanish", r"(?iU)\b(los|que|para)\b"), ("contact", r"(?i)@|https?:"), ("english", r"(?iU)\b(the|and)\b"))


@query("WEB-5", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\t\f\r\v \x{85}\p{Z}]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), E' \n') AS text
FROM documents""")
def clean_text(spark, d):
    return texts(spark, d, "documents", "doc_id", "text").select("doc_id", tx.clean_text("text").alias("text"))


@query("WEB-6 WEB-4", r"""
SELECT page_id, coalesce(TRY_CAST(CASE WHEN regexp_full_match(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '[0-9]+')
         THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END AS BIGINT), 0) AS page,
       coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), CAST(page_id AS VARCHAR)) AS number,
       nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref,
       CAST(length(html) AS BIGINT) AS size
FROM pages""")
def url_parameters(spark, d):
    grouped = F.format_number(F.length("html"), 0)
    return table(spark, d, "pages").select(
        "page_id", tx.parse_count(tx.or_empty(tx.query_parameter("url", "page"))).alias("page"),
        tx.query_parameter("url", "page", "page_id").alias("number"),
        tx.query_parameter("url", "ref").alias("ref"), tx.parse_count(grouped).alias("size"))


# The given texts hold no compatibility characters and no Hangul, so three of four get an end that the rules change.
RULE_ENDS = ("", " 제3조 심사 규정", " 제 12장\u3000Ⅳ ﬁ", " 차량  기술규정 １２")
QUERY_ENDS = ("", " 놀드락 클램프", " 베기 파이프 방화 벽", " 심사 규정 ＡＢ")


def with_ends(key: str, ends: tuple[str, ...]) -> Column:
    return F.concat(F.col("text"), F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col(key) % len(ends) + 1).cast("int")))


@query("NRM-1 UDF-3", r"""
SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g') || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' 제 3 조 심사규정' WHEN 2 THEN ' 제 12 장 IV fi' ELSE ' 차량기술규정 12' END) AS text FROM documents""")
def normalized_text(spark, d):
    return texts(spark, d, "documents", "doc_id", "text").select("doc_id", cl.normalize_rule_text(with_ends("doc_id", RULE_ENDS)).alias("text"))


@query("NRM-2", r"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (
  SELECT doc_id, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line
  FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line FROM documents))
WHERE line <> '' AND NOT regexp_matches(line, '^\d+$') GROUP BY doc_id""")
def kept_lines(spark, d):
    from loreloom.operators.rule_chunks import kept_lines as operator

    lines = operator(texts(spark, d, "documents", "doc_id", "text"), ["doc_id"], "text")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("NRM-3", r"""
SELECT item_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g') || CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' 노드락 클램프 Nord-Lock 너트 체결 풀림 방지' WHEN 2 THEN ' 배기 파이프 방화벽' ELSE ' 심사규정 AB' END) AS query,
  true AS stable FROM benchmark""")
def normalized_queries(spark, d):
    b = table(spark, d, "benchmark")
    once = cl.normalize_query(with_ends("item_id", QUERY_ENDS))
    return b.select("item_id", once.alias("query"), (cl.normalize_query(once) == once).alias("stable"))


@query("NRM-4 NRM-5 NRM-6", """
SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(replace(lower(trim(p_name)), ' ', '-'), '_', '-'), '[^a-z0-9가-힣-]', '-', 'g'), '-+', '-', 'g'), '-') AS slug,
       CASE WHEN lower(p_name) LIKE '%formula%' THEN 'formula' WHEN lower(p_name) LIKE '%baja%' THEN 'baja' ELSE 'other' END AS competition,
       CASE p_size % 3 WHEN 0 THEN 'vehicle-technical' WHEN 1 THEN 'judging' ELSE 'other' END AS document_type
FROM part""")
def slugs(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", tx.slug("p_name").alias("slug"), cl.normalize_competition(F.col("p_name")).alias("competition"),
        cl.normalize_document_type(F.when(F.col("p_size") % 3 == 0, "Vehicle Technical").when(F.col("p_size") % 3 == 1, " Judging ").otherwise(F.col("p_type"))).alias("document_type"))


@query("NRM-4 NRM-5", """
SELECT source, CASE WHEN raw IN ('src1', 'src2') THEN raw WHEN raw = 'src_03' THEN 'src3' WHEN raw LIKE '%src1%' THEN 'teens' ELSE 'other' END AS family,
       CAST(count(*) AS BIGINT) AS docs
FROM (SELECT source, regexp_replace(lower(trim(source)), '\\s+', '_', 'g') AS raw FROM documents) GROUP BY ALL""")
def source_families(spark, d):
    family = cl.normalize_competition(F.col("source"), keys=("src1", "src2"), aliases={"src_03": "src3"},
                                      substrings=(("src1", "teens"),))
    return table(spark, d, "documents").select("source", family.alias("family")).groupBy("source", "family").agg(
        F.count("*").alias("docs"))


@query("NRM-7", r"""
SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(trim(regexp_replace(regexp_replace(url, '[\\/:*?"<>|]+', '_', 'g'), '\s+', ' ', 'g')), '^\.+|\.+$', '', 'g')), 1, 40), ''), 'rule') AS name
FROM pages""")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", tx.safe_path_component("url", 40).alias("name"))


@query("CLS-1 CLS-2", r"""
SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])(les|des|une)([^\p{L}\p{N}_]|$)') THEN 'french' WHEN regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])(der|und|nicht)([^\p{L}\p{N}_]|$)') THEN 'german'
  WHEN regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])(los|que|para)([^\p{L}\p{N}_]|$)') THEN 'spanish' WHEN regexp_matches(t, '(?i)@|https?:') THEN 'contact'
  WHEN regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])(the|and)([^\p{L}\p{N}_]|$)') THEN 'english' ELSE 'other' END AS topic,
  CASE WHEN regexp_matches(t, '(?i)smart[- ]?e') THEN 'smart_e_mobility' WHEN regexp_matches(t, '(?i)e[- ]?formula') THEN 'e_formula'
       WHEN regexp_matches(t, '(?i)\bbaja\b') THEN 'baja' WHEN regexp_matches(t, '(?i)formula') THEN 'formula' WHEN regexp_matches(t, '(?i)ev') THEN 'ev' ELSE 'other' END AS competition,
  CASE WHEN regexp_matches(t, '(?i)vehicle.*technical') THEN 'vehicle-technical' WHEN regexp_matches(t, 'event.*operation|operations?') THEN 'event-operation'
       WHEN regexp_matches(t, '(?i)judge') THEN 'judging' ELSE 'other' END AS document_type
FROM (SELECT doc_id, concat_ws(' ', nullif(text, ''), nullif(source, '')) AS t FROM documents)""")
def classified_documents(spark, d):
    docs = texts(spark, d, "documents", "doc_id", "text", "source")
    both = F.concat_ws(" ", tx.non_empty("text"), tx.non_empty("source"))
    competition, document_type = cl.classify_document(F.col("text"), F.col("source"))
    return docs.select("doc_id", cl.first_match(both, TOPIC_RULES, "other").alias("topic"),
                       competition.alias("competition"), document_type.alias("document_type"))


@query("CLS-3", """
SELECT n_nationkey, n_name, coalesce(r.label, '기타') AS label FROM nation
LEFT JOIN (VALUES ('ASIA', 'East'), ('EUROPE', 'West')) r(name, label) ON r.name = (SELECT r_name FROM region WHERE r_regionkey = n_regionkey)""")
def region_labels(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    joined = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    return joined.select("n_nationkey", "n_name",
                         cl.lookup(F.col("r_name"), {"ASIA": "East", "EUROPE": "West"}, fixed.OTHER_LABEL).alias("label"))


@query("CLS-4", r"""
SELECT doc_id FROM documents WHERE NOT regexp_matches(concat_ws(' ', text, source), '(?i)제정\s*\(?\s*안|개정\s*\(?\s*안|규정안|copyright|licen[cs]e|lorem ipsum')""")
def without_drafts(spark, d):
    patterns = (*fixed.DRAFT_PATTERNS, "(?i)copyright|licen[cs]e", "(?i)lorem ipsum")
    return texts(spark, d, "documents", "doc_id", "text", "source").where(~cl.is_draft(F.col("text"), F.col("source"), patterns=patterns)).select("doc_id")


@query("CLS-5", r"""
SELECT o_orderkey, array_to_string(years, ',') AS years, coalesce(list_max(years), '2026') AS best, list_contains(years, '2000') AS is_target
FROM (SELECT o_orderkey, list_sort(list_distinct(regexp_extract_all(t, '20\d{2}'))) AS years
      FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 2000-' || o_orderpriority || CAST(o_orderkey AS VARCHAR) AS t FROM orders WHERE o_orderstatus <> 'P'
            UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderstatus = 'P'))""")
def order_years(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    t = F.when(F.col("o_orderstatus") == "P", day).otherwise(
        F.concat(day, F.lit(" 2000-"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")))
    return table(spark, d, "orders").select(
        "o_orderkey", F.array_join(tx.year_candidates(t), ",").alias("years"), tx.best_year(t, "2026").alias("best"),
        tx.is_target_year(t, "2000").alias("is_target"))


@query("KEY-1", r"""
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
       substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR) || '_0')) AS h FROM documents)""")
def point_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.point_id("doc_id", F.lit(0)).alias("point_id"))


@query("KEY-3", """
SELECT doc_id, 'rules-' || substr(sha1(source || ':' || CAST(doc_id AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR) || ':' || lang), 1, 12) AS section_id FROM documents""")
def section_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.section_id(
        "rules", F.col("source"), F.col("doc_id"), F.col("n_chars"), F.col("lang")).alias("section_id"))


@query("KEY-4 KEY-5", """
SELECT page_id, sha256(url) AS source_key, '2026-' || substr(sha1(CAST(page_id AS VARCHAR) || ':' || url || ':' || url || ':2026'), 1, 12) AS source_version,
       '2026+' || substr(sha256(url), 1, 12) AS default_version, sha256(html) AS content_key
FROM pages""")
def page_keys(spark, d):
    key = tx.source_key("url")
    return table(spark, d, "pages").select(
        "page_id", key.alias("source_key"),
        tx.source_version(F.col("page_id").cast("string"), F.col("url"), F.col("url"), F.lit("2026")).alias("source_version"),
        tx.default_source_version(key, F.lit("2026")).alias("default_version"), F.sha2("html", 256).alias("content_key"))


@query("SRC-5", """
SELECT doc_id, '2024-01-30+' || substr(sha256(text), 1, 12) AS source_version, sha256(text) AS sha256 FROM documents""")
def fingerprints(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.fingerprint(F.encode("text", "UTF-8"), F.lit("2024-01-30").cast("timestamp")).alias("source_version"),
        F.sha2("text", 256).alias("sha256"))


@query("CHK-1", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS tokens FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_count("text").alias("tokens"))


@query("UDF-2 CHK-2", r"""
SELECT doc_id, CAST(i AS BIGINT) AS start, substr(text, 4 * i + 1, 200) AS text FROM (
  SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 4.0) AS BIGINT) - 10, 1), 40)) AS i FROM documents WHERE text <> '')""")
def piece_windows(spark, d):
    """Windows of 50 sub-word tokens that start every 40."""
    windows = tx.token_windows(F.col("text"), 50, 40, tokenizer=tx.pieces(4))
    return texts(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(windows).alias("i", "text")).select(
        "doc_id", (F.col("i") * 40).cast("bigint").alias("start"), "text")


WINDOWS = r"""
SELECT doc_id, CAST(i AS BIGINT) AS start, array_to_string(t[i + 1:i + {size}], ' ') AS text
FROM (SELECT doc_id, t, unnest(range(0, {last}, {step})) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS t FROM documents)) """


def _windows(spark, d, size, step, **options):
    windows = tx.token_windows(F.col("text"), size, step, **options)
    w = texts(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(windows).alias("start", "text"))
    return w.withColumn("start", F.col("start").cast("bigint") * step)


@query("CHK-2", WINDOWS.format(size=384, step=309, last="CASE WHEN len(t) = 0 THEN 0 ELSE greatest(len(t) - 75, 1) END"))
def token_windows(spark, d):
    return _windows(spark, d, 384, 309)


@query("RUL-5", WINDOWS.format(size=200, step=136, last="len(t)"))
def token_windows_to_the_end(spark, d):
    return _windows(spark, d, 200, 136, to_the_end=True)


@query("KB-12", WINDOWS.format(size=300, step=300, last="len(t)"))
def token_windows_without_overlap(spark, d):
    return _windows(spark, d, 300, 300)


@query("CHK-6", r"""
SELECT doc_id, CASE WHEN len(t) > 100 THEN array_to_string(t[1:100], ' ') || ' ...' ELSE text END AS context
FROM (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS t FROM documents)""")
def question_contexts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.truncate_tokens("text", 100).alias("context"))


# Lines dressed as Markdown items, so that every mark occurs in the given texts.
DRESSED = r"""
lines AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, line FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM documents))),
dressed AS (SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN '**' || substr(line, 1, 8) || '** — ' || line WHEN 1 THEN line || ' `[단일제보]` <sub>출처: 2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || '</sub>'
   WHEN 2 THEN 'see `' || substr(line, 1, 20) || '` 2023-12-31 2024-01-01 2023-12-31 ' || substr(line, 21) ELSE line END AS line FROM lines)"""


def dressed_lines(spark, d):
    from pyspark.sql.functions import posexplode, split

    lines = table(spark, d, "documents").select("doc_id", posexplode(split("text", "\n")).alias("pos", "line"))
    line = F.col("line")
    note = F.concat(line, F.lit(" `[단일제보]` <sub>출처: 2024-01-"), F.lpad((1 + F.col("doc_id") % 28).cast("string"), 2, "0"), F.lit("</sub>"))
    code = F.concat(F.lit("see `"), tx.cut(line, 20), F.lit("` 2023-12-31 2024-01-01 2023-12-31 "), F.substring(line, F.lit(21), F.length(line)))
    label = F.concat(F.lit("**"), tx.cut(line, 8), F.lit("** — "), line)
    kind = F.col("pos") % 4
    return lines.select("doc_id", F.col("pos").cast("bigint").alias("pos"),
                        F.when(kind == 0, label).when(kind == 1, note).when(kind == 2, code).otherwise(line).alias("line"))


@query("KB-7 KB-8 KB-9", "WITH " + DRESSED.strip() + r""",
plain AS (SELECT doc_id, pos, line, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '<sub>\s*(?:출처:\s*)?(.*?)\s*</sub>', '출처: \1', 'g'), '`\[(합의됨|다수의견|단일제보|미해결)\]`', '(\1)', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '`([^`]*)`', '\1', 'g')) AS body FROM dressed)
SELECT doc_id, pos, body, regexp_replace(body, '(?s)\A(.{1,14}?)\s+—\s+(.*)\z', '\1: \2') AS labelled,
       array_to_string(list_sort(list_distinct(regexp_extract_all(line, '\d{4}-\d{2}-\d{2}'))), ',') AS dates FROM plain""")
def plain_lines(spark, d):
    return dressed_lines(spark, d).select(
        "doc_id", "pos", tx.strip_markup("line").alias("body"), tx.label_line("line").alias("labelled"),
        F.array_join(tx.iso_dates("line"), ",").alias("dates"))


@query("RUL-9", "SELECT doc_id, substr(trim(text, E' \\n'), 1, 4000) AS short, substr(trim(text, E' \\n'), 1, 20000) AS long FROM documents")
def capped_texts(spark, d):
    from loreloom.operators.rule_chunks import capped

    return table(spark, d, "documents").select("doc_id", capped(F.col("text"), 4000).alias("short"),
                                               capped(F.col("text"), 20000).alias("long"))


@query("RET-19 RET-20", r"""
SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[가-힣]{2,}|[a-z0-9_\-+]{2,}')), lambda x: x NOT IN ('the', 'and', '규정'))), ' ') AS terms,
       array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text || ' 제 ' || CAST(item_id AS VARCHAR) || ' 조 제' || CAST(item_id % 5 + 1 AS VARCHAR) || '장', '제\s*(\d+)\s*조', 1), lambda x: CAST(x AS BIGINT)))), ',') AS sections,
       CAST(item_id % 5 + 1 AS VARCHAR) AS chapters
FROM benchmark""")
def query_terms(spark, d):
    text = F.concat(F.col("text"), F.lit(" 제 "), F.col("item_id").cast("string"), F.lit(" 조 제"), (F.col("item_id") % 5 + 1).cast("string"), F.lit("장"))
    return table(spark, d, "benchmark").select(
        "item_id", F.array_join(F.array_sort(cl.query_terms(F.col("text"), ("the", "and", "규정"))), " ").alias("terms"),
        F.array_join(cl.references(text, fixed.SECTION_REFERENCE), ",").alias("sections"),
        F.array_join(cl.references(text, fixed.CHAPTER_REFERENCE), ",").alias("chapters"))


@query("CLS-6 CNV-6", r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?i)e[- ]?formula') THEN 'e_formula' WHEN regexp_matches(t, '(?i)formula') THEN 'formula' WHEN regexp_matches(t, '(?i)baja') THEN 'baja'
    WHEN regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])ev([^\p{L}\p{N}_]|$)|electric\s+vehicle') THEN 'ev' END AS competition,
  CASE WHEN regexp_matches(t, '(?i)vehicle.*technical') THEN NULL WHEN regexp_matches(t, '(?i)competition.*rule|operating.*rule') THEN 'competition-rules' WHEN regexp_matches(t, 'event.*operation|operations?') THEN 'event-operation'
    WHEN regexp_matches(t, '(?i)judge') THEN 'judging' WHEN regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])(glvs|bms)([^\p{L}\p{N}_]|$)') THEN 'vehicle-technical' END AS document_type, CAST(CASE turn % 4 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS content_words
FROM (SELECT conv_id, turn, text AS t FROM conversations WHERE role = 'user')""")
def query_hints(spark, d):
    q = table(spark, d, "conversations").where(F.col("role") == "user")
    text = F.col("text")
    return q.select("conv_id", "turn", cl.detect_competition(text).alias("competition"),
                    cl.query_document_type(text).alias("document_type"),
                    F.size(cl.preserved_words(F.when(F.col("turn") % 4 == 2, F.concat(text, F.lit(" 구름을 바다는 구름 다시"))).otherwise(text))).cast("bigint").alias("content_words"))


@query("CNV-5", "SELECT conv_id, turn, turn % 4 <> 2 AS same FROM conversations WHERE role = 'user'")
def preserved_identifiers(spark, d):
    """A rewrite that only adds words keeps every identifier; one that loses the code does not."""
    q = table(spark, d, "conversations").where(F.col("role") == "user")
    asked = F.concat(F.lit("part QX-4071 "), F.col("text"))
    rewritten = F.when(F.col("turn") % 4 == 2, F.concat(F.lit("part "), F.col("text"))).otherwise(F.concat(F.lit("more "), asked))
    return q.select("conv_id", "turn", cl.preserves_identifiers(asked, rewritten).alias("same"))
