"""Boards of questions and replies: pages, attachment, answers, incremental selection, merge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreloom.operators import board, ordered, pages, qna_chunks as qna
from loreloom.functions import text as tx
from loreloom.plans.registry import query, table, texts

SEPARATOR = "===== 원 글 ====="

# A conversation is a board: user turns are questions, the others replies that may quote a text.
ROWS = """
rows AS (
  SELECT conv_id AS board, turn AS pos, conv_id * 1000 + turn AS number, role <> 'user' AS is_reply,
         CASE WHEN role = 'assistant' THEN text || E'\\n=========== 원 글 ===========\\nquoted' ELSE text END AS body
  FROM conversations),
linked AS (
  SELECT *, last_value(CASE WHEN NOT is_reply THEN number END IGNORE NULLS) OVER (
      PARTITION BY board ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent FROM rows)
"""


def board_rows(spark, d):
    c = table(spark, d, "conversations")
    quoted = F.concat("text", F.lit("\n=========== 원 글 ===========\nquoted"))
    return c.select(
        F.col("conv_id").alias("board"), F.col("turn").alias("pos"), (F.col("conv_id") * 1000 + F.col("turn")).alias("number"),
        (F.col("role") != "user").alias("is_reply"),
        F.when(F.col("role") == "assistant", quoted).otherwise(F.col("text")).alias("body"))


@query("WEB-9", "WITH " + ROWS + "SELECT board, pos, number, parent FROM linked")
def replies_attached(spark, d):
    return board.attach_parent(board_rows(spark, d), block=4).select("board", "pos", "number", "parent")


def answers(spark, d):
    linked = board.attach_parent(board_rows(spark, d))
    replies = linked.where(F.col("is_reply") & F.col("parent").isNotNull())
    link = F.concat(F.lit("https://board.example/?number="), F.col("number").cast("string"))
    return board.answers_of(replies, keys=["board", "parent"], position="pos", url=link)


ANSWERS = r"""
answers AS (
  SELECT board, parent, pos, answer_body, 'https://board.example/?number=' || CAST(number AS VARCHAR) AS answer_url,
         row_number() OVER (PARTITION BY board, parent ORDER BY pos) - 1 AS answer_pos
  FROM (SELECT *, trim(regexp_replace(regexp_replace(string_split_regex(body, '={10,}\s*원\s*글\s*={10,}')[1], '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), E' \n') AS answer_body
        FROM linked WHERE is_reply AND parent IS NOT NULL) WHERE answer_body <> '')
"""


@query("WEB-10", "WITH " + ROWS + "," + ANSWERS + "SELECT board, parent, answer_pos, answer_body, answer_url FROM answers")
def answers_in_order(spark, d):
    return answers(spark, d).select("board", "parent", "answer_pos", "answer_body", "answer_url")


@query("WEB-10", "WITH " + ROWS + "," + ANSWERS + """
SELECT board, parent, CAST(count(*) AS BIGINT) AS n, string_agg(answer_body, E'\\n~\\n' ORDER BY answer_pos) AS bodies FROM answers GROUP BY board, parent""")
def answers_nested(spark, d):
    nested = board.nest_answers(answers(spark, d), ["board", "parent"])
    return nested.select("board", "parent", F.size("answers").cast("bigint").alias("n"),
                         F.array_join(F.transform("answers", lambda a: a["body"]), "\n~\n").alias("bodies"))


@query("WEB-8", "WITH " + ROWS + """
SELECT board, pos, number FROM linked WHERE (board, parent) IN (
  SELECT board, number FROM linked WHERE NOT is_reply AND board * 2 NOT IN (SELECT doc_id FROM labels))""")
def incremental_rows(spark, d):
    rows = board_rows(spark, d).withColumn("id", F.col("board") * 2)
    stored = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return board.new_questions(rows, stored).select("board", "pos", "number")


@query("WEB-7", """
SELECT doc_id, 'held' AS origin FROM labels UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def accumulated_ids(spark, d):
    held = table(spark, d, "labels").select("doc_id", F.lit("held").alias("origin"))
    return board.accumulate(held, table(spark, d, "documents").select("doc_id", F.lit("new").alias("origin")), ["doc_id"])


@query("WEB-11", """
WITH old AS (SELECT source AS id, min(doc_id) AS doc_id, 'old' AS version FROM documents WHERE lang = 'de' GROUP BY source),
     new AS (SELECT source || coalesce(CAST(quality AS VARCHAR), '') AS id, min(doc_id) AS doc_id, 'new' AS version FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)""")
def merged_posts(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    old = docs.where(F.col("lang") == "de").groupBy(F.col("source").alias("id")).agg(F.min("doc_id").alias("doc_id")).withColumn("version", F.lit("old"))
    new = docs.join(labels, "doc_id", "left").select(
        F.concat("source", F.coalesce(F.col("quality").cast("string"), F.lit(""))).alias("id"), "doc_id", F.lit("new").alias("version"))
    return board.merge_posts(old, new, ["id"], [F.col("doc_id")])


@query("WEB-12", """
SELECT doc_id, quality, 'detail' AS outcome FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, NULL, 'failed' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def detail_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    ok, failed = board.split_details(docs, table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])
    return ok.withColumn("outcome", F.lit("detail")).unionByName(
        failed.withColumn("quality", F.lit(None).cast("int")).withColumn("outcome", F.lit("failed")))


@query("SNK-6", """
SELECT '2024-01-30' AS crawled_at, CAST(count(quality) AS BIGINT) AS total_count, CAST(count(*) - count(quality) AS BIGINT) AS failed_count
FROM documents LEFT JOIN labels USING (doc_id)""")
def run_summary(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return board.crawl_summary(rows, failed=F.col("quality").isNull(), at=F.lit("2024-01-30"))


@query("SNK-6", "SELECT doc_id AS failed_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def run_failures(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return board.failed_keys(rows, failed=F.col("quality").isNull(), key="doc_id")


@query("WEB-13", r"""
SELECT source_key, doc_id, title, source_filename, date FROM (
  SELECT sha256(source || lang) AS source_key, doc_id, text AS title, source AS source_filename, '2024' AS date,
         row_number() OVER (PARTITION BY sha256(source || lang) ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1""")
def manifest_once(spark, d):
    items = table(spark, d, "documents").select(
        F.sha2(F.concat("source", "lang"), 256).alias("source_key"), "doc_id", F.col("text").alias("title"),
        F.col("source").alias("source_filename"), F.lit("2024").alias("date"))
    return board.dedupe_manifest(items, "2024", order=[F.col("doc_id")])


# Comments, scripts and styles become tags, then texts lie between tags; the references that the pages use are resolved.
UNESCAPED = "{0}"
for _name, _char in (("copy", "©"), ("middot", "·"), ("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''")):
    UNESCAPED = f"replace({UNESCAPED}, '&{_name};', '{_char}')"
UNESCAPED = f"regexp_replace({UNESCAPED}, '&amp;?', '&', 'g')"  # titles can be cut inside a reference


@query("WEB-1 UDF-4", rf"""
WITH visible AS (SELECT page_id, html, string_split_regex(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '<c>', 'g'), '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', '<c>', 'g'), '<[^>]*>') AS parts FROM pages),
lines AS (SELECT page_id, html, array_to_string(list_filter(list_transform(parts, lambda x: trim({UNESCAPED.format('x')}, E' \n\t\r')), lambda x: x <> ''), E'\n') AS text FROM visible)
SELECT page_id, trim({UNESCAPED.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, E' \n\t\r') AS title,
  trim(regexp_replace(regexp_replace(text, '[ \t\r]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), E' \n\t\r') AS text, CAST(len(regexp_extract_all(html, '(?i)<a[\s>]')) AS BIGINT) AS links FROM lines""")
def page_outlines(spark, d):
    return pages.page_text(texts(spark, d, "pages", "page_id", "html"))


@query("WEB-4", r"""
SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, href[i] AS href FROM (
  SELECT page_id, href, unnest(range(1, len(href) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS href FROM pages))""")
def page_links(spark, d):
    return pages.page_links(texts(spark, d, "pages", "page_id", "html")).select("page_id", "pos", "href")


# The saved pages hold no board tables. Board pages are a table with the page's own title, and the whole page below it.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
TITLE_SQL = r"replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"


def page_title() -> Column:
    return F.regexp_extract("html", TITLE, 1)


def saved_list_pages(spark, d):
    p = table(spark, d, "pages")
    number = F.col("page_id").cast("string")
    row = F.concat(
        F.lit("<table><tr><th>no</th></tr><tr><td>"), number, F.lit("</td><td>EV</td><td>"),
        F.when(F.col("url").startswith("https"), F.lit('<img src="/i/bl_reply.png">')).otherwise(""),
        F.lit('<a href="?number='), F.col("page_id") * 10, F.lit('&mode=view">'), F.lit("Post "), number, F.lit(" "), page_title(), F.lit("</a></td><td>Ann</td><td></td><td>1,"),
        F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"), F.lit("</td><td>2024-01-02<tr><td>x</td></tr></table>"), F.col("html"))
    return p.select("page_id", row.alias("html"))


@query("WEB-1", r"""
SELECT page_id, page_id AS id, page_id * 10 AS number, 'EV' AS category, trim('Post ' || CAST(page_id AS VARCHAR) || ' ' || """ + TITLE_SQL + r""") AS title,
       1000 + page_id % 1000 AS views, '2024-01-02' AS date, '/bbs/?number=' || CAST(page_id * 10 AS VARCHAR) || '&mode=view' AS detail_url,
       url LIKE 'https%' AS is_reply FROM pages""")
def list_page_rows(spark, d):
    return pages.list_rows(saved_list_pages(spark, d)).select(
        "page_id", "id", "number", "category", "title", "views", "date", "detail_url", "is_reply")


@query("WEB-2", r"""
SELECT page_id, trim('Post ' || url || ' ' || """ + TITLE_SQL + r""") AS title, 12345 AS views, 'first' || E'\n' || CAST(page_id AS VARCHAR) AS body, 'https://s.example/f/' || CAST(page_id AS VARCHAR) || '.pdf' AS attachment, CAST(NULL AS VARCHAR) AS error
FROM pages WHERE url LIKE 'https%'
UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, 'no detail table' FROM pages WHERE url NOT LIKE 'https%'""")
def detail_pages(spark, d):
    p = table(spark, d, "pages")
    made = F.concat(
        F.lit('<table class="tblDef"><tr><td class="bg">Post '), F.col("url"), F.lit(" "), page_title(),
        F.lit("</td></tr><tr><th>by</th><td>Ann</td><th>on</th><td>2024-01-02</td><th>hits</th><td>12,345</td></tr>"
              '<tr><td class="con"> first<br>'), F.col("page_id"),
        F.lit('</td></tr><tr><th class="th">첨부파일</th><td><a href="/f/'), F.col("page_id"), F.lit('.pdf">file</a></td></tr></table>'), F.col("html"))
    html = F.when(F.col("url").startswith("https"), made).otherwise(F.col("html"))
    rows = pages.details(p.select("page_id", html.alias("html")), base="https://s.example")
    return rows.select("page_id", "title", F.col("views").cast("int").alias("views"), "body", F.col("attachments")[0].alias("attachment"), "error")


@query("WEB-3 CLS-2 CLS-4 KEY-4", r"""
WITH links AS (SELECT page_id, page_id * 10 AS source_post_id, '2024 Formula judge ' || CAST(page_id AS VARCHAR) AS title, i,
   'https://s.example/func/download.php?filename=f' || CAST(page_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS source_url,
   CASE WHEN i = 0 THEN 'icon ' || CAST(page_id AS VARCHAR) || '.pdf' ELSE 'f' || CAST(page_id AS VARCHAR) || '-1.pdf' END AS source_filename
  FROM pages, (VALUES (0), (1)) v(i))
SELECT page_id, source_post_id, title, source_url, source_filename, 'formula' AS competition, 'judging' AS document_type, '2024' AS year, sha256(source_url) AS source_key,
  '2024-' || substr(sha1(CAST(source_post_id AS VARCHAR) || ':' || title || ':' || source_url || ':2024'), 1, 12) AS source_version FROM links""")
def manifest_from_pages(spark, d):
    n = F.col("page_id").cast("string")
    row = F.concat(
        F.lit("<table><tr><td>1</td><td><a href='/bbs/?number="), F.col("page_id") * 10, F.lit("'>2024 Formula  judge "), n,
        F.lit('</a></td><td><a href="/func/download.php?filename=f'), n, F.lit('-0"><img src="x.gif" alt="icon '), n,
        F.lit('.pdf"></a><a href="/func/download.php?filename=f'), n, F.lit("-1\">get</a></td><td>Ann</td><td>2023-12-01</td></tr>"
              "<tr><td>2</td><td><a href='/bbs/?number=5'>규정 개정(안) 2024</a></td><td><a href='/func/download.php?filename=d'>get</a></td><td>Ann</td><td>2024</td></tr></table>"), F.col("html"))
    items = pages.manifest_items(table(spark, d, "pages").select("page_id", row.alias("html")), base="https://s.example", default_year="2020")
    title = F.regexp_replace("title", " +", " ")
    return items.select("page_id", "source_post_id", title.alias("title"), "source_url", "source_filename", "competition", "document_type", "year", "source_key",
                        tx.source_version(F.col("source_post_id").cast("string"), title, F.col("source_url"), F.col("year")).alias("source_version"))
