"""Documents -> chunks: the three chunkers over the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators import markdown_chunks as md, qna_chunks as qna, rule_chunks as rules
from loreloom.plans.registry import query, table, texts

COUNT = r"len(regexp_extract_all({x}, '\S+'))"

# Packing in SQL over a view of documents: paragraphs; sentences (their ends become line ends) of
# paragraphs over the budget; token windows of sentences over it; then one reduction per document.
PACKING = r"""
paragraphs AS (
  SELECT {keys}, pp, trim(para, E' \n') AS para FROM (SELECT {keys}, unnest(p) AS para, generate_subscripts(p, 1) AS pp FROM (
    SELECT {keys}, string_split_regex(text, '\n\s*\n') AS p FROM {docs} WHERE len(regexp_extract_all(text, '\S+')) > {least}))),
pieces AS (
  SELECT {keys}, pp, sp, trim(piece, E' \n') AS piece FROM (SELECT {keys}, pp, unnest(l) AS piece, generate_subscripts(l, 1) AS sp FROM (
    SELECT {keys}, pp, CASE WHEN len(regexp_extract_all(para, '\S+')) <= {size} THEN [para]
      ELSE string_split(regexp_replace(para, '([.!?。])\s+', E'\\1\n', 'g'), E'\n') END AS l FROM paragraphs WHERE para <> ''))),
segments AS (
  SELECT {keys}, pp, sp, i, CASE WHEN len(t) <= {size} THEN piece ELSE array_to_string(t[i + 1:i + {size}], ' ') END AS segment FROM (
    SELECT {keys}, pp, sp, piece, t, unnest(range(0, CASE WHEN len(t) <= {size} THEN 1 ELSE len(t) - {overlap} END, {size} - {overlap})) AS i FROM (
      SELECT {keys}, pp, sp, piece, regexp_extract_all(piece, '\S+') AS t FROM pieces WHERE piece <> ''))),
lists AS (
  SELECT {keys}, list({{done: CAST([] AS VARCHAR[]), cur: segment, n: len(regexp_extract_all(segment, '\S+'))}} ORDER BY pp, sp, i) AS l FROM segments GROUP BY {keys}),
packed AS (
  SELECT {keys}, list_reduce(l, lambda a, x:
    CASE WHEN a.n + x.n > {size}
         THEN {{done: list_append(a.done, a.cur),
               cur: CASE WHEN a.n >= {overlap} THEN array_to_string(regexp_extract_all(a.cur, '\S+')[-{overlap}:], ' ') ELSE a.cur END || E'\n' || x.cur, n: least(a.n, {overlap}) + x.n}}
         ELSE {{done: a.done, cur: a.cur || E'\n' || x.cur, n: a.n + x.n}} END) AS r FROM lists),
chunks AS (
  SELECT {keys}, list_append(r.done, r.cur) AS c FROM packed
  UNION ALL SELECT {keys}, [text] FROM {docs} WHERE len(regexp_extract_all(text, '\S+')) <= {size}),
exploded AS (SELECT {keys}, generate_subscripts(c, 1) - 1 AS chunk_index, unnest(c) AS text FROM chunks)
"""
SEGMENTS = PACKING.format(keys="doc_id", docs="documents", size=384, overlap=75, least=384)


def document_chunks(spark, d):
    return qna.chunk_documents(texts(spark, d, "documents", "doc_id", "text"), "text")


@query("CHK-3 CHK-4 CHK-5", "WITH " + SEGMENTS + "SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, text FROM exploded")
def packed_chunks(spark, d):
    return document_chunks(spark, d)


SLICED = PACKING.format(keys="doc_id", docs="documents", size=40, overlap=8, least=-1).split("segments AS (")[0]


@query("RUL-6", "WITH " + SLICED + r"""slices AS (
  SELECT doc_id, pp, sp, i, CASE WHEN len(regexp_extract_all(piece, '\S+')) <= 40 THEN piece ELSE substr(piece, i * 120 + 1, 120) END AS segment
  FROM (SELECT *, unnest(range(0, CASE WHEN len(regexp_extract_all(piece, '\S+')) <= 40 THEN 1 ELSE CAST(ceil(length(piece) / 120.0) AS BIGINT) END)) AS i FROM pieces WHERE piece <> ''))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pp, sp, i) - 1 AS i, segment FROM slices""")
def sliced_segments(spark, d):
    """Segments where words are counted but no tokens are given: long sentences are cut after so many characters."""
    docs = texts(spark, d, "documents", "doc_id", "text")
    cut = qna.segments(F.col("text"), size=40, overlap=8, tokenizer=tx.COUNTS, slice_chars=120)
    return docs.select("doc_id", F.posexplode(cut).alias("i", "segment")).withColumn("i", F.col("i").cast("bigint"))


def _in_runs() -> str:
    """The SQL of the packing with runs of four characters for tokens: counts do not add up, so every joined text is counted again."""
    runs, joined = r"(?s).{{1,4}}", "a.cur || E'\\n' || x.cur"
    sql = PACKING.replace(r"'\S+'", f"'{runs}'").replace("], ' ')", "], '')")
    tail = f"CASE WHEN a.n >= {{overlap}} THEN array_to_string(regexp_extract_all(a.cur, '{runs}')[-{{overlap}}:], '') ELSE a.cur END || E'\\n' || x.cur"
    sql = sql.replace("n: least(a.n, {overlap}) + x.n", f"n: CAST(ceil(length({tail}) / 4.0) AS BIGINT)")
    sql = sql.replace(f"cur: {joined}, n: a.n + x.n", f"cur: trim({joined}, E' \\n'), n: CAST(ceil(length(trim({joined}, E' \\n')) / 4.0) AS BIGINT)")
    return sql.format(keys="doc_id", docs="documents", size=96, overlap=20, least=96)


@query("CHK-3 CHK-4 CHK-5 UDF-2", "WITH " + _in_runs() + "SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, text FROM exploded")
def chunks_of_runs(spark, d):
    """Packing by a tokenizer whose counts do not add up."""
    return qna.chunk_documents(texts(spark, d, "documents", "doc_id", "text"), "text", size=96, overlap=20, tokenizer=tx.pieces(4))


@query("CHK-11", "WITH " + SEGMENTS + r"""
SELECT CAST(count(*) AS BIGINT) AS chunks, round(avg(n), 6) AS avg_tokens, CAST(min(n) AS BIGINT) AS min_tokens, CAST(max(n) AS BIGINT) AS max_tokens,
       CAST(count(*) FILTER (n > 384) AS BIGINT) AS oversize FROM (SELECT len(regexp_extract_all(text, '\S+')) AS n FROM exploded)""")
def chunk_statistics(spark, d):
    return qna.chunk_stats(document_chunks(spark, d)).withColumn("avg_tokens", F.round("avg_tokens", 6))


# Answers of a conversation: every assistant turn answers the user turn above it.
ANSWER_DOCS = r"""
linked AS (
  SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent FROM conversations),
pairs AS (
  SELECT a.conv_id, a.parent, a.turn, q.text AS question, a.text AS answer, regexp_extract_all(q.text, '\S+') AS t
  FROM linked a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.parent WHERE a.role = 'assistant'),
docs AS (
  SELECT conv_id, parent, turn, '[질문] ' || 'conversation ' || CAST(conv_id AS VARCHAR) || E'\n' ||
         CASE WHEN len(t) > 100 THEN array_to_string(t[1:100], ' ') || ' ...' ELSE question END || E'\n\n[답변]\n' || answer AS text FROM pairs)
"""


def answered_turns(spark, d):
    from loreloom.operators import board

    c = table(spark, d, "conversations").withColumn("is_reply", F.col("role") != "user")
    linked = board.attach_parent(c, board="conv_id", position="turn", number="turn", out="parent")
    questions = c.where(~F.col("is_reply")).select("conv_id", F.col("turn").alias("parent"), F.col("text").alias("question"))
    replies = linked.where(F.col("role") == "assistant").select("conv_id", "parent", "turn", F.col("text").alias("answer"))
    return replies.join(questions, ["conv_id", "parent"])


def title_of_conversation():
    return F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))


@query("CHK-7 CHK-6", "WITH " + ANSWER_DOCS + "SELECT conv_id, parent, turn, text FROM docs")
def answer_documents(spark, d):
    text = qna.answer_document(title_of_conversation(), qna.question_context(F.col("question")), F.col("answer"))
    return answered_turns(spark, d).select("conv_id", "parent", "turn", text.alias("text"))


@query("CHK-10 CHK-7", "WITH " + ANSWER_DOCS + r""",
sized AS (SELECT conv_id, parent, turn, CAST(greatest(1, ceil((len(regexp_extract_all(text, '\S+')) - 384) / 309.0) + 1) AS BIGINT) AS n FROM docs)
SELECT conv_id, turn, CAST(i AS BIGINT) + coalesce(CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS chunk_index
FROM sized, LATERAL (SELECT unnest(range(0, n)) AS i)""")
def running_chunk_index(spark, d):
    # Windows stand in for packing here, so that the index itself can be checked in SQL.
    text = qna.answer_document(title_of_conversation(), qna.question_context(F.col("question")), F.col("answer"))
    made = answered_turns(spark, d).withColumn("windows", tx.token_windows(text, 384, 309))
    from loreloom.operators import ordered

    offset = ordered.running_sum(made, ["conv_id"], "turn", F.size("windows").cast("bigint"), "offset", inclusive=False, block=3)
    return offset.select("conv_id", "turn", "offset", F.posexplode("windows").alias("i", "t")).select(
        "conv_id", "turn", (F.col("offset") + F.col("i")).alias("chunk_index"))


@query("CHK-7 CHK-10 CHK-3 CHK-4", "WITH " + ANSWER_DOCS + "," + PACKING.format(keys="conv_id, parent, turn", docs="docs", size=128, overlap=32, least=128) + """
SELECT conv_id, parent, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, chunk_index) - 1 AS chunk_index, text FROM exploded""")
def answer_chunks(spark, d):
    rows = answered_turns(spark, d)
    return qna.chunk_answers(rows, keys=["conv_id"], position="turn", title=title_of_conversation(),
                             context=qna.question_context(F.col("question")), answer=F.col("answer"), size=128, overlap=32).select(
        "conv_id", "parent", "turn", "chunk_index", "text")


@query("CHK-8", r"""
SELECT conv_id, turn, concat_ws(E'\n\n', nullif(CASE WHEN role = 'user' THEN role ELSE '' END, ''), nullif(text, '')) AS text FROM conversations""")
def question_documents(spark, d):
    title = F.when(F.col("role") == "user", F.col("role")).otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", qna.question_document(title, F.col("text")).alias("text"))


POST_DOCS = r"""
posts AS (SELECT d.doc_id, d.text AS body, substr(d.text, 1, 60) AS title, d.lang, d.source, l.quality, l.toxic, regexp_extract_all(d.text, '\S+') AS t FROM documents d LEFT JOIN labels l USING (doc_id)),
answered AS (
  SELECT doc_id, 0 AS pos, 'u1' AS url, body AS answer FROM posts WHERE quality = 1 UNION ALL SELECT doc_id, 1, 'u2', source FROM posts WHERE quality = 1
  UNION ALL SELECT doc_id, 0, 'https://board.example/' || CAST(doc_id AS VARCHAR), body FROM posts WHERE coalesce(quality, 0) <> 1 AND toxic = 0),
docs AS (
  SELECT doc_id, pos, url, true AS has_answer, '[질문] ' || title || E'\n' || CASE WHEN len(t) > 100 THEN array_to_string(t[1:100], ' ') || ' ...' ELSE body END || E'\n\n[답변]\n' || answer AS text FROM answered JOIN posts USING (doc_id)
  UNION ALL SELECT doc_id, 0, 'https://board.example/' || CAST(doc_id AS VARCHAR), false, title || E'\n\n' || body FROM posts WHERE doc_id NOT IN (SELECT doc_id FROM answered))
"""


@query("CHK-5 CHK-7 CHK-8 CHK-9 CHK-10 SRC-1", "WITH " + POST_DOCS + "," + PACKING.format(keys="doc_id, pos, url, has_answer", docs="docs", size=384, overlap=75, least=384) + """
SELECT CAST(doc_id AS VARCHAR) AS post_id, lang AS category, title, '2024-01-02' AS date, url, has_answer, row_number() OVER (PARTITION BY doc_id ORDER BY pos, chunk_index) - 1 AS chunk_index, e.text AS text
FROM exploded e JOIN posts USING (doc_id)""")
def post_chunks(spark, d):
    """Nested posts: a document is a question, the text of its label row a legacy answer."""
    docs, labels = texts(spark, d, "documents", "doc_id", "lang", "source", "text"), table(spark, d, "labels")
    posts = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("category"), tx.cut("text", 60).alias("title"), F.lit("2024-01-02").alias("date"),
        F.concat(F.lit("https://board.example/"), F.col("doc_id")).alias("url"), F.col("text").alias("question_body"),
        F.when(F.col("quality") == 1, F.array(F.struct(F.col("text").alias("body"), F.lit("u1").alias("url")),
                                              F.struct(F.col("source").alias("body"), F.lit("u2").alias("url")))).alias("answers"),
        F.when(F.col("toxic") == 0, F.col("text")).alias("answer_body"))
    return qna.chunk_posts(posts)


# Markdown made of the given lines: shape by line number, text as it is.
def markdown_documents(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(
        F.when(i % 11 == 0, F.concat(F.lit("## "), (i / 11 + 1).cast("int"), F.lit(". "), tx.cut(x, 12), F.lit(" 장\n### "), tx.cut(x, 20), F.lit("\n- **주제** `[다수의견]` "), tx.cut(x, 30), F.lit("\n  - **쟁점** — 2024-01-03 "), x))
        .when(i % 11 < 3, F.concat(F.lit("  - **결론** — 2024-01-02 "), x)).when(i % 11 == 3, F.concat(F.lit("#### "), tx.cut(x, 10), F.lit("\n| a | b |\n|---|---|\n| "), F.translate(x, "|", " "), F.lit(" | 0 |")))
        .when(i % 11 < 6, F.concat(F.lit("| "), F.translate(x, "|", " "), F.lit(" | 1 |"))).when(i % 11 == 6, F.concat(F.lit("**단편**\n- "), x, F.lit(" (2023-05-06)")))
        .when(i % 11 == 7, F.concat(F.lit("- "), x)).when(i % 11 == 8, F.concat(F.lit("\n> "), x)).otherwise(x)))
    return texts(spark, d, "documents", "doc_id", "text").select("doc_id", F.array_join(lines, "\n").alias("text"))


MARKDOWN = r"""
md AS (
  SELECT doc_id, (i - 1) AS n, x FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM documents)))
"""


@query("KB-1", "WITH " + MARKDOWN + r"""
SELECT doc_id, shape, CAST(count(*) AS BIGINT) AS lines FROM (
  SELECT doc_id, unnest(CASE WHEN n % 11 = 0 THEN ['chapter', 'section', 'bullet', 'nested'] WHEN n % 11 < 3 THEN ['nested'] WHEN n % 11 = 3 THEN ['subhead', 'table', 'table', 'table']
     WHEN n % 11 < 6 THEN ['table'] WHEN n % 11 = 6 THEN ['bold', 'bullet'] WHEN n % 11 = 7 THEN ['bullet'] WHEN n % 11 = 8 THEN ['blank', 'prose'] ELSE ['prose'] END) AS shape
  FROM md) GROUP BY ALL""")
def markdown_shapes(spark, d):
    lines = md.classify_lines(markdown_documents(spark, d), ["doc_id"], "text")
    # Empty texts after a mark and list-like lines of the data keep their real shape.
    return lines.groupBy("doc_id", "shape").agg(F.count("*").alias("lines"))


# What the scheme of markdown_documents() must yield, told from the line numbers instead of the marks.
PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<sub>\s*(?:출처:\s*)?(.*?)\s*</sub>', '출처: \1', 'g'), '`\[(합의됨|다수의견|단일제보|미해결)\]`', '(\1)', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '`([^`]*)`', '\1', 'g'))"
BLOCKS = MARKDOWN + r""",
sized AS (SELECT *, n // 11 AS cycle, n % 11 AS k, max(n) OVER (PARTITION BY doc_id) AS last FROM md),
heads AS (SELECT doc_id, cycle, cycle + 1 AS chapter_num, ltrim(substr(x, 1, 12)) || ' 장' AS chapter, trim(substr(x, 1, 20)) AS section, substr(x, 1, 30) AS t FROM sized WHERE k = 0),
parts AS (
  SELECT doc_id, cycle, 0 AS part, 'topic' AS kind, n, '결론: 2024-01-02 ' || x AS line, '2024-01-02' AS date, 0 AS sub FROM sized WHERE k IN (1, 2)
  UNION ALL SELECT doc_id, cycle, 0, 'topic', n, '쟁점: 2024-01-03 ' || x, '2024-01-03', 0 FROM sized WHERE k = 0
  UNION ALL SELECT doc_id, cycle, 1, 'table', n, unnest(['| a | b |', '|---|---|', '| ' || replace(x, '|', ' ') || ' | 0 |']), NULL, unnest([0, 1, 2]) FROM sized WHERE k = 3
  UNION ALL SELECT doc_id, cycle, 1, 'table', n, '| ' || replace(x, '|', ' ') || ' | 1 |', NULL, 0 FROM sized WHERE k IN (4, 5)
  UNION ALL SELECT doc_id, cycle, 2, 'brief', n, x || ' (2023-05-06)', '2023-05-06', 0 FROM sized WHERE k = 6
  UNION ALL SELECT doc_id, cycle, 2, 'brief', n, x, NULL, 0 FROM sized WHERE k = 7
  UNION ALL SELECT doc_id, cycle, 3, 'note', n, ltrim(x, '> '), NULL, 0 FROM sized WHERE k >= 8),
own AS (SELECT doc_id, cycle, substr(x, 1, 10) AS subhead FROM sized WHERE k = 3),
grouped AS (
  SELECT doc_id, cycle, part, any_value(kind) AS kind, string_agg(CASE WHEN kind = 'table' THEN trim(line) ELSE """ + PLAIN.format(x="line") + r""" END, E'\n' ORDER BY n, sub) AS body,
    array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN kind = 'table' THEN [] ELSE regexp_extract_all(line, '\d{4}-\d{2}-\d{2}') END)))), ',') AS dates
  FROM parts GROUP BY doc_id, cycle, part)
SELECT doc_id, kind, chapter_num, chapter, section, CASE kind WHEN 'topic' THEN """ + PLAIN.format(x="'**주제**  ' || t") + r""" WHEN 'table' THEN trim(subhead) WHEN 'note' THEN '단편' ELSE CASE WHEN part = 0 THEN '' ELSE '단편' END END AS topic,
  CASE WHEN kind = 'topic' THEN '다수의견' ELSE '' END AS confidence, dates, body
FROM grouped JOIN heads USING (doc_id, cycle) LEFT JOIN own USING (doc_id, cycle)"""


@query("KB-2 KB-3 KB-4 KB-5 KB-6", "WITH " + BLOCKS)
def markdown_blocks(spark, d):
    b = md.blocks(markdown_documents(spark, d), ["doc_id"], "text")
    return b.select("doc_id", "kind", "chapter_num", "chapter", "section", "topic", "confidence",
                    F.array_join("dates", ",").alias("dates"), F.array_join("lines", "\n").alias("body"))


IDS = BLOCKS.replace("SELECT doc_id, kind, chapter_num", ", b AS (SELECT cycle, part, doc_id, kind, chapter_num", 1) + r"""),
d AS (SELECT *, substr(sha1(chapter || '|' || section || '|' || topic || '|' || kind), 1, 10) AS digest FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, digest ORDER BY cycle, part) - 1 AS nth FROM d),
ids AS (SELECT *, 'kb-' || CASE WHEN chapter_num < 10 THEN '0' ELSE '' END || CAST(chapter_num AS VARCHAR) || '-' || digest || CASE WHEN nth > 0 THEN '-' || CAST(nth AS VARCHAR) ELSE '' END AS post_id,
  '[분야] ' || CAST(chapter_num AS VARCHAR) || '. ' || chapter || CASE WHEN section <> '' THEN ' > ' || section ELSE '' END || CASE WHEN topic <> '' THEN E'\n[주제] ' || topic || CASE WHEN confidence <> '' THEN ' (' || confidence || ')' ELSE '' END ELSE '' END AS header
FROM r),
whole AS (SELECT doc_id, string_agg(CASE WHEN k = 0 THEN '## ' || CAST(cycle + 1 AS VARCHAR) || '. ' || substr(x, 1, 12) || E' 장\n### ' || substr(x, 1, 20) || E'\n- **주제** `[다수의견]` ' || substr(x, 1, 30) || E'\n  - **쟁점** — 2024-01-03 ' || x
  WHEN k < 3 THEN '  - **결론** — 2024-01-02 ' || x WHEN k = 3 THEN '#### ' || substr(x, 1, 10) || E'\n| a | b |\n|---|---|\n| ' || replace(x, '|', ' ') || ' | 0 |' WHEN k < 6 THEN '| ' || replace(x, '|', ' ') || ' | 1 |'
  WHEN k = 6 THEN E'**단편**\n- ' || x || ' (2023-05-06)' WHEN k = 7 THEN '- ' || x WHEN k = 8 THEN E'\n> ' || x ELSE x END, E'\n' ORDER BY n) AS md_text FROM sized GROUP BY doc_id)
"""


@query("KB-10 KEY-2", "WITH " + IDS + "SELECT doc_id, post_id, header FROM ids")
def markdown_ids(spark, d):
    b = md.with_post_id(md.blocks(markdown_documents(spark, d), ["doc_id"], "text"), ["doc_id"], "kb")
    return b.select("doc_id", "post_id", md.block_header(*[F.col(c) for c in ("chapter_num", "chapter", "section", "topic", "confidence")]).alias("header"))


# Lines over the budget fall back to sentences and windows of 384, then to windows of the budget.
SENTENCES = r"CASE WHEN " + COUNT + r" <= 384 THEN [{x}] ELSE flatten(list_transform(list_filter(list_transform(string_split(regexp_replace({x}, '([.!?。])\s+', E'\\1\n', 'g'), E'\n'), lambda p: trim(p, E' \n')), lambda p: p <> ''), lambda p: CASE WHEN len(regexp_extract_all(p, '\S+')) <= 384 THEN [p] ELSE list_transform(range(0, len(regexp_extract_all(p, '\S+')) - 75, 309), lambda i: array_to_string(regexp_extract_all(p, '\S+')[i + 1:i + 384], ' ')) END)) END"
FIT = r"CASE WHEN " + COUNT + r" <= {n} THEN [{x}] ELSE list_transform(range(0, " + COUNT + r", {n}), lambda i: array_to_string(regexp_extract_all({x}, '\S+')[i + 1:i + {n}], ' ')) END"
MARKDOWN_CHUNKS = IDS + r""",
prefixed AS (SELECT *, CASE WHEN kind = 'table' THEN array_to_string(list_prepend(header, string_split(body, E'\n')[1:2]), E'\n') ELSE header END AS prefix,
  CASE WHEN kind = 'table' THEN string_split(body, E'\n')[3:] ELSE string_split(body, E'\n') END AS raw FROM ids),
limited AS (SELECT *, 384 - """ + COUNT.format(x="prefix") + r""" - 4 AS budget FROM prefixed),
cut AS (SELECT *, flatten(list_transform(raw, lambda x: CASE WHEN """ + COUNT.format(x="x") + r""" <= budget THEN [x] ELSE flatten(list_transform(""" + SENTENCES.format(x="x") + r""", lambda y: """ + FIT.format(x="y", n="budget") + r""")) END)) AS parts FROM limited),
folded AS (SELECT *, list_reduce(list_prepend({done: CAST([] AS VARCHAR[]), cur: '', n: CAST(0 AS BIGINT), budget: budget, first: true}, list_transform(parts, lambda x: {done: CAST([] AS VARCHAR[]), cur: x, n: """ + COUNT.format(x="x") + r""", budget: budget, first: false})), lambda a, x:
  CASE WHEN a.first THEN {done: a.done, cur: x.cur, n: x.n, budget: x.budget, first: false}
    WHEN a.n + x.n > x.budget THEN {done: list_append(a.done, a.cur), cur: x.cur, n: x.n, budget: x.budget, first: false} ELSE {done: a.done, cur: a.cur || E'\n' || x.cur, n: a.n + x.n, budget: x.budget, first: false} END) AS r FROM cut),
chunked AS (SELECT *, CASE WHEN """ + COUNT.format(x=r"header || E'\n' || body") + r""" <= 384 THEN [header || E'\n' || body] WHEN len(parts) = 0 THEN CAST([] AS VARCHAR[])
  ELSE list_transform(list_append(r.done, r.cur), lambda x: prefix || E'\n' || x) END AS c FROM folded),
made AS (SELECT doc_id, post_id, kind, chapter_num, chapter, section, topic, confidence, dates, unnest(c) AS text, generate_subscripts(c, 1) - 1 AS chunk_index FROM chunked)
"""


@query("KB-11", "WITH " + MARKDOWN_CHUNKS + "SELECT m.*, 'kb' AS source_type, substr(sha256(md_text), 1, 12) AS source_version FROM made m JOIN whole USING (doc_id)")
def markdown_chunks(spark, d):
    c = md.chunk_markdown(markdown_documents(spark, d), "text", keys=["doc_id"])
    return c.withColumn("dates", F.array_join("dates", ",")).drop("pos")


@query("KB-13", "WITH " + MARKDOWN_CHUNKS + "SELECT kind, count(*) AS chunks FROM made GROUP BY kind")
def markdown_kinds(spark, d):
    return md.chunks_per_kind(md.chunk_markdown(markdown_documents(spark, d), "text", keys=["doc_id"]))


# Rule texts made of the given lines: a chapter every 9 lines, an article every 3.
def rule_documents(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(
        F.when(i % 9 == 1, F.concat(F.lit("제"), (i / 9 + 1).cast("int"), F.lit("장 총칙\n"))).otherwise(""),
        F.when(i % 3 == 2, F.concat(F.lit("제 "), i, F.lit("조 (목적) "), tx.cut(x, 10), F.lit("\n"))).otherwise(""), x))
    text = F.when(F.col("lang") == "de", F.col("text")).otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n부칙\n12\n끝")))
    return texts(spark, d, "documents", "doc_id", "text", "lang", "source").select(
        "doc_id", text.alias("text"), F.col("source").alias("source_key"), F.concat(F.lit("Formula 심사규정 "), F.col("source")).alias("title"),
        F.lit("2024").alias("year"), F.lit("").alias("competition"))


# The scheme of rule_documents() told from the line numbers: an article owns its line and the next two
# lines up to the following chapter.
RULE_SECTIONS = MARKDOWN + r""",
clean AS (SELECT doc_id, n, trim(regexp_replace(x, '\s+', ' ', 'g')) AS x, trim(regexp_replace('(목적) ' || substr(x, 1, 10), '\s+', ' ', 'g')) AS head FROM md JOIN documents USING (doc_id) WHERE lang <> 'de'),
articles AS (SELECT doc_id, n, n // 9 + 1 - CASE WHEN n % 9 = 0 THEN 1 ELSE 0 END AS chapter_num, trim(substr(head, 5)) AS rest FROM clean WHERE n % 3 = 2),
bodies AS (SELECT a.doc_id, a.n, string_agg(c.x, E'\n' ORDER BY c.n) AS lines FROM articles a JOIN clean c ON c.doc_id = a.doc_id AND c.n BETWEEN a.n AND a.n + 2 AND NOT (a.n % 9 = 8 AND c.n = a.n + 2)
  WHERE c.x <> '' AND NOT regexp_full_match(c.x, '\d+') GROUP BY a.doc_id, a.n)
SELECT a.doc_id, chapter_num, '총칙' AS chapter, a.n AS section_num, '목적' || CASE WHEN rest <> '' THEN ' - ' || rest ELSE '' END AS section, coalesce(lines, '') AS lines FROM articles a LEFT JOIN bodies b ON b.doc_id = a.doc_id AND b.n = a.n
UNION ALL SELECT doc_id, CASE WHEN last = 0 THEN 0 ELSE (last - 1) // 9 + 1 END, CASE WHEN last = 0 THEN '' ELSE '총칙' END, 9999, '부칙', CASE WHEN last = 0 THEN '' ELSE '끝' END
  FROM (SELECT doc_id, max(n) AS last FROM clean GROUP BY doc_id)"""


@query("RUL-2 NRM-2", "WITH " + RULE_SECTIONS)
def rule_sections(spark, d):
    s = rules.sectionize(rule_documents(spark, d), ["doc_id"], "text")
    return s.withColumn("lines", F.array_join("lines", "\n")).drop("pos")


# Windows of n tokens that start every n - 64 tokens up to the last one.
SPLIT = r"CASE WHEN " + COUNT + r" <= {n} THEN [{x}] ELSE list_transform(range(0, " + COUNT + r", greatest(1, {n} - 64)), lambda i: array_to_string(regexp_extract_all({x}, '\S+')[i + 1:i + {n}], ' ')) END"
RULE_CHUNKS = RULE_SECTIONS.replace("SELECT a.doc_id, chapter_num, '총칙'", ", sections AS (SELECT a.doc_id, chapter_num, '총칙'", 1) + r"""),
titled AS (SELECT s.*, d.source, '[규정문서] Formula 심사규정 ' || d.source || E'\n[규정분류] formula / 심사규정' AS doc_head FROM sections s JOIN documents d USING (doc_id) WHERE lines <> ''),
headed AS (SELECT *, '[제' || CAST(chapter_num AS VARCHAR) || '장] ' || chapter || E'\n[제' || CAST(section_num AS VARCHAR) || '조] ' || section || E'\n' || doc_head || ' - ' || section AS head FROM titled),
budgeted AS (SELECT *, 384 - """ + COUNT.format(x="head") + r""" - 4 AS budget FROM headed),
cut AS (SELECT *, flatten(list_transform(string_split(lines, E'\n'), lambda x: """ + SPLIT.format(x="x", n="budget") + r""")) AS parts FROM budgeted),
folded AS (SELECT *, list_reduce(list_prepend({done: CAST([] AS VARCHAR[]), buf: CAST([] AS STRUCT(t VARCHAR, n BIGINT)[]), t: '', n: CAST(-1 AS BIGINT), total: CAST(0 AS BIGINT), budget: budget},
    list_transform(parts, lambda x: {done: CAST([] AS VARCHAR[]), buf: CAST([] AS STRUCT(t VARCHAR, n BIGINT)[]), t: x, n: """ + COUNT.format(x="x") + r""", total: CAST(0 AS BIGINT), budget: budget})), lambda a, x:
  CASE WHEN len(a.buf) > 0 AND a.total + x.n > x.budget THEN {
    done: list_append(a.done, array_to_string(list_transform(a.buf, lambda y: y.t), E'\n')),
    buf: list_append(list_filter(a.buf, lambda y, i: list_sum(list_transform(a.buf[i:], lambda z: z.n)) <= 64), {t: x.t, n: x.n}), t: '', n: CAST(-1 AS BIGINT),
    total: CAST(coalesce(list_sum(list_transform(list_filter(a.buf, lambda y, i: list_sum(list_transform(a.buf[i:], lambda z: z.n)) <= 64), lambda y: y.n)), 0) + x.n AS BIGINT), budget: x.budget}
  ELSE {done: a.done, buf: list_append(a.buf, {t: x.t, n: x.n}), t: '', n: CAST(-1 AS BIGINT), total: a.total + x.n, budget: x.budget} END) AS r FROM cut),
of_sections AS (SELECT doc_id, 'formula-rules-' || substr(sha1(source || ':' || CAST(chapter_num AS VARCHAR) || ':' || CAST(section_num AS VARCHAR) || ':' || section), 1, 12) AS post_id, chapter, chapter_num, section, section_num,
  CASE WHEN """ + COUNT.format(x=r"head || E'\n' || lines") + r""" <= 384 THEN [head || E'\n' || lines]
  ELSE list_transform(list_append(r.done, array_to_string(list_transform(r.buf, lambda y: y.t), E'\n')), lambda x: head || E'\n' || x) END AS c FROM folded),
plain AS (SELECT doc_id, trim(text, E' \n') AS text FROM documents WHERE lang = 'de'
  UNION ALL SELECT doc_id, trim(text, E' \n') || E'\n부칙\n12\n끝' FROM documents WHERE lang <> 'de' AND NOT contains(text, E'\n')),
""" + PACKING.format(keys="doc_id", docs="plain", size=384, overlap=64, least=-1).split("lists AS (")[0].rstrip().rstrip(",") + r""",
generic AS (SELECT doc_id, list_reduce(list_prepend({done: CAST([] AS VARCHAR[]), buf: '', n: CAST(0 AS BIGINT)}, list({done: CAST([] AS VARCHAR[]), buf: segment, n: """ + COUNT.format(x="segment") + r"""} ORDER BY pp, sp, i)), lambda a, x:
  CASE WHEN x.n > 368 THEN {done: list_concat(CASE WHEN a.buf <> '' THEN list_append(a.done, a.buf) ELSE a.done END, """ + SPLIT.format(x="x.buf", n="368") + r"""), buf: '', n: CAST(0 AS BIGINT)}
       WHEN a.buf <> '' AND a.n + x.n > 368 THEN {done: list_append(a.done, a.buf), buf: x.buf, n: x.n}
       ELSE {done: a.done, buf: CASE WHEN a.buf = '' THEN x.buf ELSE a.buf || E'\n' || x.buf END, n: a.n + x.n} END) AS r FROM segments GROUP BY doc_id),
of_documents AS (SELECT doc_id, source AS post_id, '규정' AS chapter, CAST(NULL AS BIGINT) AS chapter_num, '본문' AS section, CAST(NULL AS BIGINT) AS section_num,
  list_transform(CASE WHEN r.buf <> '' THEN list_append(r.done, r.buf) ELSE r.done END, lambda x: '[규정문서] Formula 심사규정 ' || source || E'\n[규정분류] formula / 심사규정' || E'\n' || x) AS c FROM generic JOIN documents USING (doc_id)),
made AS (SELECT * EXCLUDE (c), unnest(c) AS text, generate_subscripts(c, 1) - 1 AS chunk_index FROM (SELECT * FROM of_sections UNION ALL SELECT * FROM of_documents))
"""


@query("RUL-3 RUL-4 RUL-6 RUL-7", "WITH " + RULE_CHUNKS + r"""SELECT m.*, 'rules' AS source_type, '2024+' || source AS source_version, source AS source_key, 'Formula 심사규정 ' || source AS source_title, 'formula' AS competition, 'judging' AS document_type,
  '심사규정' AS document_type_label, '2024' AS year FROM made m JOIN documents USING (doc_id)""")
def rule_chunks(spark, d):
    made = rules.chunk_rules(rule_documents(spark, d), "text", keys=["doc_id"])
    return made.drop("source_post_id", "source_file", "source_filename", "source_url")


@query("RUL-10", "WITH " + RULE_CHUNKS + "SELECT doc_id, chapter_num, section_num, chunk_index FROM made ORDER BY coalesce(chapter_num, 0), coalesce(section_num, 0), chunk_index")
def rule_chunks_in_order(spark, d):
    return rules.in_reading_order(rules.chunk_rules(rule_documents(spark, d), "text", keys=["doc_id"])).select(
        "doc_id", "chapter_num", "section_num", "chunk_index")


@query("RUL-8", """
SELECT doc_id, '[규정문서] ' || source || E'\\n[규정분류] ' || lang || ' / ' || '기타' || ' - ' || CAST(n_chars AS VARCHAR) AS header FROM documents""")
def rule_headers(spark, d):
    return table(spark, d, "documents").select("doc_id", rules.rule_header(
        F.col("source"), F.col("lang"), F.lit("기타"), F.col("n_chars").cast("string")).alias("header"))


@query("RUL-1", """
SELECT doc_id AS source_post_id, 'Baja 안전규정 최종' AS title, '2024-01-02' AS date, '2026' AS year, '/raw/' || source || '.pdf' AS source_file, source || '.pdf' AS source_filename,
  'baja' AS competition, 'safety' AS document_type, true AS downloaded, 'Baja 안전규정 최종' AS source_title FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang NOT IN ('fr', 'de') AND n_chars > 100""")
def accepted_manifest(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    items = docs.select(
        F.col("doc_id").alias("source_post_id"), F.concat(F.lit("Baja 안전규정 "), F.when(F.col("lang") == "fr", "개정(안)").otherwise("최종")).alias("title"),
        F.lit("2024-01-02").alias("date"), F.when(F.col("quality") == 1, "2026").otherwise("2025").alias("year"),
        F.concat(F.lit("/raw/"), F.col("source"), F.when(F.col("lang") == "de", ".hwp").otherwise(".pdf")).alias("source_file"),
        F.lit("").alias("source_filename"), F.lit("").alias("competition"), F.lit("").alias("document_type"), (F.col("n_chars") > 100).alias("downloaded"))
    return rules.accept_manifest(items)
