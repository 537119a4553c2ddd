"""Markdown knowledge bases -> blocks -> chunks.

``## n. chapter``, ``### section``, ``#### subhead`` or a bold-only line give the context. Blocks:
a top bullet with nested bullets (topic), a run of childless bullets (brief), a table, prose (note).
Lines of a document come from one row, so windows over a document are bounded by that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions import fixed_values as fixed
from loreloom.functions import text as tx
from loreloom.functions.text import WORDS, Tokenizer
from loreloom.operators import qna_chunks as qna
from loreloom.operators.rule_chunks import pack_lines

MAX_TOKENS = 384
MARGIN = 4
CAPTION_CHARS = 40

FIRST_TAG = r"(?s)\A(.*?)" + fixed.CONFIDENCE_TAG

_KINDS = {"K": "topic", "T": "table", "B": "brief", "P": "note"}


def classify_lines(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, pos, line, shape``: chapter, section, subhead, bold, table, bullet, nested, blank, prose."""
    lines = docs.select(*keys, F.posexplode(F.split(tx.or_empty(text), "\n")).alias("pos", "line"))
    line, bare = F.col("line"), tx.strip("line")
    shape = (
        F.when(line.startswith("## ") & line.rlike(fixed.MARKDOWN_CHAPTER), "chapter")
        .when(line.rlike(fixed.MARKDOWN_SECTION), "section").when(line.rlike(fixed.MARKDOWN_SUBHEAD), "subhead").when(line.rlike(fixed.MARKDOWN_BOLD), "bold")
        .when(bare.startswith("|"), "table").when(line.rlike(fixed.MARKDOWN_BULLET), "bullet").when(line.rlike(fixed.MARKDOWN_NESTED), "nested")
        .when(bare == "", "blank").otherwise("prose")
    )
    return lines.select(*keys, F.col("pos").cast("bigint").alias("pos"), "line", shape.alias("shape"))


def caption(line: Column) -> Column:
    """A short bullet without a body is the caption of the table below it, else ''."""
    item = F.regexp_replace(F.regexp_extract(line, fixed.MARKDOWN_ANY_BULLET, 1), fixed.CONFIDENCE_TAG, "")
    t = tx.strip_markup(item)
    ok = line.rlike(fixed.MARKDOWN_ANY_BULLET) & ~t.contains("—") & (F.length(t) <= CAPTION_CHARS)
    return F.coalesce(F.when(ok, t), F.lit(""))


def with_context(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Fill chapter, section and subhead forward, lower levels reset by higher ones; lines before the
    first chapter go. Adds the neighbours the block rules look at."""
    line, shape = F.col("line"), F.col("shape")
    w = Window.partitionBy(*keys).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    below = w.rowsBetween(1, Window.unboundedFollowing)
    chapter = F.when(shape == "chapter", F.struct(
        F.regexp_extract(line, fixed.MARKDOWN_CHAPTER, 1).try_cast("bigint").alias("num"), F.regexp_extract(line, fixed.MARKDOWN_CHAPTER, 2).alias("name")))
    section = F.when(shape == "chapter", "").when(shape == "section", F.regexp_extract(line, fixed.MARKDOWN_SECTION, 1))
    subhead = (F.when(shape.isin("chapter", "section"), "").when(shape == "subhead", F.regexp_extract(line, fixed.MARKDOWN_SUBHEAD, 1))
               .when(shape == "bold", F.regexp_extract(line, fixed.MARKDOWN_BOLD, 1)))
    filled = F.when(shape != "blank", line)
    return lines.select(
        "*",
        F.last(chapter, ignorenulls=True).over(upto).alias("__chapter"),
        F.last(section, ignorenulls=True).over(upto).alias("section"),
        F.last(subhead, ignorenulls=True).over(upto).alias("subhead"),
        F.lead("shape").over(w).alias("__next"),
        F.last(F.when(shape != "nested", shape), ignorenulls=True).over(above).alias("__parent"),
        F.last(F.when(shape != "nested", F.col("pos")), ignorenulls=True).over(above).alias("__parent_pos"),
        F.min(F.when(shape == "chapter", F.col("pos"))).over(Window.partitionBy(*keys)).alias("__first"),
        F.last(filled, ignorenulls=True).over(above).alias("__above"),
        F.first(filled, ignorenulls=True).over(below).alias("__below"),
    ).where(F.col("pos") >= F.col("__first"))


def blocks(docs: DataFrame, keys: list[str], text: str, *, keep_long_captions: bool = True) -> DataFrame:
    """One row per block, in document order.

    A childless bullet above a table is its caption and no item of its own. One that is too long to
    be a caption stays a brief item; ``keep_long_captions=False`` drops it as well.
    """
    line, shape = F.col("line"), F.col("shape")
    c = with_context(classify_lines(docs, keys, text), keys)
    nested_child = (shape == "nested") & (F.col("__parent") == "bullet") & (F.col("__parent_pos") > F.col("__first"))
    above_table = (shape == "bullet") & tx.strip(F.coalesce("__below", F.lit(""))).startswith("|")
    dropped = above_table & (caption(line) != "") if keep_long_captions else above_table
    role = (
        F.when(shape.isin("chapter", "section", "subhead", "bold"), "H").when(shape == "table", "T")
        .when((shape == "bullet") & F.coalesce(F.col("__next") == "nested", F.lit(False)), "K")
        .when(F.coalesce(nested_child, F.lit(False)), "C").when(dropped, "D").when(shape == "bullet", "B")
        .when(shape == "blank", "_").otherwise("P")
    )
    r = c.withColumn("role", role).where(F.col("role") != "D")
    w = Window.partitionBy(*keys).orderBy("pos")
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    role = F.col("role")
    anchored = r.select("*", F.last(F.when(role.isin("H", "K", "C", "B", "T"), role), ignorenulls=True).over(above).alias("__anchor"),
                        F.lag("role").over(w).alias("__before"))
    in_table = F.coalesce(F.col("__anchor") == "T", F.lit(False))
    # Prose below a table belongs to the table until a heading or a bullet ends it.
    starts = (
        F.when(role == "K", True).when(role == "T", ~in_table)
        .when(role == "B", ~F.coalesce(F.col("__before") == "B", F.lit(False)))
        .when(role == "P", ~in_table & ~F.coalesce(F.col("__before") == "P", F.lit(False))).otherwise(False)
    )
    numbered = anchored.withColumn("__start", starts).withColumn(
        "__block", F.sum(F.col("__start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    head, child = F.regexp_extract(line, fixed.MARKDOWN_BULLET, 1), F.regexp_extract(line, fixed.MARKDOWN_NESTED, 1)
    title = F.when(role == "K", tx.strip_markup(F.regexp_replace(head, FIRST_TAG, "$1"))).when(
        role == "T", F.coalesce(tx.non_empty(caption(F.coalesce("__above", F.lit("")))), F.col("subhead"))).otherwise(F.col("subhead"))
    content = (
        F.when(role == "C", tx.label_line(child)).when(role == "T", tx.strip("line")).when(role == "B", tx.strip_markup(head))
        .when(role == "P", tx.strip_markup(F.regexp_replace(tx.strip("line"), r"\A[> ]+", "")))
    )
    grade = tx.non_empty(F.regexp_extract(F.when(role == "K", head).when(role == "C", child), fixed.CONFIDENCE_TAG, 1))
    dates = F.when(role == "C", tx.iso_dates(child)).when(role.isin("B", "P"), tx.iso_dates(line))
    members = numbered.where(role.isin("T", "P", "B", "K", "C")).select(
        *keys, "__block", "pos", "role", "__chapter", "section", title.alias("topic"), content.alias("content"),
        grade.alias("grade"), dates.alias("dates"))
    first = F.min(F.struct("pos", "role", "__chapter", "section", "topic"))
    grouped = members.groupBy(*keys, "__block").agg(
        first.alias("f"),
        F.min(F.when(F.col("grade").isNotNull(), F.struct("pos", "grade"))).alias("g"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("dates")))).alias("dates"),
        F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("pos", "content")))).alias("l"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("f.role"))
    out = grouped.select(
        *keys, F.col("f.pos").alias("pos"), kind.alias("kind"), F.col("f.__chapter.num").alias("chapter_num"),
        F.col("f.__chapter.name").alias("chapter"), F.col("f.section").alias("section"), F.col("f.topic").alias("topic"),
        F.when(F.col("f.role") == "K", F.coalesce("g.grade", F.lit(""))).otherwise("").alias("confidence"), "dates",
        F.transform("l", lambda x: x["content"]).alias("lines"))
    return out.where(F.exists("lines", lambda x: tx.strip(x) != ""))


def with_post_id(block_rows: DataFrame, keys: list[str], source_type: str) -> DataFrame:
    """Content-path id: stable under unrelated edits, a counter for equal paths in one document."""
    digest = tx.sha1_prefix([F.col("chapter"), F.col("section"), F.col("topic"), F.col("kind")], "|", 10)
    w = Window.partitionBy(*keys, "__digest").orderBy("pos")
    numbered = block_rows.withColumn("__digest", digest).withColumn("__n", F.row_number().over(w) - 1)
    stem = F.format_string(f"{source_type}-%02d-%s", F.coalesce("chapter_num", F.lit(0).cast("bigint")), F.col("__digest"))
    post_id = F.when(F.col("__n") > 0, F.concat(stem, F.lit("-"), F.col("__n"))).otherwise(stem)
    return numbered.withColumn("post_id", post_id).drop("__digest", "__n")


def block_header(chapter_num: Column, chapter: Column, section: Column, topic: Column, confidence: Column) -> Column:
    path = F.concat(F.when(chapter_num != 0, F.concat(chapter_num, F.lit(". "), chapter)).otherwise(chapter),
                    F.when(section != "", F.concat(F.lit(" > "), section)).otherwise(""))
    title = F.concat(topic, F.when(confidence != "", F.concat(F.lit(" ("), confidence, F.lit(")"))).otherwise(""))
    return F.concat(F.lit("[분야] "), path, F.when(topic != "", F.concat(F.lit("\n[주제] "), title)).otherwise(""))


def fit(c: Column, budget: Column, tokenizer: Tokenizer = WORDS) -> Column:
    """Windows of *budget* tokens without overlap; a budget of 0 or less leaves the text whole."""
    windows = tx.token_windows(c, F.greatest(budget, F.lit(1)), F.greatest(budget, F.lit(1)), to_the_end=True, tokenizer=tokenizer)
    return F.when((budget <= 0) | (tokenizer.count(c) <= budget), F.array(c)).otherwise(windows)


def chunk_blocks(block_rows: DataFrame, *, size: int = MAX_TOKENS, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """Blocks -> chunks; every chunk repeats the header, table chunks their first two rows as well."""
    rest = [c for c in block_rows.columns if c != "lines"]
    head = block_header(F.coalesce("chapter_num", F.lit(0)), F.col("chapter"), F.col("section"), F.col("topic"), F.col("confidence"))
    rows = block_rows.withColumn("__head", head)
    is_table = F.col("kind") == "table"
    prefix = F.when(is_table, F.array_join(F.concat(F.array("__head"), F.slice("lines", 1, 2)), "\n")).otherwise(F.col("__head"))
    # A slice beyond the end is empty, so a table of two rows has no row of its own.
    raw = F.when(is_table, F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0)))).otherwise(F.col("lines"))
    rows = rows.withColumn("__prefix", prefix).withColumn("__raw", raw)
    rows = rows.withColumn("__budget", (F.lit(size) - tokenizer.count(F.col("__prefix")) - MARGIN).cast("int"))
    budget = F.col("__budget")

    def pieces(line: Column) -> Column:
        inside = F.flatten(F.transform(qna.segments(line, size=size, tokenizer=tokenizer), lambda s: fit(s, budget, tokenizer)))
        return F.when(tokenizer.count(line) <= budget, F.array(line)).otherwise(inside)

    parts = F.flatten(F.transform("__raw", pieces))
    packed = F.transform(pack_lines(parts, budget, overlap=0, tokenizer=tokenizer), lambda t: F.concat(F.col("__prefix"), F.lit("\n"), t))
    full = F.concat("__head", F.lit("\n"), tx.strip(F.array_join("lines", "\n")))
    chosen = F.when(tokenizer.count(full) <= size, F.array(full)).otherwise(packed)
    return rows.select(*rest, F.posexplode(chosen).alias("chunk_index", "text")).withColumn(
        "chunk_index", F.col("chunk_index").cast("bigint"))


def chunk_markdown(docs: DataFrame, text: str, *, keys: list[str], source_type: str = "kb", version: Column | None = None,
                   keep_long_captions: bool = True, size: int = MAX_TOKENS, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """Documents -> chunks with ids and the fingerprint of their document."""
    # The fingerprint goes with the keys, so documents are read once and lines are shuffled once.
    stamped = docs.select(*keys, text, (version if version is not None else tx.fingerprint(F.encode(text, "UTF-8"))).alias("source_version"))
    found = blocks(stamped, [*keys, "source_version"], text, keep_long_captions=keep_long_captions)
    made = chunk_blocks(with_post_id(found, [*keys, "source_version"], source_type), size=size, tokenizer=tokenizer)
    return made.select(
        *keys, "post_id", F.lit(source_type).alias("source_type"), "source_version",
        F.coalesce("chapter_num", F.lit(0).cast("bigint")).alias("chapter_num"), "chapter", "section", "topic",
        "confidence", "dates", "kind", "pos", "chunk_index", "text")


def chunks_per_kind(chunk_rows: DataFrame) -> DataFrame:
    return chunk_rows.groupBy("kind").agg(F.count("*").alias("chunks"))
