"""Rule documents -> sections -> token-budgeted chunks with context headers.

Sections and chunks are worked out inside the row of their document; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import classify as cl
from loreloom.functions import fixed_values as fixed
from loreloom.functions import text as tx
from loreloom.functions.encode import nfkc
from loreloom.functions.text import WORDS, Tokenizer
from loreloom.operators import qna_chunks as qna

MAX_TOKENS = 384
OVERLAP = 64
MIN_GENERIC_BUDGET = 120
SOURCE_TYPE = "formula-rules"
DEFAULT_YEAR = "2026"
SHORT_CAP, LONG_CAP = 4_000, 20_000
SLICE_CHARS = 2_400  # of a sentence that no tokens bound
_LINES = "array<struct<text:string,n:int>>"

# Every line end that str.splitlines() knows.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def capped(c: Column, chars: int) -> Column:
    return tx.cut(tx.strip(c), chars)


def kept_lines(docs: DataFrame, keys: list[str], text: str, *, noise: Iterable[str] = (fixed.BARE_PAGE_NUMBER,)) -> DataFrame:
    """``keys, pos, line``: normalized lines without blanks and boilerplate.

    *noise* are patterns of whole lines: page numbers by default, plus the footers, running titles
    and gutters of the documents at hand.
    """
    rows = docs.select(*keys, nfkc(tx.or_empty(text)).alias("__text"))
    return rows.select(*keys, F.posexplode(line_array(F.col("__text"), noise)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


def line_array(folded: Column, noise: Iterable[str] = (fixed.BARE_PAGE_NUMBER,)) -> Column:
    """The kept lines of a text after Unicode folding, as an array."""
    lines = F.transform(F.split(folded, LINE_END), lambda x: cl.rewritten_rule_text(x))
    patterns = list(noise)
    return F.filter(lines, lambda x: (x != "") & ~cl.any_match(x, patterns)) if patterns else F.filter(lines, lambda x: x != "")


def accept_manifest(items: DataFrame, year: str = DEFAULT_YEAR, *, present: Column | None = None) -> DataFrame:
    """Items of the year with a PDF that is there and is no draft, metadata filled in."""
    title, filename = tx.strip(tx.or_empty("title")), tx.strip(tx.or_empty("source_filename"))
    there = present if present is not None else F.coalesce(F.col("downloaded"), F.lit(False))
    path_name = F.regexp_extract("source_file", r"([^/\\]*)\z", 1)
    kept = items.where(
        (F.coalesce(F.col("year").cast("string"), F.lit(DEFAULT_YEAR)) == year)
        & (tx.or_empty("source_file") != "") & there & F.lower("source_file").endswith(".pdf")
        & ~cl.is_draft(title, filename, F.col("date"))
    )
    named = F.when(filename == "", path_name).when(F.lower(filename).contains("pdf"), filename).otherwise(
        F.concat(filename, F.lit(".pdf")))
    return kept.withColumns({
        "source_title": title, "title": title, "source_filename": named,
        "competition": cl.normalize_competition(F.coalesce(tx.non_empty("competition"), cl.infer_competition(title))),
        "document_type": cl.normalize_document_type(F.coalesce(tx.non_empty("document_type"), cl.infer_document_type(title))),
    })


def base_row(docs: DataFrame) -> DataFrame:
    """Payload columns every rule chunk carries, with their defaults."""
    have = set(docs.columns)

    def given(name: str) -> Column:
        return tx.or_empty(F.col(name).cast("string")) if name in have else F.lit("")

    title = tx.strip(given("title"))
    year = F.coalesce(tx.non_empty(given("year")), F.lit(DEFAULT_YEAR))
    competition = cl.normalize_competition(F.coalesce(tx.non_empty(given("competition")), cl.infer_competition(title)))
    document_type = cl.normalize_document_type(F.coalesce(tx.non_empty(given("document_type")), cl.infer_document_type(title)))
    return docs.withColumns({
        "source_type": F.lit("rules"), "source_post_id": given("source_post_id"), "source_key": given("source_key"),
        "source_version": F.coalesce(tx.non_empty(given("source_version")), tx.default_source_version(given("source_key"), year)),
        "source_file": given("source_file"), "source_filename": given("source_filename"), "source_url": given("source_url"),
        "source_title": title, "competition": competition, "document_type": document_type,
        "document_type_label": cl.document_type_label(document_type), "year": year,
    })


BASE = ("source_type", "source_post_id", "source_key", "source_version", "source_file", "source_filename", "source_url",
        "source_title", "competition", "document_type", "document_type_label", "year")


def rule_header(title: Column, competition: Column, label: Column, section: Column | None = None) -> Column:
    part = F.lit("") if section is None else F.when(section != "", F.concat(F.lit(" - "), section)).otherwise("")
    return F.concat(F.lit("[규정문서] "), title, F.lit("\n[규정분류] "), competition, F.lit(" / "), label, part)


def header_title() -> Column:
    name = F.coalesce(tx.non_empty("source_title"), tx.non_empty("source_filename"), F.col("source_key"))
    return cl.normalize_rule_text(name)


# --- sections -----------------------------------------------------------------------------------


SECTIONS = "array<struct<pos:bigint,chapter_num:bigint,chapter:string,section_num:bigint,section:string,lines:array<string>>>"


def sections_of(lines: Column) -> Column:
    """The articles and supplements of an array of lines, each with its body lines; nothing leaves the row.

    Lines before the first article of a chapter are dropped, and so are articles before the first
    chapter. A supplement is section 9999; before any chapter it keeps no lines.
    """
    def chapter_of(x: Column, i: Column) -> Column:
        number = F.coalesce(F.regexp_extract(x, fixed.RULE_CHAPTER, 1).try_cast("bigint"), F.lit(0).cast("bigint"))
        return F.struct(i.alias("i"), number.alias("num"), tx.strip(F.regexp_extract(x, fixed.RULE_CHAPTER, 2)).alias("name"))

    def marked(x: Column, i: Column) -> Column:
        chapter = x.rlike(fixed.RULE_CHAPTER)
        return F.struct(i.alias("i"), x.alias("x"), chapter.alias("c"), (~chapter & x.rlike(fixed.RULE_SECTION)).alias("a"), (~chapter & x.rlike(fixed.RULE_SUPPLEMENT)).alias("s"))

    def head(b: Column) -> Column:
        x = b["x"]
        name, rest = (tx.strip(F.regexp_extract(x, fixed.RULE_SECTION, i)) for i in (2, 3))
        title = F.when(F.regexp_extract(x, fixed.RULE_SECTION, 2) != "", F.when(rest != "", F.concat(name, F.lit(" - "), rest)).otherwise(name)).otherwise(rest)
        title = F.coalesce(tx.non_empty(tx.strip(title)), F.lit(fixed.DEFAULT_SECTION_TITLE))
        number = F.regexp_extract(x, fixed.RULE_SECTION, 1).try_cast("bigint")
        article = F.struct(number.alias("num"), title.alias("title"))
        return F.when(b["a"], article).otherwise(F.struct(F.lit(fixed.SUPPLEMENT_NUMBER).cast("bigint").alias("num"), F.lit(fixed.SUPPLEMENT_TITLE).alias("title")))

    def cut(breaks: Column) -> Column:
        def section(b: Column, j: Column) -> Column:
            end = F.coalesce(F.get(breaks, j + 1)["i"], F.size(lines))
            body = F.when(b["num"] != 0, F.slice(lines, b["i"] + 2, end - b["i"] - 1)).otherwise(F.array().cast("array<string>"))
            return F.when(~b["c"], F.struct(b["i"].cast("bigint").alias("pos"), b["num"].alias("chapter_num"), b["name"].alias("chapter"), head(b)["num"].alias("section_num"),
                                            head(b)["title"].alias("section"), body.alias("lines")))

        return F.filter(F.transform(breaks, section), lambda x: x.isNotNull())

    def with_chapters(marks: Column) -> Column:
        chapters = F.transform(F.filter(marks, lambda m: m["c"]), lambda m: chapter_of(m["x"], m["i"]))

        def placed(m: Column) -> Column:
            before = F.filter(chapters, lambda c: c["i"] <= m["i"])
            inside = F.get(before, F.size(before) - 1)
            return F.struct(m["i"].alias("i"), m["x"].alias("x"), m["c"].alias("c"), (m["a"] & (F.coalesce(inside["num"], F.lit(0)) != 0)).alias("a"), m["s"].alias("s"),
                            F.coalesce(inside["num"], F.lit(0).cast("bigint")).alias("num"), F.coalesce(inside["name"], F.lit("")).alias("name"))

        # An article before any chapter is no break, a supplement is one anywhere.
        return tx.let(F.filter(F.transform(marks, placed), lambda m: m["c"] | m["a"] | m["s"]), cut)

    marks = F.filter(F.transform(lines, marked), lambda m: m["c"] | m["a"] | m["s"])
    return tx.let(marks, with_chapters).cast(SECTIONS)


def sectionize(docs: DataFrame, keys: list[str], text: str, *, noise: Iterable[str] = (fixed.BARE_PAGE_NUMBER,)) -> DataFrame:
    """Documents -> one row per article or supplement, with its body lines in order."""
    rows = docs.select(*keys, nfkc(tx.or_empty(text)).alias("__text")).select(*keys, line_array(F.col("__text"), noise).alias("__lines"))
    return rows.select(*keys, F.explode(sections_of(F.col("__lines"))).alias("s")).select(*keys, "s.*")


def tail_lines(lines: Column, limit: int = OVERLAP) -> Column:
    """Whole last lines that hold at most *limit* tokens together. Lines: ``text, n``."""

    def step(acc: Column, line: Column) -> Column:
        n = acc["used"] + line["n"]
        fits = acc["open"] & (n <= limit)
        return F.struct(
            F.when(fits, F.concat(F.array(line), acc["tail"])).otherwise(acc["tail"]).alias("tail"),
            F.when(fits, n).otherwise(acc["used"]).alias("used"), fits.alias("open"))

    start = F.struct(F.array().cast(_LINES).alias("tail"), F.lit(0).cast("int").alias("used"), F.lit(True).alias("open"))
    return F.aggregate(F.reverse(lines), start, step)


def fit_to_budget(c: Column, budget: Column, *, overlap: int = OVERLAP, drop_contained: bool = False,
                  tokenizer: Tokenizer = WORDS) -> Column:
    """Overlapping windows of *budget* tokens. The last may be a pure suffix of the one before it;
    ``drop_contained`` stops at the first window that reaches the end."""
    step = F.greatest(budget - overlap, F.lit(1))
    windows = tx.token_windows(c, budget, step, to_the_end=not drop_contained, tokenizer=tokenizer)
    return F.when(tokenizer.count(c) <= budget, F.array(c)).otherwise(F.transform(windows, tx.strip))


def pack_lines(parts: Column, budget: Column, *, overlap: int = OVERLAP, tokenizer: Tokenizer = WORDS) -> Column:
    """Greedy packing of lines; a new chunk starts with the tail lines of the one before."""
    empty = F.array().cast(_LINES)
    counted = F.transform(parts, lambda p: F.struct(p.alias("text"), tokenizer.count(p).cast("int").alias("n")))

    def joined(buffer: Column) -> Column:
        return F.array_join(F.transform(buffer, lambda x: x["text"]), "\n")

    def step(acc: Column, part: Column) -> Column:
        over = (F.size(acc["buffer"]) > 0) & (acc["n"] + part["n"] > budget)
        tail = tail_lines(acc["buffer"], overlap) if overlap > 0 else None
        kept = F.when(over, tail["tail"] if overlap > 0 else empty).otherwise(acc["buffer"])
        used = F.when(over, tail["used"] if overlap > 0 else F.lit(0)).otherwise(acc["n"])
        done = F.when(over, F.concat(acc["done"], F.array(joined(acc["buffer"])))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.concat(kept, F.array(part)).alias("buffer"), (used + part["n"]).cast("int").alias("n"))

    start = F.struct(F.array().cast("array<string>").alias("done"), empty.alias("buffer"), F.lit(0).cast("int").alias("n"))
    return F.aggregate(counted, start, step, lambda acc: F.when(
        F.size(acc["buffer"]) > 0, F.concat(acc["done"], F.array(joined(acc["buffer"])))).otherwise(acc["done"]))


def section_chunks(section: Column, *, size: int = MAX_TOKENS, tokenizer: Tokenizer = WORDS) -> Column:
    """Chunk texts of one section of a row with base columns and ``__title``."""
    head = F.concat(
        F.lit("[제"), section["chapter_num"], F.lit("장] "), section["chapter"], F.lit("\n[제"), section["section_num"], F.lit("조] "),
        section["section"], F.lit("\n"),
        rule_header(F.col("__title"), F.col("competition"), F.col("document_type_label"), section["section"]))

    def with_head(h: Column) -> Column:
        left = F.lit(size) - tokenizer.count(h) - 4
        budget = F.when(left <= 0, F.lit(max(64, size // 2))).otherwise(left).cast("int")
        full = F.concat(h, F.lit("\n"), tx.strip(F.array_join(section["lines"], "\n")))
        parts = F.flatten(F.transform(F.filter(section["lines"], lambda x: x != ""), lambda x: fit_to_budget(x, budget, tokenizer=tokenizer)))
        packed = F.transform(pack_lines(F.filter(parts, lambda x: x != ""), budget, tokenizer=tokenizer), lambda t: F.concat(h, F.lit("\n"), t))
        return F.when(tokenizer.count(full) <= size, F.array(full)).otherwise(packed)

    return tx.let(head, with_head)


def generic_chunks(text: Column, header: Column, *, size: int = MAX_TOKENS, tokenizer: Tokenizer = WORDS) -> Column:
    """Chunks of a document without sections; a segment over the budget is emitted in pieces of its own."""
    limit = F.greatest(F.lit(size) - tokenizer.count(header) - 8, F.lit(MIN_GENERIC_BUDGET)).cast("int")
    parts = qna.segments(text, size=size, overlap=OVERLAP, tokenizer=tokenizer, slice_chars=SLICE_CHARS)
    counted = F.transform(parts, lambda p: F.struct(p.alias("text"), tokenizer.count(p).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buffer"), F.lit(0).cast("int").alias("n"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["buffer"] != "", F.concat(acc["done"], tx.character_slices(acc["buffer"], LONG_CAP))).otherwise(acc["done"])

    def packed(budget: Column) -> Column:
        def step(acc: Column, part: Column) -> Column:
            n, piece = part["n"], part["text"]
            large = n > budget
            over = ~large & (acc["buffer"] != "") & (acc["n"] + n > budget)
            done = F.when(large, F.concat(flushed(acc), fit_to_budget(piece, budget, tokenizer=tokenizer))).when(
                over, flushed(acc)).otherwise(acc["done"])
            fresh = over | (acc["buffer"] == "")
            buffer = F.when(large, F.lit("")).when(fresh, piece).otherwise(F.concat(acc["buffer"], F.lit("\n"), piece))
            used = F.when(large, F.lit(0)).when(fresh, n).otherwise(acc["n"] + n)
            return F.struct(done.alias("done"), buffer.alias("buffer"), used.cast("int").alias("n"))

        return F.aggregate(counted, start, step, flushed)

    return F.transform(tx.let(limit, packed), lambda t: F.concat(header, F.lit("\n"), t))


def chunk_rules(docs: DataFrame, text: str, *, keys: list[str], noise: Iterable[str] = (fixed.BARE_PAGE_NUMBER,),
                source_type: str = SOURCE_TYPE, size: int = MAX_TOKENS, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """Sections where a document has them, generic chunks under its source key where it has none.

    One pass and no shuffle: sections are found in the row, and a document without any is its own unit.
    Equal sections of one document get a repeat suffix.
    """
    based = base_row(docs).withColumns({"__folded": nfkc(tx.or_empty(text)), "__title": header_title()})
    found = based.withColumn("__lines", line_array(F.col("__folded"), noise)).withColumn("__all", sections_of(F.col("__lines")))
    filled = F.filter("__all", lambda x: tx.strip(F.array_join(x["lines"], "\n")) != "")
    id_of = lambda x: tx.section_id(source_type, F.col("source_key"), x["chapter_num"], x["section_num"], x["section"])
    named = found.withColumn("__units", F.transform(filled, lambda x: F.struct(x.alias("s"), id_of(x).alias("id"))))

    def numbered(u: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice("__units", F.lit(1), i), lambda v: v["id"] == u["id"]))
        return F.struct(u["s"].alias("s"), F.when(before > 0, F.concat(u["id"], F.lit("-"), before)).otherwise(u["id"]).alias("id"))

    no_unit = F.array(F.lit(None).cast(f"struct<s:{SECTIONS[6:-1]},id:string>"))
    some = F.exists("__all", lambda x: F.size(x["lines"]) > 0)
    base = [c for c in BASE if c not in keys]
    rows = named.select(*keys, *base, "__title", F.when(~some, F.col(text)).alias("__text"), F.explode(F.when(some, F.transform("__units", numbered)).otherwise(no_unit)).alias("__u"))
    plain, section = F.col("__u").isNull(), F.col("__u.s")
    fallback = F.sha2(F.concat("source_url", "source_file"), 256)
    header = rule_header(F.col("__title"), F.col("competition"), F.col("document_type_label"))
    texts = F.when(plain, generic_chunks(tx.strip(F.col("__text")), header, size=size, tokenizer=tokenizer)).otherwise(section_chunks(section, size=size, tokenizer=tokenizer))
    return rows.select(
        *keys, *base, F.when(plain, F.coalesce(tx.non_empty("source_key"), fallback)).otherwise(F.col("__u.id")).alias("post_id"),
        F.when(plain, "규정").otherwise(section["chapter"]).alias("chapter"), section["chapter_num"].alias("chapter_num"),
        F.when(plain, "본문").otherwise(section["section"]).alias("section"), section["section_num"].alias("section_num"),
        F.posexplode(texts).alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


def in_reading_order(chunks: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return chunks.orderBy(*[F.coalesce(tx.parse_int(c), zero) for c in ("chapter_num", "section_num", "chunk_index")])
