"""Tables of saved pages -> rows, details and manifest items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import classify as cl
from loreloom.functions import html
from loreloom.functions import text as tx


def absolute(base: str, link: Column) -> Column:
    """Join a site address and a link: full links stay, rooted and relative ones get the address."""
    rooted = F.when(link.startswith("/"), link).otherwise(F.concat(F.lit("/"), link))
    return F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).otherwise(F.concat(F.lit(base), rooted))


def list_rows(pages: DataFrame, *, page: str = "html", view: str = "/bbs/?number={}&mode=view") -> DataFrame:
    """Data rows of list pages, one per post, with their position on the page."""
    head, tail = view.split("{}")
    rows = pages.select(*[c for c in pages.columns if c != page],
                        F.posexplode(html.list_cells(page)).alias("pos", "r"))
    kept = rows.where((F.col("r.cells") >= 7) & F.col("r.number").rlike(r"\A[0-9]+\z") & F.col("r.has_link"))
    number = F.coalesce(tx.query_parameter("r.href", "number"), F.col("r.number"))
    return kept.select(
        *[c for c in rows.columns if c not in ("pos", "r")],
        F.col("pos").cast("bigint").alias("pos"),
        F.col("r.number").try_cast("bigint").alias("id"),
        number.try_cast("bigint").alias("number"),
        F.col("r.category").alias("category"), F.col("r.title").alias("title"), F.col("r.author").alias("author"),
        tx.parse_count("r.views").alias("views"), F.col("r.date").alias("date"),
        F.concat(F.lit(head), number, F.lit(tail)).alias("detail_url"), F.col("r.is_reply").alias("is_reply"),
    )


def details(pages: DataFrame, *, page: str = "html", base: str = "") -> DataFrame:
    """Fields of detail pages; a page that cannot be read carries an ``error`` instead."""
    d = pages.withColumn("d", html.detail_fields(page)).drop(page)
    error = F.when(F.col("d.rows").isNull(), F.lit("no detail table")).when(
        F.col("d.rows") < 3, F.concat(F.lit("unexpected row count "), F.col("d.rows")))
    ok = error.isNull()

    def when_ok(c: Column) -> Column:
        return F.when(ok, c)

    return d.select(
        *[c for c in d.columns if c != "d"],
        when_ok(F.col("d.title")).alias("title"), when_ok(F.col("d.author")).alias("author"),
        when_ok(F.col("d.date")).alias("date"), when_ok(tx.parse_count("d.views")).alias("views"),
        when_ok(tx.clean_text("d.body")).alias("body"),
        when_ok(F.transform("d.attachments", lambda a: F.concat(F.lit(base), a))).alias("attachments"),
        error.alias("error"),
    )


def manifest_items(pages: DataFrame, *, page: str = "html", base: str, default_year: str,
                   default_name: str = "rules.pdf") -> DataFrame:
    """One item per download link of a file board; drafts are left out."""
    rows = pages.select(*[c for c in pages.columns if c != page],
                        F.posexplode(html.file_links(page)).alias("pos", "r"))
    rest = [c for c in rows.columns if c != "r"]
    linked = rows.select(
        *rest, tx.parse_int(tx.query_parameter("r.href", "number")).alias("source_post_id"),
        F.col("r.title").alias("title"), F.col("r.date").alias("date"),
        absolute(base, F.col("r.href")).alias("detail_url"), absolute(base, F.col("r.link")).alias("source_url"),
        F.col("r.alt").alias("__alt"),
    ).where(F.col("source_post_id").isNotNull())
    path_name = F.regexp_extract(F.regexp_replace("source_url", r"[?#].*\z", ""), r"([^/]*)\z", 1)
    parameter = F.try_url_decode(F.regexp_extract("source_url", r"[?&]filename=([^&#]+)", 1))
    name = F.coalesce(tx.non_empty("__alt"), tx.non_empty(parameter), tx.non_empty(path_name), F.lit(default_name))
    base_rows = linked.withColumn("source_filename", name).withColumn(
        "source_filename", F.when(F.lower("source_filename").contains(".pdf"), F.col("source_filename"))
        .otherwise(F.concat("source_filename", F.lit(".pdf")))).drop("__alt")
    named = F.concat_ws(" ", "title", "source_filename", "date")
    competition, document_type = cl.classify_document(F.col("title"), F.col("source_filename"))
    return (
        base_rows.where(~cl.is_draft(F.col("title"), F.col("source_filename"), F.col("date")))
        .withColumn("competition", competition).withColumn("document_type", document_type)
        .withColumn("year", tx.best_year(named, default_year))
        .withColumn("source_key", tx.source_key("source_url"))
        .withColumn("source_version", tx.source_version(F.col("source_post_id").cast("string"), F.col("title"),
                                                        F.col("source_url"), F.col("year")))
    )


def page_text(pages: DataFrame, *, page: str = "html") -> DataFrame:
    """Title, cleaned visible text and number of links of any saved page."""
    p = pages.withColumn("p", html.page_parts(page)).drop(page)
    return p.select(*[c for c in p.columns if c != "p"], F.col("p.title").alias("title"),
                    tx.clean_text("p.text").alias("text"), F.size("p.links").cast("bigint").alias("links"))


def page_links(pages: DataFrame, *, page: str = "html") -> DataFrame:
    """One row per link of a saved page, in page order."""
    p = pages.withColumn("p", html.page_parts(page)).drop(page)
    rest = [c for c in p.columns if c != "p"]
    return p.select(*rest, F.posexplode("p.links").alias("pos", "l")).select(
        *rest, F.col("pos").cast("bigint").alias("pos"), F.col("l.href").alias("href"), F.col("l.label").alias("label"))
