"""From scored candidates to a final list: labels, boosts, caps, balance, relevance, context.

Candidates arrive with a proven bound per query (search depth x collections), so windows over a
query are small whatever the data.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions import classify as cl
from loreloom.functions import fixed_values as fixed
from loreloom.functions import text as tx

MAX_PER_POST = 2
MAX_PER_SECTION = 2
BEST_FIRST = ("score", "collection", "id")


def _have(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _filled(df: DataFrame, name: str) -> Column:
    return tx.or_empty(_have(df, name).cast("string"))


def best_first(df: DataFrame) -> list[Column]:
    """Score, then stable keys, so that ties never depend on timing."""
    return [F.desc("score"), *[F.col(c) for c in BEST_FIRST[1:] if c in df.columns]]


def together(hits: DataFrame) -> DataFrame:
    """Bring the candidates of a query to one task, once: the windows below partition by query and
    more, so none of them shuffles again."""
    return hits.repartition("qid")


def answered_only(hits: DataFrame, *, collection: str = "qna", marker: str = fixed.ANSWER_MARK) -> DataFrame:
    """Question-only entries of the Q&A collection are no evidence."""
    return hits.where((F.col("collection") != collection) | F.col("content").contains(marker))


def source_label(hits: DataFrame, *, kb_type: str = fixed.KB_TYPE, kb_label: str = fixed.KB_LABEL) -> DataFrame:
    """``source`` and ``url`` by the payload: knowledge base, rules, titled post, chapter, nothing."""
    def given(name: str) -> Column:
        return _filled(hits, name)

    def present(name: str) -> Column:
        return _have(hits, name).isNotNull()

    number = F.regexp_replace(F.concat(given("chapter_num"), F.lit(". "), given("chapter")), r"\A[. ]+|[. ]+\z", "")
    path = F.concat_ws(" > ", tx.non_empty(number), tx.non_empty(given("section")), tx.non_empty(given("topic")))
    grade = F.when(given("confidence") != "", F.concat(F.lit("·"), given("confidence"))).otherwise("")
    kb = F.concat(F.lit(f"[{kb_label}"), grade, F.lit("] "), path)
    label = F.coalesce(tx.non_empty(given("document_type_label")), given("document_type"))
    typed = F.when((label != "") & (given("document_type") != ""), F.concat(F.lit("("), label, F.lit(")"))).otherwise(label)
    title = F.coalesce(*[tx.non_empty(given(c)) for c in ("source_title", "source_filename", "source_key")], F.lit(""))
    rules = F.concat(F.lit("[규정"), typed, F.lit("]"),
                     F.when(given("competition") != "", F.concat(F.lit("/"), given("competition"))).otherwise(""),
                     F.when(title != "", F.concat(F.lit(" "), title)).otherwise(""))
    post = F.concat(F.when(given("category") != "", F.concat(F.lit("["), given("category"), F.lit("] "))).otherwise(""), given("title"))
    chapter = F.concat(F.lit("제"), given("chapter_num"), F.lit("장 "), given("chapter"), F.lit(" > "), given("section"))
    kind = given("source_type")
    source = F.when(kind == kb_type, kb).when(kind == "rules", rules).when(present("title"), post).when(
        present("chapter"), chapter).otherwise("")
    url = F.when(kind == kb_type, "").when(kind == "rules", given("source_url")).when(present("title"), given("url")).otherwise("")
    return hits.withColumns({"source": source, "url": url})


def content_of(df: DataFrame) -> Column:
    """Text of a point, under its older name where the newer is empty."""
    return F.coalesce(tx.non_empty(_have(df, "content")), tx.non_empty(_have(df, "chunk_text")), F.lit(""))


def stable_key(hits: DataFrame) -> Column:
    """First filled of source key, url, file, id, label."""
    names = ("source_key", "url", "source_file", "id", "source")
    return F.coalesce(*[tx.non_empty(_have(hits, n).cast("string")) for n in names], F.lit(""))


# --- routing ------------------------------------------------------------------------------------


def route_competition(queries: DataFrame, active: DataFrame, *, competition: str = "competition", out: str = "competition_filter",
                      fallback: Mapping[str, str] = fixed.COMPETITION_FALLBACK) -> DataFrame:
    """A competition without populated collections goes to its nearest family if that is populated."""
    families = active.select(F.col("competition_key").alias("__a")).distinct()
    near = cl.lookup(F.col(competition), fallback)
    marked = queries.withColumn("__near", near)
    hit = marked.join(families.withColumn("__direct", F.lit(True)), F.col(competition) == F.col("__a"), "left").drop("__a")
    near_hit = families.select(F.col("__a").alias("__b"), F.lit(True).alias("__by_family"))
    hit = hit.join(near_hit, F.col("__near") == F.col("__b"), "left").drop("__b")
    routed = F.when(F.col("__direct"), F.col(competition)).when(F.col("__by_family"), F.col("__near")).otherwise(F.col(competition))
    return hit.withColumn(out, routed).drop("__near", "__direct", "__by_family")


def route_document_type(queries: DataFrame, active: DataFrame, *, query: str = "query", document_type: str = "document_type",
                        competition: str = "competition_filter", out: str = "document_type_filter") -> DataFrame:
    """Keep a type filter only when such a collection is populated for the competition.

    Two types must be named outright, because vehicle parts share their words.
    """
    explicit = F.lit(True)
    for kind, pattern in fixed.EXPLICIT_TYPE_PATTERNS.items():
        explicit = F.when(F.col(document_type) == kind, F.col(query).rlike(pattern)).otherwise(explicit)
    # At most one set of competition keys per document type.
    kinds = active.groupBy(F.col("document_type_key").alias("__t")).agg(F.collect_set("competition_key").alias("__families"))
    key = F.when(F.col(competition).isNotNull(), cl.normalize_competition(F.col(competition)))
    joined = queries.join(kinds, F.col(document_type) == F.col("__t"), "left")
    populated = F.col("__t").isNotNull() & (
        key.isNull() | F.arrays_overlap("__families", F.array(key, F.lit(fixed.OTHER))))
    return joined.withColumn(out, F.when(explicit & populated, F.col(document_type))).drop("__t", "__families")


# --- boosts and penalties -----------------------------------------------------------------------


def query_boost(hits: DataFrame, *, weights: Mapping[str, float] = fixed.BOOST_WEIGHTS) -> Column:
    """Boost of a rule hit. Hits carry the hints of their query: ``q_competition``,
    ``q_document_type``, ``q_terms``, ``q_sections``, ``q_chapters``."""
    zero = F.lit(0.0)
    competition, hint = _have(hits, "competition"), F.col("q_competition")
    c = F.when(hint.isNull(), zero).when(competition == hint, weights["competition"]).when(
        tx.or_empty(competition) != "", weights["competition_other"]).otherwise(zero)
    # A missing type counts as another type.
    kind, wanted = cl.normalize_document_type(_filled(hits, "document_type")), F.col("q_document_type")
    t = F.when(wanted.isNull(), zero).when(kind == wanted, weights["type"]).otherwise(weights["type_other"])

    def cited(name: str, refs: str) -> Column:
        number = tx.parse_int(_have(hits, name))
        return F.when(F.coalesce(F.array_contains(refs, number), F.lit(False)), weights["section" if "section" in name else "chapter"]).otherwise(zero)

    names = ("source_title", "source_filename", "section", "chapter", "document_type_label", "competition")
    searchable = F.lower(F.concat_ws(" ", *[_filled(hits, n) for n in names]))
    matched = tx.let(searchable, lambda text: F.size(F.filter("q_terms", lambda x: text.contains(x))))
    terms = F.least(F.lit(weights["terms_max"]), matched * weights["term"])
    return c + t + cited("section_num", "q_sections") + cited("chapter_num", "q_chapters") + terms


def evidence_penalty(hits: DataFrame, *, kb_type: str = fixed.KB_TYPE, kb_collection: str = "kb") -> Column:
    """2 for unresolved or unanswered entries of the knowledge base, 0.5 for single reports."""
    kb = (_filled(hits, "source_type") == kb_type) | (_filled(hits, "collection") == kb_collection)
    grade = _filled(hits, "confidence")
    unresolved = (grade == fixed.UNRESOLVED_GRADE) | _filled(hits, "content").contains(fixed.NO_ANSWER_MARK)
    return F.when(kb & unresolved, 2.0).when(kb & (grade == fixed.SINGLE_REPORT_GRADE), 0.5).otherwise(0.0)


def adjust_scores(hits: DataFrame, *, boost: Column | None = None, penalty: Column | None = None,
                  min_score: float | None = None) -> DataFrame:
    """Add the boosts of rule hits, take off the penalties; only penalized hits must reach the minimum again."""
    boosted = F.when(_filled(hits, "source_type") == "rules", F.coalesce(boost, F.lit(0.0))).otherwise(0.0) if boost is not None else F.lit(0.0)
    taken = penalty if penalty is not None else F.lit(0.0)
    out = hits.withColumn("__p", taken).withColumn("score", F.col("score") + boosted * fixed.BOOST_SHARE - F.col("__p") * fixed.PENALTY_SHARE)
    if min_score is not None:
        out = out.where((F.col("__p") == 0) | (F.col("score") >= min_score))
    return out.drop("__p")


# --- caps, balance, merge -----------------------------------------------------------------------


def cap_repeats(hits: DataFrame, *, per_post: int = MAX_PER_POST, per_section: int = MAX_PER_SECTION) -> DataFrame:
    """At most *per_post* hits of a post, then at most *per_section* of a section, best first.

    Hits without a post id, or without any section key, are not capped. Adds ``rank`` per query.
    """
    order = best_first(hits)
    post = Window.partitionBy("qid", "post_id").orderBy(*order)
    first = hits.withColumn("__p", F.when(F.col("post_id").isNotNull(), F.row_number().over(post)).otherwise(0))
    first = first.where(F.col("__p") <= per_post)
    keys = [_filled(hits, c) for c in ("source_key", "chapter", "section")]
    section = Window.partitionBy("qid", *keys).orderBy(*order)
    second = first.withColumn("__s", F.when(F.concat(*keys) != "", F.row_number().over(section)).otherwise(0))
    kept = second.where(F.col("__s") <= per_section).drop("__p", "__s", "rank")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("bigint"))


def source_group(hits: DataFrame) -> Column:
    collection, kind = _filled(hits, "collection"), _filled(hits, "source_type")
    return (F.when(collection == "qna", "qna").when((collection == "kb") | (kind == fixed.KB_TYPE), fixed.KB_TYPE)
            .when((collection == "rules") | collection.startswith("rules-") | (kind == "rules"), "rules").otherwise("other"))


def balance(hits: DataFrame, limit: int, *, group: Column | None = None) -> DataFrame:
    """Cap every group at max(8, half the limit) when a query has more than *limit* hits of several groups."""
    order = best_first(hits)
    g = hits.withColumn("__g", group if group is not None else source_group(hits))
    q = Window.partitionBy("qid")
    in_group = Window.partitionBy("qid", "__g").orderBy(*order)
    sized = g.select("*", F.count("*").over(q).alias("__n"), F.size(F.collect_set("__g").over(q)).alias("__k"),
                     F.row_number().over(in_group).alias("__r"))
    capped = (F.col("__n") > limit) & (F.col("__k") > 1)
    kept = sized.where(~capped | (F.col("__r") <= max(8, (limit + 1) // 2))).drop("rank", "__n", "__k", "__r", "__g")
    ranked = kept.withColumn("rank", F.row_number().over(q.orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= limit)


def candidate_counts(hits: DataFrame, groups: tuple[str, ...] = fixed.SOURCE_GROUPS, *, group: Column | None = None) -> DataFrame:
    """Hits per query and group, zeros filled in."""
    g = group if group is not None else source_group(hits)
    return hits.groupBy("qid").agg(*[F.count_if(g == name).alias(name) for name in groups])


def merge_paths(first: DataFrame, second: DataFrame, limit: int, *, group: Column | None = None, text: Column | None = None) -> DataFrame:
    """Best score per (source key, content) of two searches, the first path wins ties, balanced again.

    *text* tells contents apart where hits carry something shorter than their content.
    """
    both = first.withColumn("__path", F.lit(0)).unionByName(second.withColumn("__path", F.lit(1)), allowMissingColumns=True)
    text = F.sha2(_filled(both, "content"), 256) if text is None else text
    w = Window.partitionBy("qid", _filled(both, "source_key"), text).orderBy(F.desc("score"), "__path", *best_first(both)[1:])
    kept = both.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r", "__path")
    return balance(kept, limit, group=group)


def seen_competition(source: Column, content: Column, chars: int | None = None) -> Column:
    """The competition that a source or a content names; *chars* limits how far a content is read."""
    content = tx.or_empty(content)
    return cl.detect_competition(F.concat(tx.or_empty(source), F.lit("\n"), content if chars is None else tx.cut(content, chars)))


def same_competition(hits: DataFrame, *, competition: str = "q_competition", alternative: str | None = None, chars: int | None = None, seen: Column | None = None) -> DataFrame:
    """Drop hits that name another competition; unknown and 'other' stay. *chars* limits how far a content is read.

    *seen* is what :func:`seen_competition` gives, where hits carry that instead of their content.
    """
    given = _have(hits, "competition")
    seen = seen_competition(_filled(hits, "source"), _filled(hits, "content"), chars) if seen is None else seen
    key = F.when(given.isNotNull(), F.when(given != "", cl.normalize_competition(given))).otherwise(
        F.when(seen.isNotNull(), cl.normalize_competition(seen)))
    allowed = (key == F.col(competition)) | (F.col(alternative).eqNullSafe(key) if alternative else F.lit(False))
    return hits.where(F.col(competition).isNull() | key.isNull() | (key == fixed.OTHER) | allowed)


def retrieval_status(attempts: DataFrame, *, failed: str = "failed", hits: str = "hits") -> DataFrame:
    """ok / partial / failed per query from one row per searched collection."""
    n, bad, found = F.count("*"), F.count_if(F.col(failed)), F.sum(hits)
    status = F.when(bad == 0, "ok").when((bad == n) & (found == 0), "failed").otherwise("partial")
    return attempts.groupBy("qid").agg(status.alias("status"), bad.alias("failed_collections"))


def merge_status(first: Column, second: Column) -> Column:
    """Status of a two-path search."""
    return F.when((first == "ok") != (second == "ok"), "partial").otherwise(first)


def apply_relevance(hits: DataFrame, scores: DataFrame | Column, limit: int, *, penalty: Column | None = None, least: float = 3.0) -> DataFrame:
    """Re-rank by given relevance less the penalty; hits below *least* go.

    *scores* is a table of ``qid, id, relevance``, or a column of the hits, NULL where none is given. A query without any valid score keeps its original order, and so does a query with a single hit.
    """
    q = Window.partitionBy("qid")
    if isinstance(scores, DataFrame):
        joined = hits.join(scores.select("qid", "id", F.col("relevance").cast("double").alias("__given")), ["qid", "id"], "left")
    else:
        joined = hits.withColumn("__given", scores.cast("double"))
    rated = joined.select("*", F.count("__given").over(q).alias("__valid"), F.count("*").over(q).alias("__n"),
                          (penalty if penalty is not None else F.lit(0.0)).alias("__pen"))
    rated = rated.withColumn("rerank_score", F.when(
        (F.col("__valid") > 0) & (F.col("__n") > 1), F.greatest(F.lit(0.0), F.coalesce("__given", F.lit(0.0)) - F.col("__pen"))))
    kept = rated.where(F.col("rerank_score").isNull() | (F.col("rerank_score") >= least))
    order = [F.desc_nulls_last("rerank_score"), *best_first(hits)]
    ranked = kept.drop("rank").withColumn("rank", F.row_number().over(q.orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= limit).drop("__given", "__valid", "__n", "__pen")


# --- texts for the reader -----------------------------------------------------------------------


def excerpt(content: Column, *, marker: str = fixed.ANSWER_MARK, of_question: int = 300, of_answer: int = 900, plain: int = 1_000) -> Column:
    """Beginnings of the question and the answer, or of a content without the marker."""
    at = F.instr(content, marker)
    question, answer = F.substring(content, F.lit(1), at - 1), F.substring(content, at + len(marker), F.length(content))
    return F.when(at > 0, F.concat(tx.cut(question, of_question), F.lit(f"\n{marker}"), tx.cut(answer, of_answer))).otherwise(tx.cut(content, plain))


def context_pack(hits: DataFrame, queries: DataFrame, *, search_query: str | None = None, status: str | None = None,
                 clarify: Column | None = None) -> DataFrame:
    """One text per query: numbered sources with their url, or the notice that there are none, the
    search wording and status, a note on mixed competitions, and the question. Hits are a final list."""
    header = F.concat(F.lit(fixed.DOCUMENT_LABEL), F.col("rank"), F.lit("] "), F.col("source"),
                      F.when(F.col("url") != "", F.concat(F.lit("\nURL: "), F.col("url"))).otherwise(""))
    key = cl.normalize_competition(_filled(hits, "competition"))
    named = F.when((_filled(hits, "competition") != "") & (key != fixed.OTHER), key)
    packed = hits.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat(header, F.lit("\n"), F.col("content")).alias("text")))).alias("__docs"),
        F.size(F.collect_set(named)).alias("__families"))
    joined = queries.join(packed, "qid", "left")
    found = F.concat(F.lit(fixed.DOCUMENTS_FOUND), F.array_join(F.transform("__docs", lambda x: x["text"]), "\n\n---\n\n"), F.lit("\n\n---\n\n"))
    missing = F.lit(fixed.DOCUMENTS_MISSING)
    wording = F.lit("")
    if search_query:
        other = F.col(search_query).isNotNull() & (F.col(search_query) != F.col("query"))
        wording = F.when(other, F.concat(F.lit(fixed.SEARCH_WORDING), F.col(search_query), F.lit(")\n"))).otherwise("")
    state = F.concat(F.lit(fixed.SEARCH_STATUS), F.col(status) if status else F.lit("ok"), F.lit(")\n"))
    is_mixed = cl.detect_competition(F.col("query")).isNull() & (F.coalesce("__families", F.lit(0)) > 1)
    mixed = F.when(is_mixed, fixed.MIXED_COMPETITIONS).otherwise("")
    unclear = F.lit("")
    if clarify is not None:
        unclear = F.when(clarify, fixed.INCOMPLETE_QUESTION).otherwise("")
    text = F.concat(F.when(F.col("__docs").isNotNull(), found).otherwise(missing), wording, state, mixed, unclear,
                    F.lit(fixed.USER_QUESTION), F.col("query"))
    return joined.select("qid", text.alias("prompt"), F.coalesce(F.size("__docs"), F.lit(0)).cast("bigint").alias("sources"),
                         is_mixed.alias("mixed"))


def result_list(hits: DataFrame) -> DataFrame:
    """One text per query: labels with scores and the contents, for display."""
    head = F.concat(F.format_string("**%s** (score: %.4f)", F.col("source"), F.col("score")),
                    F.when(F.col("url") != "", F.concat(F.lit("\n"), F.col("url"))).otherwise(""))
    text = F.concat(head, F.lit("\n```\n"), F.col("content"), F.lit("\n```"))
    return hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("d")).select(
        "qid", F.array_join(F.transform("d", lambda x: x["t"]), "\n\n---\n\n").alias("results"))
