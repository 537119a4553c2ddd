"""Retrieval evaluation: query synthesis, relevance, recall, reciprocal rank, comparisons."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import fixed_values as fixed
from loreloom.functions import text as tx
from loreloom.operators import ordered

SEED = 20260807
MIN_CODE = 5
ALPHABET = "[A-Za-z0-9-]+"


def seeded_order(*cols: Column, seed: int = SEED) -> list[Column]:
    """A repeatable shuffle."""
    return [F.xxhash64(F.lit(seed), *cols), *cols]


def code_tokens(text: Column | str, pattern: str = fixed.CODE_TOKEN_PATTERN) -> Column:
    """Distinct codes of a text. Only words with a digit and a Latin letter are looked at."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w.rlike(r"(?U)\d") & w.rlike("[A-Za-z]"))
    return F.array_distinct(F.regexp_extract_all(F.array_join(words, " "), F.lit(pattern)))


def _first(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def unique_codes(chunks: DataFrame, key: str, text: str, *, min_len: int = MIN_CODE,
                 pattern: str = fixed.CODE_TOKEN_PATTERN) -> DataFrame:
    """``token, key``: code-like tokens whose text occurs in exactly one chunk of the table.

    A token may also occur inside longer runs of its alphabet. Runs and tokens are counted first;
    then every longer run is cut at the lengths of the tokens that start with the same five
    characters, and the pieces meet the tokens by equality. No pair of tokens is ever formed.
    """
    found = chunks.select(F.col(key).alias("key"), F.explode(code_tokens(text, pattern)).alias("token"))
    found = found.where(F.length("token") >= min_len)
    tokens = found.groupBy("token").agg(F.count("*").alias("n"), F.min("key").alias("key")).where(F.col("n") == 1).drop("n")
    head = F.substring("token", 1, min_len)
    # Lengths of the tokens that share a head: a set of small integers.
    lengths = tokens.groupBy(head.alias("head")).agg(F.array_sort(F.collect_set(F.length("token"))).alias("lengths"))
    runs = chunks.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({ALPHABET})")))).alias("run"))
    # Up to two keys tell "one chunk" from "several"; they combine on the map side.
    runs = runs.where(F.length("run") >= min_len).groupBy("run").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    starts = runs.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("run") - (min_len - 1))))
    starts = starts.withColumn("head", F.substring("run", F.col("at"), F.lit(min_len)))
    cut = starts.join(lengths, "head").withColumn("len", F.explode("lengths")).where(F.col("at") + F.col("len") - 1 <= F.length("run"))
    pieces = cut.select(F.substring("run", F.col("at"), F.col("len")).alias("token"), "lo", "hi").groupBy("token").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return tokens.join(pieces, "token").where(F.col("lo") == F.col("hi")).select("token", "key")


def lexical_queries(chunks: DataFrame, key: str, text: str, *, seed: int = SEED, cap: int | None = None, first: Column | None = None,
                    pattern: str = fixed.CODE_TOKEN_PATTERN) -> DataFrame:
    """``query, gold``: one unique code per chunk, the first one in the chunk; all of them, or a seeded choice of *cap*.

    *first* marks the chunks queries are made of; uniqueness is over all chunks.
    """
    codes = unique_codes(chunks, key, text, pattern=pattern)
    sources = chunks if first is None else chunks.where(first)
    placed = codes.join(sources.select(F.col(key).alias("key"), F.col(text).alias("__t")), "key")
    one = placed.withColumn("at", F.instr("__t", F.col("token"))).drop("__t")
    best = ordered.first_per_key(one, ["key"], [F.col("at"), F.col("token")]).select(F.col("token").alias("query"), F.col("key").alias("gold"))
    return _first(best, seeded_order(F.col("query"), seed=seed), cap)


def semantic_queries(chunks: DataFrame, key: str, text: str, topic: str, *, seed: int = SEED, cap: int | None = None,
                     pattern: str = fixed.CONCLUSION_PATTERN) -> DataFrame:
    """``query, gold``: the conclusion of a chunk, unless it names the start of the topic."""
    q = chunks.select(F.col(key).alias("gold"), tx.strip(F.regexp_extract(text, pattern, 1)).alias("query"),
                      tx.cut(tx.or_empty(topic), 8).alias("__t"))
    kept = q.where((F.col("query") != "") & ((F.col("__t") == "") | ~F.col("query").contains(F.col("__t")))).drop("__t")
    return _first(kept, seeded_order(F.col("gold"), seed=seed), cap).select("query", "gold")


def normalized(c: Column | str) -> Column:
    return tx.squash(F.lower(tx.or_empty(c)))


def chunk_body(text: Column) -> Column:
    """Text below the two heading lines of a rule chunk."""
    lines = F.split(tx.strip(text), r"\r\n|[\n\r]")
    headed = (F.size(lines) >= 3) & lines[0].startswith("[제") & F.get(lines, F.lit(1)).startswith("[제")
    body = tx.strip(F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))
    return F.when(headed, body).otherwise(tx.strip(text))


def first_sentence(text: Column) -> Column:
    """First sentence of at least 20 characters, else the first 120 characters."""
    clean = normalized(text)
    first = tx.strip(F.split(clean, r"(?<=[.!?])\s+|\n", 2)[0])
    return F.when(F.length(first) >= 20, first).otherwise(tx.cut(clean, 120))


def section_queries(chunks: DataFrame, *, text: str = "text", order: Sequence[Column], per_task: int | None = None, seed: int = SEED) -> DataFrame:
    """Title and first-sentence queries, one each per distinct section: all of them, or a seeded choice of *per_task*."""
    def s(name: str) -> Column:
        return tx.or_empty(F.col(name).cast("string"))

    heads = chunks.where(F.coalesce(F.col("chunk_index"), F.lit(0)) == 0).select(
        s("chapter_num").alias("chapter_num"), s("section").alias("__s"), s("section_num").alias("section_num"),
        tx.strip(s("chapter")).alias("chapter"), F.col(text).alias("__text"), *[o.alias(f"__k{i}") for i, o in enumerate(order)])
    keys = ["chapter_num", "__s", "section_num"]
    once = ordered.first_per_key(heads, keys, [F.col(f"__k{i}") for i in range(len(order))])
    section = normalized("__s")
    rows = once.withColumn("section", section).where(F.col("section") != "")
    base = ["chapter_num", "chapter", "section_num", "section"]
    title = rows.select(F.concat(F.lit("제"), F.col("chapter_num"), F.lit("조 "), F.col("section")).alias("query"),
                        F.lit("title").alias("task"), *base, F.col("section").alias("anchor"))
    body = rows.withColumn("query", first_sentence(chunk_body(F.col("__text")))).where(F.col("query") != "").select(
        "query", F.lit("body").alias("task"), *base, F.col("query").alias("anchor"))

    shuffled = seeded_order(*[F.col(c) for c in ("chapter_num", "section_num", "section")], seed=seed)
    return _first(title, shuffled, per_task).unionByName(_first(body, shuffled, per_task))


def is_relevant(hits: DataFrame, *, prefix: str = "q_") -> Column:
    """Same section, or the content holds the anchor of the query."""
    def same(name: str) -> Column:
        return tx.or_empty(F.col(name).cast("string")) == F.col(prefix + name)

    section = normalized(F.col("section").cast("string")) == F.col(prefix + "section")
    anchor = normalized(prefix + "anchor")
    return (same("chapter_num") & same("section_num") & section) | ((anchor != "") & normalized("content").contains(anchor))


def metrics(queries: DataFrame, hits: DataFrame, relevant: Column, *, by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """n, recall@1, recall@5 and MRR@k. Queries without a relevant hit count as misses.

    Queries: ``qid`` and the *by* columns; hits: ``qid``, ``rank``.
    """
    first = hits.where(relevant & (F.col("rank") <= k)).groupBy("qid").agg(F.min("rank").alias("__r"))
    r = F.col("__r")
    zero = F.lit(0.0)
    return queries.join(first, "qid", "left").groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(F.when(r == 1, 1.0).otherwise(0.0)), zero).alias("recall_1"),
        F.coalesce(F.avg(F.when(r <= 5, 1.0).otherwise(0.0)), zero).alias("recall_5"),
        F.coalesce(F.avg(F.coalesce(1.0 / r, zero)), zero).alias("mrr"))


def mode_grid(queries: DataFrame, modes: Mapping[str, DataFrame], payload: Callable[[DataFrame], DataFrame], relevant: Column, *,
              by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """Metrics of several result lists over the same queries, in one pass: ``mode, [by], n, recall..``."""
    names = F.explode(F.array(*[F.lit(m) for m in modes]))
    asked = queries.withColumn("mode", names).withColumn("__q", F.struct("mode", "qid"))
    hits = reduce(DataFrame.unionByName, [h.select("qid", "id", "rank", F.lit(m).alias("mode")) for m, h in modes.items()])
    keyed = payload(hits).withColumn("__q", F.struct("mode", "qid"))
    return metrics(asked.drop("qid").withColumnRenamed("__q", "qid"), keyed.where(relevant).drop("qid").withColumnRenamed("__q", "qid"),
                   F.lit(True), by=["mode", *by], k=k)


def compare(baseline: DataFrame, candidate: DataFrame, by: Sequence[str]) -> DataFrame:
    """Candidate minus baseline, per task."""
    names = ("recall_1", "recall_5", "mrr")
    b = baseline.select(*by, *[F.col(n).alias(f"__{n}") for n in names])
    return candidate.join(b, list(by)).select(*by, *[(F.col(n) - F.col(f"__{n}")).alias(f"d_{n}") for n in names])


def overlap_per_query(queries: DataFrame, baseline: DataFrame, run: DataFrame, k: int) -> DataFrame:
    """``qid, common, overlap, empty`` of two top-k results."""
    b, r = (df.where(F.col("rank") <= k).select("qid", "id").distinct() for df in (baseline, run))
    common = b.join(r, ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("common"))
    found = r.groupBy("qid").agg(F.count("*").alias("__n"))
    joined = queries.select("qid").join(common, "qid", "left").join(found, "qid", "left")
    c = F.coalesce("common", F.lit(0).cast("bigint"))
    return joined.select("qid", c.alias("common"), (c / k).alias("overlap"), F.col("__n").isNull().alias("empty"))


def overlap_summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.avg("overlap").alias("overlap"), F.count_if("empty").alias("empty"), F.count("*").alias("queries"))


def most_divergent(per_query: DataFrame, n: int = 3) -> DataFrame:
    return per_query.orderBy("common", "qid").limit(n)
