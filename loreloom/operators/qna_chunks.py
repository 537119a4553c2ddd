"""Question-and-answer posts -> token-budgeted chunks.

A post is one row and its chunks are computed inside the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import fixed_values as fixed
from loreloom.functions import text as tx
from loreloom.functions.text import WORDS, Tokenizer
from loreloom.operators import ordered

MAX_TOKENS = 384
OVERLAP = 75
CONTEXT_TOKENS = 100

PARAGRAPH = rf"(?U)\n{tx.SPACE}*\n"
SENTENCE = rf"(?U)(?<=[.!?。]){tx.SPACE}+|\n"
_NO_TEXT = "array<string>"


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, tx.strip), lambda p: p != "")


def segments(text: Column, *, size: int = MAX_TOKENS, overlap: int = OVERLAP, tokenizer: Tokenizer = WORDS, slice_chars: int | None = None) -> Column:
    """Paragraphs; sentences of paragraphs over the budget; token windows of sentences over it.

    A tokenizer that counts but gives no tokens bounds no window: with *slice_chars* such sentences are cut after that
    many characters.
    """

    def fits(c: Column) -> Column:
        return tokenizer.count(c) <= size

    def sentence(s: Column) -> Column:
        windows = tx.token_windows(s, size, size - overlap, tokenizer=tokenizer)
        if slice_chars:
            windows = F.when(F.size(tokenizer.encode(s)) > 0, windows).otherwise(tx.character_slices(s, slice_chars))
        return F.when(fits(s), F.array(s)).otherwise(windows)

    def paragraph(p: Column) -> Column:
        sentences = F.flatten(F.transform(_pieces(F.split(p, SENTENCE)), sentence))
        return F.when(fits(p), F.array(p)).otherwise(sentences)

    return F.flatten(F.transform(_pieces(F.split(text, PARAGRAPH)), paragraph))


def pack(parts: Column, *, size: int = MAX_TOKENS, overlap: int = OVERLAP, tokenizer: Tokenizer = WORDS) -> Column:
    """Greedy packing; every chunk after the first starts with the tail of the one before.

    The tail and one full segment can exceed the budget together; such a chunk stays whole.
    """

    counted = F.transform(parts, lambda p: F.struct(p.alias("text"), tokenizer.count(p).alias("n")))

    def tail(c: Column, n: Column) -> Column:
        return F.when(n >= overlap, tokenizer.decode(F.slice(tokenizer.encode(c), -overlap, overlap))).otherwise(c)

    def step(acc: Column, part: Column) -> Column:
        current, n, text = acc["current"], acc["n"], part["text"]
        fresh = current == ""
        over = ~fresh & (n + part["n"] > size)
        joined = F.concat(current, F.lit("\n"), text)
        text = F.when(over, F.concat(tail(current, n), F.lit("\n"), text)).when(fresh, text).otherwise(
            joined if tokenizer.additive else tx.strip(joined))
        done = F.when(over, F.concat(acc["done"], F.array(current))).otherwise(acc["done"])
        added = F.when(over, F.least(n, F.lit(overlap))).otherwise(n) + part["n"]
        return F.struct(done.alias("done"), text.alias("current"),
                        (added if tokenizer.additive else tokenizer.count(text)).cast("int").alias("n"))

    start = F.struct(F.array().cast(_NO_TEXT).alias("done"), F.lit("").alias("current"),
                     F.lit(0).cast("int").alias("n"))
    return F.aggregate(counted, start, step, lambda acc: F.when(
        acc["current"] != "", F.concat(acc["done"], F.array(acc["current"]))).otherwise(acc["done"]))


def chunks(text: Column, *, size: int = MAX_TOKENS, overlap: int = OVERLAP, tokenizer: Tokenizer = WORDS) -> Column:
    """Chunk texts of one document, as an array."""
    packed = pack(segments(text, size=size, overlap=overlap, tokenizer=tokenizer),
                  size=size, overlap=overlap, tokenizer=tokenizer)
    return F.when(tokenizer.count(text) <= size, F.array(text)).otherwise(packed)


def chunk_documents(docs: DataFrame, text: str, *, size: int = MAX_TOKENS, overlap: int = OVERLAP,
                    tokenizer: Tokenizer = WORDS) -> DataFrame:
    """One row per chunk: the other columns, ``chunk_index`` and ``text``."""
    rest = [c for c in docs.columns if c != text]
    exploded = docs.select(*rest, F.posexplode(
        chunks(F.col(text), size=size, overlap=overlap, tokenizer=tokenizer)).alias("chunk_index", "text"))
    return exploded.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


def question_context(body: Column, *, limit: int = CONTEXT_TOKENS, tokenizer: Tokenizer = WORDS) -> Column:
    return tx.truncate_tokens(body, limit, tokenizer=tokenizer)


def answer_document(title: Column, context: Column, answer: Column) -> Column:
    return F.concat(F.lit(f"{fixed.QUESTION_MARK} "), title, F.lit("\n"), context,
                    F.lit(f"\n\n{fixed.ANSWER_MARK}\n"), answer)


def question_document(title: Column, body: Column) -> Column:
    return F.concat_ws("\n\n", tx.non_empty(title), tx.non_empty(body))


def chunk_posts(posts: DataFrame, *, size: int = MAX_TOKENS, overlap: int = OVERLAP,
                tokenizer: Tokenizer = WORDS) -> DataFrame:
    """Chunks of nested posts: one document per answer, or the question alone when it has none.

    The chunk index runs over all answers of a post.
    """
    title, body, url = tx.or_empty("title"), tx.or_empty("question_body"), tx.or_empty("url")
    given = F.coalesce("answers", F.array().cast("array<struct<body:string,url:string>>"))
    if "answer_body" in posts.columns:
        legacy = F.array(F.struct(F.col("answer_body").alias("body"), url.alias("url")))
        given = F.when((F.size(given) == 0) & (tx.or_empty("answer_body") != ""), legacy).otherwise(given)
    p = posts.withColumn("__answers", given).where(
        (title != "") | (body != "") | (F.size("__answers") > 0)
    ).select(
        F.col("id").cast("string").alias("post_id"), tx.or_empty("category").alias("category"), title.alias("title"),
        tx.or_empty("date").alias("date"), "__answers", question_context(body, tokenizer=tokenizer).alias("__context"),
        question_document(title, body).alias("__alone"), url.alias("__url"), (F.size("__answers") > 0).alias("has_answer"),
    )

    def document(text: Column, link: Column) -> Column:
        return F.struct(text.alias("text"), link.alias("url"))

    answered = F.transform("__answers", lambda a: document(
        answer_document(F.col("title"), F.col("__context"), tx.or_empty(a["body"])), tx.or_empty(a["url"])))
    alone = F.array(document(F.col("__alone"), F.col("__url")))
    p = p.withColumn("__docs", F.when(F.col("has_answer"), answered).otherwise(alone))
    pieces = F.flatten(F.transform("__docs", lambda x: F.transform(
        chunks(x["text"], size=size, overlap=overlap, tokenizer=tokenizer),
        lambda t: F.struct(x["url"].alias("url"), t.alias("text")))))
    rows = p.select("post_id", "category", "title", "date", "has_answer", F.posexplode(pieces).alias("chunk_index", "c"))
    return rows.select("post_id", "category", "title", "date", F.col("c.url").alias("url"), "has_answer",
                       F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("c.text").alias("text"))


def chunk_answers(answers: DataFrame, *, keys: list[str], position: str, title: Column, context: Column,
                  answer: Column, size: int = MAX_TOKENS, overlap: int = OVERLAP, tokenizer: Tokenizer = WORDS,
                  block: int = ordered.BLOCK) -> DataFrame:
    """The same for flat answer rows: a question may have any number of them.

    The running index is a prefix sum of chunk counts, cut into blocks for hot questions.
    """
    made = answers.withColumn("__chunks", chunks(answer_document(title, context, answer),
                                                 size=size, overlap=overlap, tokenizer=tokenizer))
    offset = ordered.running_sum(made, keys, position, F.size("__chunks").cast("bigint"), "__offset",
                                 inclusive=False, block=block)
    return offset.select(*answers.columns, "__offset", F.posexplode("__chunks").alias("__i", "text")).withColumn(
        "chunk_index", F.col("__offset") + F.col("__i")).drop("__offset", "__i")


def chunk_stats(chunk_rows: DataFrame, text: str = "text", *, by: list[str] = (), size: int = MAX_TOKENS,
                tokenizer: Tokenizer = WORDS) -> DataFrame:
    """Chunks, average, smallest and largest token count, chunks over the budget; zeros when empty."""
    n = tx.token_count(text, tokenizer)
    zero = F.lit(0).cast("bigint")
    return chunk_rows.groupBy(*by).agg(
        F.count("*").alias("chunks"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_tokens"),
        F.coalesce(F.min(n), zero).alias("min_tokens"),
        F.coalesce(F.max(n), zero).alias("max_tokens"),
        F.count_if(n > size).alias("oversize"),
    )
