import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loreloom.functions import subword, text as tx
from loreloom.operators import qna_chunks as qna

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces(spark):
    return subword.pieces_of(spark, MODEL)


def cheapest(word, costs, unknown):
    """Over all segmentations; of equal costs the one whose last pieces are longer."""
    best = None
    for cuts in range(1 << (len(word) - 1)):
        at = [0, *(i for i in range(1, len(word)) if cuts >> (i - 1) & 1), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(p in costs or len(p) == 1 for p in parts):
            key = sum(costs.get(p, unknown) for p in parts), [-len(p) for p in reversed(parts)]
            best = min(best, (key, parts)) if best else (key, parts)
    return best[1]


def test_lattice_against_all_segmentations():
    r = random.Random(2)
    for _ in range(150):
        costs = {"".join(r.choice("ab▁") for _ in range(r.randrange(1, 5))): r.randrange(1, 6) * subword.UNIT for _ in range(r.randrange(1, 12))}
        lattice = subword.Lattice(costs)
        words = ["▁" + "".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(6)]
        border, at = lattice.borders(words), 0
        for word in words:
            cuts = [i for i in range(len(word)) if border[at + i]] + [len(word)]
            at += len(word)
            assert [word[a:b] for a, b in zip(cuts, cuts[1:])] == cheapest(word, costs, lattice.unknown)


def test_golden_tokens(spark, pieces):
    texts = ["The tokenization of  unbelievable\nwords, déjà vu", "", None, "  \n", "日本語 🙂 x▁y⁠z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("m", pieces.mark("t"))
    got = rows.select("i", pieces.tokens(F.col("m")).alias("tokens"), tx.token_count("m", pieces.tokenizer).alias("n"), pieces.unmark(F.col("m")).alias("t")).orderBy("i").collect()
    assert got[0].tokens == ["▁The", "▁token", "ization", "▁of", "▁un", "bel", "iev", "able", "▁words", ",", "▁déjà", "▁vu"]
    assert got[4].tokens == ["▁", "日", "本", "語", "▁", "🙂", "▁x", "▁y", "▁z"]  # marks inside the given text are spaces
    assert [r.n for r in got] == [12, 0, 0, 0, 9]
    assert [r.t for r in got] == [*texts[:4], "日本語 🙂 x y z"]


def test_words_are_learned_once_and_forgotten(monkeypatch):
    costs = {"▁": 3, "▁a": 1, "b": 1, "ab": 1}
    monkeypatch.setattr(subword, "REMEMBERED", 2)
    marker = subword.Marker(costs).prepare()
    for _ in range(3):
        assert marker.mark(["ab abb", "b ab", "x y z"]) == ["▁a⁠b ▁a⁠b⁠b", "▁⁠b ▁a⁠b", "▁⁠x ▁⁠y ▁⁠z"]
        assert len(marker.new) <= 6


def test_windows_cut_inside_words(spark, pieces):
    rows = spark.createDataFrame([("tokenization unbelievable words",)], "t string").withColumn("t", pieces.mark("t"))
    windows = rows.select(tx.token_windows(F.col("t"), 3, 2, tokenizer=pieces.tokenizer).alias("w")).first().w
    plain = [w.translate({ord("▁"): None, ord("⁠"): None}) for w in windows]
    assert plain == ["tokenization un", "unbeliev", "ievable words"][:len(plain)] and len(plain) == 3
    # A window that begins inside a word keeps the borders of its tokens.
    assert spark.createDataFrame([(w,) for w in windows], "w string").select(tx.token_count("w", pieces.tokenizer).alias("n")).collect()[1].n == 3


def test_chunks_by_pieces_respect_the_budget(spark, pieces):
    sentence = "Unbelievable tokenization of improbable words happens everywhere. "
    docs = spark.createDataFrame([(1, sentence * 30), (2, "x" * 4_000), (3, None), (4, "short")], "doc_id int, text string").withColumn("text", pieces.mark("text"))
    chunks = qna.chunk_documents(docs, "text", size=64, overlap=16, tokenizer=pieces.tokenizer)
    counted = chunks.select("doc_id", "chunk_index", tx.token_count("text", pieces.tokenizer).alias("n"), pieces.unmark(F.col("text")).alias("text")).collect()
    assert {r.doc_id for r in counted} >= {1, 2, 4} and max(r.n for r in counted) <= 64 + 16
    assert "▁" not in "".join(r.text for r in counted) and sum(r.doc_id == 2 for r in counted) > 5
