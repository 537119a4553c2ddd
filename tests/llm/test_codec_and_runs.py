import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loreloom.llm import periodic_runs, piece_codec
from test_tokens import HARD

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return piece_codec.Codec(f.read()).prepare()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


# --- SentencePiece ---------------------------------------------------------------------------------------------------

def test_ids_and_texts_are_those_of_the_library(codec, library):
    r = random.Random(3)
    texts = HARD + ["x" * 5_000, " ".join(["abc"] * 3_000), "日" * 300, "▁" * 100, "  " * 90, "ab" * 500]
    texts += ["".join(r.choice("  \n▁ab ctheing日é🙂\0\t.,0<s>") for _ in range(r.randrange(120))) for _ in range(500)]
    for text, found in zip(texts, codec.encode(texts), strict=True):
        ids = np.frombuffer(found, np.uint32)
        assert ids.tolist() == library.encode(text)
        assert codec.decode(ids) == library.decode(ids.tolist())
        assert codec.decimals(ids).decode() == ",".join(map(str, ids.tolist()))


def test_any_ids_decode_as_in_the_library(codec, library):
    r = random.Random(4)
    for _ in range(500):
        ids = [r.choice([0, 1, 2, 3, 13, 200, 259, 260, 264, 28705, r.randrange(32_000), r.randrange(3, 259)]) for _ in range(r.randrange(9))]
        assert codec.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_both_agendas_agree(codec, monkeypatch):
    r = random.Random(5)
    parts = ["▁" + "".join(r.choice("theinganddié🙂") for _ in range(r.randrange(1, 40))) for _ in range(300)]
    columns = codec.words.ids(parts)
    monkeypatch.setattr(piece_codec, "LONG", 0)
    heap = codec.words.ids(parts)
    assert np.array_equal(columns[0], heap[0]) and np.array_equal(columns[1], heap[1])


def test_texts_that_are_not_cut(library, codec, monkeypatch):
    with open(MODEL, "rb") as f:
        whole = piece_codec.Codec(f.read()).prepare()
    whole.words.apart = False
    texts = ["", "a  b c\n d", " x", "the same text " * 40]
    assert [np.frombuffer(i, np.uint32).tolist() for i in whole.encode(texts)] == library.encode(texts)


def test_a_difference_fails(codec):
    with open(MODEL, "rb") as f:
        other = piece_codec.Codec(f.read()).prepare()
    other.words.rank = other.words.rank[::-1].copy()
    with pytest.raises(ValueError, match="differ"):
        other.encode(["several words of an ordinary text"])


@pytest.mark.parametrize("most", [3, 300_000])
def test_round_trips(spark, odd_docs, no_docs, library, monkeypatch, most):
    monkeypatch.setattr(piece_codec, "CACHE", most)
    docs = odd_docs.collect()
    want = []
    for r in docs:
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert by_text(piece_codec.round_trips(odd_docs, MODEL).collect()) == by_text(want)
    assert piece_codec.round_trips(no_docs, MODEL).count() == 0
    ids = piece_codec.encoded(odd_docs, MODEL)
    assert by_text((r.doc_id, r.ids) for r in ids.collect()) == by_text((r.doc_id, library.encode(r.text or "")) for r in docs)
    texts = piece_codec.decoded(ids.withColumn("text", F.lit("clash")), MODEL)
    assert by_text(texts.collect()) == by_text((r.doc_id, library.decode(library.encode(r.text or ""))) for r in docs)
    assert piece_codec.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), MODEL).orderBy("doc_id").collect() == [(1, None), (2, "")]


def test_whole_table(spark, library):
    docs = spark.read.parquet(DOCUMENTS)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert by_text(piece_codec.round_trips(docs, MODEL).collect()) == by_text(want)


# --- periodic runs ---------------------------------------------------------------------------------------------------

def brute_runs(w, least=6, exponent=4):
    numbers = {x: i for i, x in enumerate(dict.fromkeys(w))}
    a, out = np.array([numbers[x] for x in w], int), []
    for p in range(1, len(w) // exponent + 1):
        same = np.concatenate([[False], a[p:] == a[:-p], [False]])
        for i, j in np.flatnonzero(np.diff(same)).reshape(-1, 2).tolist():
            n = j - i + p
            if n >= max(least, exponent * p) and not any(np.array_equal(a[i:i + n - q], a[i + q:i + n]) for q in range(1, p)):
                out.append((i, n, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for a, m, p in found for i in range(a + p, a + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped).decode()
    return doc_id, len(found), *best, milli, sha("".join(f"{a},{m},{p}\n" for a, m, p in found)), sha(kept)


def test_runs_of_random_words():
    r = random.Random(1)
    found = 0
    for _ in range(600):
        w = [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randrange(60))]
        if r.random() < 0.5:
            u = [r.randrange(3) for _ in range(r.randrange(1, 9))]
            w = w[:10] + u * r.randrange(2, 8) + u[:r.randrange(len(u) + 1)] + w[10:25] + u * r.randrange(1, 6)
        for least, exponent in ((6, 4), (2, 2), (6, 3)):
            want = brute_runs(w, least, exponent)
            assert periodic_runs.runs(w, least, exponent) == want
            found += len(want)
    assert found > 5_000


def test_long_repetitions():
    for unit in (1, 2, 4_999, 5_000):
        words = [i % unit for i in range(20_003)]
        assert periodic_runs.runs(words) == [(0, 20_003, unit)]
    assert periodic_runs.runs([i % 5_001 for i in range(20_003)]) == []
    a, b = "a", "ab"
    while len(b) < 10_000:
        a, b = b, b + a
    assert periodic_runs.runs(list(b[:2_000]), 2, 3) == brute_runs(b[:2_000], 2, 3)


def test_stretches_lose_no_run():
    words = "x y a b a b a b a b z a b q a b".split()
    assert list(periodic_runs.stretches(words)) == [(2, 10)] and periodic_runs.runs(words) == [(2, 8, 2)]


@pytest.mark.parametrize("name", ["odd_docs", "skewed_docs", "no_docs"])
def test_run_rows(request, name):
    docs = request.getfixturevalue(name)
    got = periodic_runs.digests(periodic_runs.run_table(periodic_runs.with_planted_runs(docs)))
    assert by_text(got.collect()) == by_text(brute_row(r.doc_id, r.text, True) for r in docs.collect())


def test_run_table(spark):
    text = "go  on\n" + "la la la la\tla la la " + "a\x1cb a\x1cb " * 4 + "end"
    docs = spark.createDataFrame([(1, text, 7), (1, text, 8), (None, None, 9)], "doc_id long, text string, runs int")
    one, two, none = periodic_runs.run_table(docs).orderBy(F.col("doc_id").desc_nulls_last()).collect()
    assert one == two and [tuple(r) for r in one.runs] == [(2, 7, 1), (9, 8, 1)] and one.n_words == 18
    assert tuple(one.strongest) == (9, 8, 1) and one.collapsed == "go on la a\x1cb end"
    assert (none.n_words, none.runs, none.strongest, none.collapsed) == (0, [], None, "")


def test_whole_table_of_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = periodic_runs.digests(periodic_runs.run_table(periodic_runs.with_planted_runs(docs))).collect()
    assert sum(r.n_runs for r in got) > 5
    assert by_text(got) == by_text(brute_row(r.doc_id, r.text, True) for r in docs.collect())
