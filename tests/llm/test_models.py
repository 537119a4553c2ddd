import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loreloom.llm import language_id, neighbours, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def labelled(spark, n=400):
    """Insults and group names are harmless alone; together they are toxic."""
    r = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{r.randrange(200)}" for _ in range(30)]
        insult, group = i % 2 == 0, i % 4 < 2
        words += ["scoundrel"] * insult + ["townsfolk"] * group
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_pairs_are_learned(spark):
    docs, labels = labelled(spark)
    rows = toxicity.toxic_scores(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and held
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_scores_are_the_sums_over_all_pairs():
    rng = np.random.default_rng(6)
    known = rng.random(toxicity.SPACE) < 0.5
    machine = toxicity.Machine(-0.3, rng.normal(size=toxicity.SPACE), rng.normal(size=(3, toxicity.SPACE)), known)
    docs = [rng.choice(np.flatnonzero(known), n, replace=False) for n in (0, 1, 2, 7, 40)]
    got = machine.scores(len(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs))
    for doc, score in zip(docs, got, strict=True):
        pairs = sum(float(machine.factors[:, a] @ machine.factors[:, b]) for n, a in enumerate(doc) for b in doc[:n])
        total = machine.bias + machine.weights[doc].sum() + pairs / max(len(doc), 1)
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_given_columns_of_any_name_are_kept(spark, odd_docs):
    from pyspark.sql import functions as F

    named = odd_docs.withColumns({"__score": F.lit("s"), "__text": F.lit("t"), "__id": F.lit(1)})
    labels = spark.createDataFrame([(1, 0), (7, 1)], "doc_id long, toxic int")
    left = toxicity.drop_toxic(named, labels)
    assert left.columns == named.columns and {r["__score"] for r in left.collect()} <= {"s"}


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(spark, 200)
    other = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.toxic_scores(docs, labels).collect())) == sorted(map(tuple, toxicity.toxic_scores(docs, other).collect()))


def test_toxicity_of_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (10, 0), (7, 0), (9, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        rows = toxicity.toxic_scores(odd_docs, labels).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.toxic_scores(no_docs, labels).count() == 0
    assert toxicity.drop_toxic(odd_docs, none).count() == odd_docs.count()


def test_forward_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "▁ab"])}
    prob = np.array([[0.1, 0.2, 0.3, 0.15, 0.05, 0.2, language_id.UNKNOWN]])

    def brute(word):
        if not word:
            return 1.0
        heads = [(p, prob[0, i]) for p, i in pieces.items() if word.startswith(p)]
        if not any(len(p) == 1 for p, _ in heads):
            heads.append((word[0], language_id.UNKNOWN))
        return sum(q * brute(word[len(p):]) for p, q in heads)

    words = ["▁ab", "▁abab", "▁b", "▁c", "abc", "a"]
    lattice = language_id.Lattice(words, language_id.Pieces(pieces))
    got = lattice.forward(prob)[0, np.arange(len(words)), lattice.size]
    assert got == pytest.approx([brute(w) for w in words])
    # Expected uses weigh every piece of a segmentation by the segmentation's share.
    uses = lattice.expected(prob[0], np.ones(len(words)))
    assert uses[:-1] @ [len(p) for p in pieces] + uses[-1] == pytest.approx(sum(map(len, words)))


def test_languages(spark, odd_docs, no_docs):
    texts = {"en": "the house and the garden with this weather", "de": "der Garten und das Haus mit diesem Wetter", "fr": "le jardin et la maison avec ce temps"}
    r, rows = random.Random(2), []
    for i in range(150):
        lang = list(texts)[i % 3]
        words = texts[lang].split()
        rows.append((i, " ".join(r.choice(words) for _ in range(12)).upper() if i % 7 == 0 else " ".join(r.choice(words) for _ in range(12)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.languages(docs, MODEL).join(docs, "doc_id").collect()
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    assert np.mean([g.lang_pred == g.lang for g in got if g.held_out]) > 0.95 and all(0 <= g.score <= 1 for g in got)
    odd = language_id.languages(odd_docs, MODEL).collect()
    assert len(odd) == odd_docs.count()
    assert {g.lang_pred for g in odd if g.doc_id in (3, 4, 5, 6)} == {"und"} and {g.score for g in odd if g.doc_id in (3, 4, 5, 6)} == {0.0}
    assert language_id.languages(no_docs, MODEL).count() == 0
    blind = language_id.languages(docs.withColumn("lang", F.lit(None).cast("string")), MODEL).collect()
    assert {g.lang_pred for g in blind} == {"und"}


def test_long_words_are_scored_whole():
    assert "".join(language_id.words_of("x" * 100)) == "▁" + "x" * 100
    assert language_id.words_of("É²a 12 _") == ["▁é²a"] and language_id.words_of("² ½ 12") == []


def vectors(spark, n=3000, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    x = centres[rng.integers(0, 30, n)] + 0.5 * rng.normal(size=(n, dim))
    return x, spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST", 300)
    x, df = vectors(spark)
    rows = neighbours.neighbours(df, F.col("vec_id") % 100 == 0, 10).collect()
    hits = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [r.score for r in mine] == pytest.approx([d[r.vec_id] for r in mine], rel=1e-12)
        hits += len({r.vec_id for r in mine} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / len(rows) >= 0.9


@pytest.mark.parametrize("n", [500, 2000])
def test_probes_are_the_same_at_every_size(spark, n):
    """What is found is what the probed buckets hold, not what brute force finds."""
    x, df = vectors(spark, n, 64)
    asking = np.arange(0, n, 20)
    d = np.sqrt(((x[asking, None] - x[None]) ** 2).sum(2))
    d[np.arange(len(asking)), asking] = np.inf
    truth = [set(row[:10].tolist()) for row in np.argsort(d, axis=1, kind="stable")]
    for probes in (8, neighbours.PROBES):
        seen = np.zeros(d.shape, bool)
        for table in range(neighbours.TABLES):
            own = neighbours.probed(x, table, 1, 1)[:, 0]
            seen |= (neighbours.probed(x[asking], table, probes, 1)[:, :, None] == own).any(1)
        want = {(int(q), int(i)) for q, row in zip(asking, np.where(seen, d, np.inf), strict=True) for i in np.argsort(row, kind="stable")[:10] if row[i] < np.inf}
        rows = neighbours.neighbours(df, F.col("vec_id") % 20 == 0, 10, probes=probes).collect()
        assert {(r.query_id, r.vec_id) for r in rows} == want
        found = sum(r.vec_id in truth[r.query_id // 20] for r in rows) / len(rows)
        assert found >= 0.95 if probes == neighbours.PROBES else found < 1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 2.0]), (None, [1.0, 1.0]), (9, [1.0]), (8, [0.0, 2.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.neighbours(df, F.lit(True), 10).collect()}
    assert [got[0, i][0] for i in (1, 2, 3)] == [6, 7, 8] and got[0, 3][1] == 5 ** 0.5
    assert (0, 4) not in got and (1, 1) not in got and (9, 1) not in got and got[8, 1] == (0, 5 ** 0.5)
    assert neighbours.neighbours(df.limit(0), F.lit(True), 10).count() == 0


def test_a_hot_vector_and_cut_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP", 16)
    x, _ = vectors(spark, 300, 8, 1)
    rows = [(i, [1.0] * 8 if i % 3 == 0 else x[i].tolist()) for i in range(300)]
    got = neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 10).collect()
    first = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0)
    assert first == [(i, 3 * i, 0.0) for i in range(1, 11)]
