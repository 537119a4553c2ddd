"""Searches with more queries than a task is sent: work is dealt over the cores, and what a task holds is bounded."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreloom.functions import classify as cl
from loreloom.operators import postings as pt, ranking as rk, retrieval as rt
from loreloom.plans import ranking, stores, tables as tb
from loreloom.session import CLEANUP_KEY, ensure_checkpoint_dir, written, written_in_parts


@pytest.fixture(scope="module")
def vectors(spark):
    v = np.random.default_rng(5).normal(size=(900, 6)).astype(np.float32)
    v[300:340] = v[7]
    v[20] = 0.0
    rows = [(i, [float(x) for x in v[i]], [None, "a", "b"][i % 3]) for i in range(len(v))]
    points = spark.createDataFrame(rows, "id long, vector array<float>, group string").repartition(3)
    return points, points.select(F.col("id").alias("qid"), "vector"), v.astype(np.float64)


def cosines(v):
    length = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
    return np.round(unit @ unit.T, 12)


@pytest.mark.parametrize("grouped", [False, True])
def test_blocks_of_queries_find_the_best_of_all_points(spark, vectors, grouped):
    points, queries, v = vectors
    assert rt._blocks(queries) > 1
    found = rt.topk(points, queries, 4, max_broadcast=10, grouped=grouped, skip_self=True)
    got = {}
    for r in found.collect():
        got.setdefault((r.qid, r.group if grouped else 0), []).append((r.rank, round(r.score, 9), r.id))
    s = cosines(v)
    for (qid, group), rows in got.items():
        ids = [i for i in range(len(v)) if i != qid and (not grouped or [None, "a", "b"][i % 3] == group)]
        best = sorted((-s[qid, i], i) for i in ids)[:4]
        assert [x[0] for x in sorted(rows)] == [1, 2, 3, 4]
        assert [x[1] for x in sorted(rows)] == pytest.approx([-x for x, _ in best], abs=1e-8)
    assert len(got) == len(v) * (3 if grouped else 1)


def test_equal_vectors_order_by_id(vectors):
    points, queries, v = vectors
    rows = rt.topk(points, queries.where("qid = 7 OR qid > 850"), 41, max_broadcast=3, skip_self=True).where("qid = 7").orderBy("rank").collect()
    assert [r.id for r in rows[:40]] == list(range(300, 340))


def test_minimum_and_filter_hold_in_blocks(vectors):
    points, queries, v = vectors
    named = queries.withColumn("allow_group", F.when(F.col("qid") % 2 == 0, F.array(F.lit("a"))))
    got = {}
    for r in rt.topk(points, named, 5, max_broadcast=10, filters=["group"], min_score=0.5).collect():
        got.setdefault(r.qid, []).append((r.rank, round(r.score, 9)))
    s = cosines(v)
    for qid in range(len(v)):
        best = sorted((-s[qid, i], i) for i in range(len(v)) if (qid % 2 or i % 3 == 1) and s[qid, i] >= 0.5)[:5]
        assert [score for _, score in sorted(got.get(qid, []))] == pytest.approx([-x for x, _ in best], abs=1e-8)


def test_routes_are_counted_before_they_are_made(vectors):
    points, queries, v = vectors
    metric = rt._Metric.of(points.select("id", "vector"), 4)
    floored = queries.withColumn("__floor", F.lit(-1.0))
    routes = metric.within(floored)
    assert metric.moves(floored) == routes.count() > 3 * rt.ROUTES


def test_equal_questions_are_asked_once_and_pairs_do_not_move(spark):
    r = np.random.default_rng(8)
    words = [[f"w{int(x)}" for x in np.minimum(r.zipf(1.4, 20), 60)] + ["every"] * (i % 3) for i in range(400)]
    words[5], words[6] = [], None
    points = spark.createDataFrame(list(enumerate(words)), "id long, tokens array<string>").repartition(3)
    asked = [["every", "w1"]] * 1_500 + [["w2", "w3", "w4"], ["w1"], ["w1", "unheard"], [], None, ["w7", "w1", "every", "w2"]]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, match array<string>")
    found = rt.text_match(points, queries, max_broadcast=10)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(q, i) for q, m in enumerate(asked) if m for i, t in enumerate(words) if t and set(m) <= set(t)}
    rows = [tuple(x) for x in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_merged_paths_need_no_text_in_their_hits(spark):
    r = np.random.default_rng(2)
    rows = [[(q, "ab"[i % 2], i, float(r.integers(0, 9)), i % 4, f"s{i % 3}", "x" * (i % 5)) for q in range(5) for i in range(n, n + 40)] for n in (0, 20)]
    first, second = (spark.createDataFrame(x, "qid long, collection string, id long, score double, rank long, source_key string, content string") for x in rows)
    short = [df.withColumn("digest", F.unhex(F.sha2("content", 256))).drop("content") for df in (first, second)]
    got, want = (rk.merge_paths(*paths, 24, group=F.col("collection"), **options).select("qid", "collection", "id", "score", "rank").collect()
                 for paths, options in ((short, {"text": F.col("digest")}), ((first, second), {})))
    assert sorted(got) == sorted(want) and len(got) > 20


def test_vectors_and_postings_are_tables_on_disk(spark):
    tokens = [["b", "a", "b"], [], None, ["é", "a", "Z", "a", "a"], ["z"] * 3]
    points = spark.createDataFrame(list(enumerate(tokens)), "id long, tokens array<string>")
    postings, vectors = pt.prepared(points)
    assert all("parquet" in df.inputFiles()[0] for df in (postings, vectors))
    assert {r.id: r.terms for r in vectors.collect()} == {0: ["a", "b"], 3: ["Z", "a", "é"], 4: ["z"]}
    assert {r.id: [round(w, 9) for w in r.weights] for r in vectors.collect()} == {0: [1.0, 1.693147181], 3: [1.0, 2.098612289, 1.0], 4: [2.098612289]}
    weights = {(i, t, round(w, 12)) for r in postings.collect() for t, i, w in zip([r.term] * len(r.ids), r.ids, r.weights)}
    assert weights == {(r.id, r.term, round(r.weight, 12)) for r in pt.point_weights(points).collect()}


BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


def shuffled(spark):
    """Bytes that shuffles hold now."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle"))


def test_written_tables_leave_no_shuffle(spark):
    before, setting = shuffled(spark), spark.conf.get(CLEANUP_KEY, None)
    rows = spark.range(200_000, numPartitions=3).groupBy((F.col("id") * 7).alias("id")).agg(F.count("*").alias("n"))
    tables = [written(rows, "rows"), written_in_parts([rows.where("id % 2 = 0"), rows.where("id % 2 = 1")], "rows")]
    assert [t.count() for t in tables] == [200_000] * 2
    assert shuffled(spark) - before < 100_000 and spark.conf.get(CLEANUP_KEY, None) == setting


def test_pairs_carry_no_vector(spark, monkeypatch):
    r = np.random.default_rng(4)
    own = [[f"own{i}word{j}" for j in range(300)] for i in range(600)]
    tokens = [t + [f"w{int(x)}" for x in r.integers(0, 12, 6)] for t in own]
    points = spark.createDataFrame(list(enumerate(tokens)), "id long, tokens array<string>").repartition(3)
    asked = [(q, [f"w{int(x)}" for x in r.choice(12, 6, replace=False)], [1.0] * 6) for q in range(40)]
    queries = spark.createDataFrame(asked, "qid long, terms array<string>, weights array<double>")
    postings, vectors = pt.prepared(points)
    before = shuffled(spark)
    monkeypatch.setattr(pt, "SEEDS", 200)
    with_broadcast = spark.conf.get(BROADCAST)
    spark.conf.set(BROADCAST, "-1")
    try:
        got = {(x.qid, x.rank): (x.id, x.score) for x in pt.topk(postings, vectors, queries, 3).collect()}
    finally:
        spark.conf.set(BROADCAST, with_broadcast)
    assert shuffled(spark) - before < 500_000
    want = {}
    for q, terms, _ in asked:
        s = [round(float(sum(1 + np.log(t.count(x)) for x in terms if x in t)), 9) for t in tokens]
        want |= {(q, n): (i, s[i]) for n, i in enumerate(sorted(range(len(s)), key=lambda i: (-s[i], i))[:3], 1)}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=1e-8) for x in want)


def test_queries_are_scored_in_blocks(spark, monkeypatch):
    tokens = [[f"w{i % 7}", f"w{i % 5}", "all"] for i in range(60)]
    points = spark.createDataFrame(list(enumerate(tokens)), "id long, tokens array<string>")
    queries = spark.createDataFrame([(q, [f"w{q % 7}", "all"], [2.0, 1.0]) for q in range(30)] + [(7, ["w3"], [0.5])], "qid long, terms array<string>, weights array<double>")
    postings, vectors = pt.prepared(points)
    whole = sorted(tuple(x) for x in pt.topk(postings, vectors, queries, 4).collect())
    monkeypatch.setattr(pt, "QUERY_BLOCK", 4)
    assert sorted(tuple(x) for x in pt.topk(postings, vectors, queries, 4).collect()) == whole and len(whole) == 120


def test_document_texts_have_the_rows_of_points(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "en"), (2, None, "fr"), (3, "c", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for ids in ([1, 1, 1, 3, 9], [1, 3]):
        spark.createDataFrame([(i, [1.0], 0) for i in ids], "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        want = tb.documents_as_points(spark, str(tmp_path)).select("id", "content", "collection")
        got = tb.document_texts(spark, str(tmp_path))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert ("Join" in got._jdf.queryExecution().toString()) == (len(ids) == 5)


def test_points_do_not_move_to_blocks_of_questions(spark, monkeypatch, tmp_path):
    r = np.random.default_rng(6)
    words = [[f"w{int(x)}" for x in r.integers(0, 400, 60)] + [f"own{i}word{j}" for j in range(60)] for i in range(300)]
    spark.createDataFrame(list(enumerate(words)), "id long, tokens array<string>").write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    asked = [[f"w{int(x)}" for x in r.choice(400, 2, replace=False)] for _ in range(260)] + [["w1"]] * 9
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, match array<string>")
    before = shuffled(spark)
    monkeypatch.setattr(rt, "MATCH_BLOCK", 16)
    rows = [tuple(x) for x in rt.text_match(points, queries, max_broadcast=10).collect()]
    want = {(q, i) for q, m in enumerate(asked) for i, t in enumerate(words) if set(m) <= set(t)}
    assert len(rows) == len(want) > 1_000 and set(rows) == want
    assert shuffled(spark) - before < 100_000


def test_hits_of_competition_carry_no_texts(spark, tmp_path):
    r = np.random.default_rng(7)
    names = ["", "e-formula", "the Formula rules", "BAJA car", "an ev", "electric  vehicle"]
    rows = [(i, None if i == 5 else names[i % 6] + " " + " ".join(map(str, r.integers(0, 1 << 40, 400))), "ab"[i % 2], "s", 1) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    v = [(i, [float(x) for x in r.normal(size=4)], int(r.integers(0, 6))) for i in range(120)]
    spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # The same by hits with their texts.
    label = F.col("label").cast("string")
    h = ranking.hits_with_texts(spark, str(tmp_path)).withColumn("competition", cl.lookup(label, {"1": "formula", "2": "baja", "3": "other", "4": "ev"}))
    q = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select(F.col("vec_id").alias("qid"), cl.lookup(label, {"1": "formula", "2": "baja"}).alias("q_competition"))
    want = sorted(tuple(x) for x in rk.same_competition(h.join(q, "qid")).select("qid", "collection", "id").collect())
    setting = spark.conf.get(BROADCAST)
    spark.conf.set(BROADCAST, "-1")
    try:
        before = shuffled(spark)
        got = sorted(tuple(x) for x in ranking.hits_of_competition(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set(BROADCAST, setting)
    assert shuffled(spark) - before < 1_000_000
    assert got == want and 2_000 < len(got) < 120 * 48


def test_vectors_by_shares_of_blocks_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(rt, "BLOCK_WORDS", 60)
    r = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in r.integers(0, 50, int(r.integers(0, 25))))) for i in range(150)] + [(3, "w1 again"), (None, "w2"), (None, "w2 w3"), (200, None), (201, "")]
    for docs in (spark.createDataFrame(rows, "id long, text string").repartition(4), spark.createDataFrame(rows[:40], "id long, text string"), spark.createDataFrame([], "id long, text string")):
        whole, shared = (rt.lexical_vectors(docs, "id", "text", **options)[0] for options in ({}, {"shares": 3}))
        assert sorted(map(str, whole.collect())) == sorted(map(str, shared.collect())) and whole.dtypes == shared.dtypes


def test_a_copy_holds_no_more_than_itself(spark, tmp_path):
    r = np.random.default_rng(11)
    docs = [(i, " ".join(f"word{x}" for x in r.integers(0, 1 << 30, 300)) if i % 9 else None, "en") for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i)], i % 3) for i in range(0, 400, 2)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    ensure_checkpoint_dir(spark)
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before, there = shuffled(spark), set(shared.iterdir())
    copied = stores.enriched_copy(spark, str(tmp_path))
    assert shuffled(spark) - before < 500_000
    assert {x.name.split("-")[0] for x in set(shared.iterdir()) - there} == {"copy", "differences", "often"}
    want = {(i, len(set((t or "").split())), int(i % 2 == 1), 0) for i, t, _ in docs}
    assert {tuple(x) for x in copied.collect()} == want
