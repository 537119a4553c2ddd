import numpy as np
import pytest
from pyspark.sql import functions as F

from loreloom.operators import evaluation as ev, ranking as rk, retrieval as rt

RNG = np.random.default_rng(5)
DIM = 6


@pytest.fixture(scope="module")
def data(spark):
    vectors = RNG.normal(size=(120, DIM)).round(1)
    vectors[40:80] = vectors[40]  # a third of the points are copies of one
    vectors[100] = 0.0
    groups = [["a", "b", "c"][i % 3] for i in range(120)]
    words = [[f"t{j}" for j in RNG.integers(0, 12, size=5)] for _ in range(120)]
    points = spark.createDataFrame([(i, vectors[i].tolist(), groups[i], words[i]) for i in range(120)],
                                   "id long, vector array<double>, group string, tokens array<string>").repartition(5)
    asked = RNG.normal(size=(9, DIM)).round(1)
    allowed = [None, ["a"], ["b", "c"], [], ["a"], None, ["c"], ["z"], ["a", "b", "c"]]
    match = [[f"t{j}" for j in set(RNG.integers(0, 12, size=2))] for _ in range(9)]
    weights = [[float(x) for x in RNG.integers(1, 5, size=len(m))] for m in match]
    queries = spark.createDataFrame([(100 + i, asked[i].tolist(), allowed[i], match[i], match[i], weights[i]) for i in range(9)],
                                    "qid long, vector array<double>, allow_group array<string>, match array<string>, terms array<string>, weights array<double>")
    return points, queries, vectors, groups, words, asked, allowed, match, weights


def cosine_matrix(q, p):
    nq, np_ = np.linalg.norm(q, axis=1, keepdims=True), np.linalg.norm(p, axis=1, keepdims=True)
    q, p = q / np.where(nq > 0, nq, 1), p / np.where(np_ > 0, np_, 1)
    return q @ p.T


def best(scores, k, keep=lambda q, p: True, group=None):
    out = {}
    for q in range(scores.shape[0]):
        seen = {}
        rows = sorted((p for p in range(scores.shape[1]) if keep(q, p)), key=lambda p: (-round(scores[q, p], 9), p))
        for p in rows:
            g = group[p] if group else None
            if seen.get(g, 0) < k:
                seen[g] = seen.get(g, 0) + 1
                out.setdefault((q, g), []).append(p)
    return out


def found(df, grouped=False):
    out = {}
    df = df.withColumn("score", F.round("score", 9))
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault((r.qid - 100, r.group if grouped else None), []).append((r.id, r.score))
    return out


def same_up_to_ties(got, want, scores):
    assert set(got) == set(want)
    for key, ids in want.items():
        assert [round(scores[key[0], p], 6) for p in ids] == [round(s, 6) for _, s in got[key]]
        assert len({i for i, _ in got[key]}) == len(ids)


@pytest.mark.parametrize("options", [{}, {"max_broadcast": 4, "points_per_cell": 30}, {"seed_fraction": 0.5}])
def test_dense_against_numpy(data, options):
    points, queries, vectors, groups, *_, asked, allowed, _, _ = data
    s = cosine_matrix(asked, vectors)
    same_up_to_ties(found(rt.topk(points, queries, 7, **options)), best(s, 7), s)
    grouped = rt.topk(points, queries, 4, grouped=True, **options)
    same_up_to_ties(found(grouped, True), best(s, 4, group=groups), s)
    ok = lambda q, p: allowed[q] is None or groups[p] in allowed[q]
    filtered = rt.topk(points, queries, 5, filters=["group"], **options)
    same_up_to_ties(found(filtered), best(s, 5, ok), s)


def test_exact_copies_rank_by_id(data, spark):
    points, *_ = data
    q = points.where("id = 40").select(F.lit(100).cast("long").alias("qid"), "vector")
    got = [r.id for r in rt.topk(points, q, 10).orderBy("rank").collect()]
    assert got == list(range(40, 50))


def test_zero_vector_scores_zero_and_self_is_left_out(data):
    points, queries, *_ = data
    scores = {r.id: r.score for r in rt.topk(points, queries.where("qid = 101"), 120).collect()}
    assert scores[100] == 0.0
    mine = rt.topk(points, queries.withColumn("qid", F.col("qid") - 100), 120, skip_self=True)
    assert mine.where("id = qid").count() == 0


@pytest.mark.parametrize("options", [{}, {"max_broadcast": 4, "points_per_cell": 30}])
def test_sparse_and_match_against_loops(data, options):
    points, queries, vectors, groups, words, asked, _, match, weights = data
    s = np.zeros((9, 120))
    for q in range(9):
        for p in range(120):
            for t, w in zip(match[q], weights[q]):
                n = words[p].count(t)
                s[q, p] += w * (1 + np.log(n)) if n else 0
    hit = lambda q, p: any(t in words[p] for t in match[q])
    same_up_to_ties(found(rt.topk(points, queries, 6, arm="sparse", **options)), best(s, 6, hit), s)
    c = cosine_matrix(asked, vectors)
    every = lambda q, p: all(t in words[p] for t in match[q])
    want = best(c, 6, every)
    same_up_to_ties(found(rt.topk(points, queries, 6, match=True, **options)), want, c)
    pairs = {(q + 100, p) for q in range(9) for p in range(120) if every(q, p)}
    for bound in (100, 2):
        assert {tuple(r) for r in rt.text_match(points, queries, max_broadcast=bound).collect()} == pairs


@pytest.mark.parametrize("bound", [10, 1])
def test_rows_without_vector_are_skipped(spark, bound):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(8, None), (9, [1.0, 0.0])], "qid long, vector array<double>")
    got = rt.topk(points, queries, 5, max_broadcast=bound).orderBy("rank").collect()
    assert [(r.qid, r.id, r.score) for r in got] == [(9, 1, 1.0), (9, 3, 0.0)]


def test_tasks_without_points_emit_nothing(spark):
    points = spark.createDataFrame([("a", [1.0], "g")], "id string, vector array<double>, group string").repartition(6)
    queries = spark.createDataFrame([("q", [1.0])], "qid string, vector array<double>")
    assert [tuple(r) for r in rt.topk(points, queries, 3, grouped=True).collect()] == [("q", "g", "a", 1.0, 1)]
    assert rt.topk(points.limit(0), queries, 3).count() == 0 and rt.topk(points, queries.limit(0), 3).count() == 0


def test_encoder_plug(spark):
    from loreloom.functions.encode import dense_encoder

    def lengths():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("a b a",), ("",), (None,), ("A B A",)], "t string")
    spark.udf.register("encode_text", dense_encoder())
    own = np.array([list(r.v) for r in df.selectExpr("encode_text(t) AS v").collect()])
    assert own.shape == (4, 256) and np.allclose(np.linalg.norm(own, axis=1), [1, 0, 0, 1]) and np.allclose(own[0], own[3])
    assert sorted(np.abs(own[0][own[0] != 0]).round(4)) == [0.4472, 0.8944]
    plugged = dense_encoder(lengths, batch_size=2)
    assert [list(r.v) for r in df.select(plugged("t").alias("v")).collect()] == [[5, 1], [0, 1], [0, 1], [5, 1]]
    assert df.limit(0).select(plugged("t").alias("v")).schema["v"].dataType.simpleString() == "array<float>"


def test_given_sparse_vectors(spark):
    points = spark.createDataFrame([(1, ["a", "b"], [1.0, 2.0]), (2, ["b"], [5.0]), (3, [], [])], "id long, terms array<string>, weights array<double>")
    queries = spark.createDataFrame([(9, ["b", "c"], [3.0, 1.0])], "qid long, terms array<string>, weights array<double>")
    assert [(r.id, r.score) for r in rt.topk(points, queries, 5, arm="sparse").orderBy("rank").collect()] == [(2, 15.0), (1, 6.0)]


def test_fusion(spark):
    rows = [(1, "x", 0.9, 1, "dense"), (1, "y", 0.8, 2, "dense"), (1, "y", 7.0, 1, "text"), (2, "z", 1.0, 1, "dense")]
    hits = spark.createDataFrame(rows, "qid long, id string, score double, rank long, arm string")
    rrf = {(r.qid, r.id): r.score for r in rt.reciprocal_rank_fusion(hits, 5).collect()}
    assert rrf[1, "y"] == pytest.approx(1 / 62 + 1 / 61) and rrf[1, "x"] == pytest.approx(1 / 61)
    dbsf = {(r.qid, r.id): r.score for r in rt.distribution_fusion(hits, 5).collect()}
    sd = np.std([0.9, 0.8], ddof=1)
    assert dbsf[1, "y"] == pytest.approx(0.5 + (0.8 - (0.85 - 3 * sd)) / (6 * sd)) and dbsf[2, "z"] == 0.5


def pool(spark, seed, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((int(rng.integers(0, 3)), f"p{i:03d}", float(rng.integers(0, 1000) / 1000), str(rng.choice(["qna", "kb", "rules-a"])),
                     None if rng.random() < 0.2 else str(rng.integers(0, 9)), str(rng.choice(["", "k1", "k2"])), str(rng.choice(["", "c"])), ""))
    return rows, spark.createDataFrame(rows, "qid long, id string, score double, collection string, post_id string, source_key string, chapter string, section string")


@pytest.mark.parametrize("seed", range(4))
def test_caps_and_balance_equal_a_sequential_walk(spark, seed):
    rows, df = pool(spark, seed)
    walked, balanced = {}, {}
    for q in range(3):
        posts, sections, out = {}, {}, []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[3], r[1])):
            if r[4] is not None:
                if posts.get(r[4], 0) >= 2:
                    continue
                posts[r[4]] = posts.get(r[4], 0) + 1
            key = r[5:8]
            if any(key):
                if sections.get(key, 0) >= 2:
                    continue
                sections[key] = sections.get(key, 0) + 1
            out.append(r)
        walked[q] = [r[1] for r in out]
        counts, kept = {}, []
        groups = {r[3] for r in out}
        for r in out:
            if len(kept) >= 9:
                break
            if len(out) > 9 and len(groups) > 1 and counts.get(r[3], 0) >= 8:
                continue
            counts[r[3]] = counts.get(r[3], 0) + 1
            kept.append(r[1])
        balanced[q] = kept
    capped = rk.cap_repeats(df)
    assert {q: [r.id for r in capped.where(f"qid = {q}").orderBy("rank").collect()] for q in range(3)} == walked
    b = rk.balance(capped, 9)
    assert {q: [r.id for r in b.where(f"qid = {q}").orderBy("rank").collect()] for q in range(3)} == balanced


def test_balance_counts(spark):
    rows = [(1, f"r{i}", 1.0 - i / 100, "rules-x") for i in range(24)] + [(1, f"q{i}", 0.5 - i / 100, "qna") for i in range(8)] + [(1, f"k{i}", 0.3 - i / 100, "kb") for i in range(8)]
    df = spark.createDataFrame(rows, "qid long, id string, score double, collection string")
    assert tuple(rk.candidate_counts(rk.balance(df, 24)).first()) == (1, 12, 8, 4, 0)


def test_penalties_labels_and_answers(spark):
    rows = [("1", "kb", "aark", "미해결", "x"), ("2", "kb", "aark", "단일제보", "x"), ("3", "qna", "", "", "답변 없음"), ("4", "kb", "", "", "답변 없음"), ("5", "qna", "", "", "[답변] y")]
    df = spark.createDataFrame(rows, "id string, collection string, source_type string, confidence string, content string")
    got = {r.id: r.p for r in df.select("id", rk.evidence_penalty(df).alias("p")).collect()}
    assert got == {"1": 2.0, "2": 0.5, "3": 0.0, "4": 2.0, "5": 0.0}
    assert {r.id for r in rk.answered_only(df).collect()} == {"1", "2", "4", "5"}


def test_source_labels(spark):
    rows = [("aark", None, "3", "Frame", "Tubes", "Choice", "합의됨", None, None, None), ("rules", None, None, None, None, None, None, "judging", "심사규정", "Book"),
            ("", "Post", "1", "x", None, None, None, None, None, None), ("", None, "2", "차량", "휠", None, None, None, None, None), ("", None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "source_type string, title string, chapter_num string, chapter string, section string, topic string, confidence string, "
                                     "document_type string, document_type_label string, source_title string")
    df = df.withColumns({"competition": F.lit("baja"), "category": F.lit("EV"), "url": F.lit("u"), "source_url": F.lit("s")})
    got = [(r.source, r.url) for r in rk.source_label(df).collect()]
    assert got == [("[AARK·합의됨] 3. Frame > Tubes > Choice", ""), ("[규정(심사규정)]/baja Book", "s"), ("[EV] Post", "u"), ("제2장 차량 > 휠", ""), ("", "")]


def test_routing(spark):
    active = spark.createDataFrame([("formula", "vehicle-technical"), ("other", "judging")], "competition_key string, document_type_key string")
    rows = [(1, "e_formula", "vehicle-technical", "배기"), (2, "ev", "vehicle-technical", "모터"), (3, "formula", "judging", "심사 기준"), (4, "formula", "judging", "심사규정"), (5, None, "safety", "안전 규정"), (6, "baja", None, "x")]
    q = spark.createDataFrame(rows, "qid long, competition string, document_type string, query string")
    out = rk.route_document_type(rk.route_competition(q, active), active)
    got = {r.qid: (r.competition_filter, r.document_type_filter) for r in out.collect()}
    assert got == {1: ("formula", "vehicle-technical"), 2: ("ev", None), 3: ("formula", None), 4: ("formula", "judging"), 5: (None, None), 6: ("baja", None)}


def test_competition_filter_and_status(spark):
    rows = [(1, "formula", "a"), (1, "baja", "b"), (1, None, "바하 이야기"), (1, None, "nothing"), (1, "other", "c")]
    df = spark.createDataFrame(rows, "qid long, competition string, content string").withColumn("q_competition", F.lit("formula"))
    assert sorted(r.content for r in rk.same_competition(df).collect()) == ["a", "c", "nothing"]
    s = spark.createDataFrame([("ok", "failed"), ("failed", "failed"), ("ok", "ok"), ("partial", "ok"), ("partial", "failed")], "a string, b string")
    assert [r.m for r in s.select(rk.merge_status(F.col("a"), F.col("b")).alias("m")).collect()] == ["partial", "failed", "ok", "partial", "partial"]


def test_relevance_falls_back_without_scores(spark):
    rows = [(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "c", 0.7, 1), (2, "d", 0.6, 2)]
    hits = spark.createDataFrame(rows, "qid long, id string, score double, rank long").withColumn("collection", F.lit("x"))
    scores = spark.createDataFrame([(1, "b", 9.0)], "qid long, id string, relevance double")
    got = [(r.qid, r.id, r.rank) for r in rk.apply_relevance(hits, scores, 5).orderBy("qid", "rank").collect()]
    assert got == [(1, "b", 1), (2, "c", 1), (2, "d", 2)]


def test_context_without_sources(spark):
    q = spark.createDataFrame([(1, "이거 뭐야", "다른 말")], "qid long, query string, search string")
    hits = spark.createDataFrame([], "qid long, rank long, source string, url string, content string, competition string")
    from loreloom.operators.conversation import needs_clarification

    text = rk.context_pack(hits, q, search_query="search", clarify=needs_clarification(F.col("query"))).first().prompt
    assert text.startswith("질문에 직접 관련된 참고 문서를 찾지 못했습니다.") and "(검색에 사용된 쿼리: 다른 말)" in text
    assert "(질문이 불완전합니다." in text and text.endswith("사용자 질문: 이거 뭐야")


def test_unique_codes_against_containment(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"{w}{rng.integers(0, 40)}{s}" for w, s in zip(rng.choice(["QS", "KLS-", "ab", "9x"], 6), rng.choice(["", "H", "ZZ-1", "."], 6))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    import re

    code = re.compile(r"\b(?=[A-Za-z0-9-]{4,})(?=[^\s]*[A-Za-z])(?=[^\s]*\d)[A-Za-z0-9-]+\b")
    tokens = {t for x in texts for t in code.findall(x) if len(t) >= 5}
    want = {t: next(i for i, x in enumerate(texts) if t in x) for t in tokens if sum(t in x for x in texts) == 1}
    assert {r.token: r.key for r in ev.unique_codes(df, "key", "text").collect()} == want and want
    q = ev.lexical_queries(df, "key", "text", cap=5).collect()
    assert len(q) == 5 and all(want[r.query] == r.gold for r in q)
    assert [tuple(r) for r in q] == [tuple(r) for r in ev.lexical_queries(df.repartition(3), "key", "text", cap=5).collect()]


def test_rule_queries_and_relevance(spark):
    rows = [("1", "총칙", "1", "목적", 0, "[제1장] 총칙\n[제1조] 목적\n이 규정은 대회의 목적을 정한다고 합니다. 둘째 문장"), ("1", "총칙", "1", "목적", 1, "rest"), ("1", "총칙", "2", "", 0, "no title")]
    df = spark.createDataFrame(rows, "chapter_num string, chapter string, section_num string, section string, chunk_index int, text string")
    got = {(r.task, r.query) for r in ev.section_queries(df, order=[F.col("text")]).collect()}
    assert got == {("title", "제1조 목적"), ("body", "이 규정은 대회의 목적을 정한다고 합니다.")}


def test_metrics_of_no_queries(spark):
    none = spark.createDataFrame([], "qid long")
    hits = spark.createDataFrame([], "qid long, rank long")
    assert tuple(ev.metrics(none, hits, F.lit(True)).first()) == (0, 0.0, 0.0, 0.0)


def plain_vectors(docs):
    """A row for every word of a document, joined with the frequencies."""
    n = docs.count()
    pairs = rt.term_counts(docs, "id", "text").join(rt.document_frequency(docs, "text"), "term")
    return rt.sparse_vectors(pairs.select("id", "term", ((1.0 + F.log("tf")) * F.log(1.0 + n / F.col("df"))).alias("weight")), "id")


def test_lexical_vectors_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rt, "BLOCK_WORDS", 40)
    monkeypatch.setattr(rt, "PART", 50)
    r = np.random.default_rng(8)
    texts = [" ".join(["hot"] * int(r.integers(1, 4)) + [f"W{j}é" for j in r.integers(0, 60, size=int(r.integers(0, 30)))]) for _ in range(200)]
    rows = [*enumerate(texts), (200, None), (201, ""), (202, "a ! ?"), (203, "lone " * 300), (None, "no id here"), (None, "no id again"), (7, "hot more"), (7, "hot more"), (9, None)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    vectors, parts = rt.lexical_vectors(docs, "id", "text")

    def as_set(df):
        return {(x.id, tuple(x.terms), tuple(round(w, 9) for w in x.weights)) for x in df.collect()}

    assert parts > 10 and vectors.columns == ["id", "terms", "weights"] and vectors.count() == 202
    assert as_set(vectors) == as_set(plain_vectors(docs))
    long = {(x.id, x.term, round(x.weight, 9)) for x in rt.lexical_weights(docs, "id", "text").collect()}
    assert long == {(i, t, w) for i, terms, weights in as_set(vectors) for t, w in zip(terms, weights)}
    assert rt.lexical_vectors(docs.limit(0), "id", "text")[0].count() == 0


def test_a_word_on_every_document_is_one_row_a_block(spark):
    docs = spark.range(3_000).select("id", F.concat(F.lit("everywhere w"), F.col("id")).alias("text")).repartition(2)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = rt.lexical_vectors(docs, "id", "text")[0]._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    # Frequencies meet blocks, and neither words of a document nor documents are keys of an aggregate.
    assert "Generate explode" not in plan and "keys=[id" not in plan and "keys=[block" in plan
