import random

from pyspark.sql import functions as F

from loreloom.operators import board, conversation as cv, ordered, pages

LIST = """<html><body><table><tr><th>no</th></tr>
<tr><td>12</td><td>EV</td><td><a href="?number=900&mode=view">Question one</a></td><td>Ann</td><td></td><td>1,203</td><td>2025-01-02</td></tr>
<tr><td>13</td><td>EV</td><td><img src="/i/bl_reply.png"><a href="?number=901">Question one</a></td><td>Bob</td><td></td><td>x</td><td>2025-01-03</td></tr>
<tr><td>notice</td><td>-</td><td><a href="?number=1">Pinned</a></td><td>a</td><td></td><td>1</td><td>d</td></tr>
<tr><td>14</td><td>EV</td><td>no link</td><td>a</td><td></td><td>1</td><td>d</td></tr>
<tr><td>15</td><td>EV</td><td><a href="?mode=view">No number</a></td><td>Cy</td><td></td><td>7</td><td>2025-01-04</td></tr></table></body></html>"""

DETAIL = """<table class="x tblDef"><tr><td class="bg">A &amp; B</td></tr><tr><th>by</th><td>Ann</td><th>on</th><td>2025-01-02</td><th>hits</th><td>2,001</td></tr>
<tr><td class="con"><p>first  line</p>second<br>third<script>x()</script></td></tr><tr><th class="th">첨부파일</th><td><a href="/f/1.pdf">1</a></td></tr></table>"""

FILES = """<table><tr><td>1</td><td><a href="/bbs/?number=77&mode=view">2026 Baja 심사규정</a></td>
<td><a href="/func/download.php?filename=one%20a.pdf&n=1">x</a><a href="https://cdn.example/func/download.php?n=2"><img src="i.gif" alt="two"></a><a href="/other">z</a></td><td>Ann</td><td>2026-02-01</td></tr>
<tr><td>2</td><td><a href="/bbs/?number=78">2026 Baja 규정 개정(안)</a></td><td><a href="/func/download.php?filename=d.pdf">x</a></td><td>Ann</td><td>2026-02-01</td></tr>
<tr><td>3</td><td><a href="/bbs/?mode=view">no number</a></td><td><a href="/func/download.php?filename=d.pdf">x</a></td><td>Ann</td><td>2026</td></tr></table>"""


def page(spark, html):
    return spark.createDataFrame([(1, html)], "page_id long, html string")


def test_list_page(spark):
    got = pages.list_rows(page(spark, LIST)).orderBy("pos").collect()
    assert [(r.id, r.number, r.title, r.views, r.is_reply) for r in got] == [
        (12, 900, "Question one", 1203, False), (13, 901, "Question one", 0, True), (15, 15, "No number", 7, False)]
    assert got[0].detail_url == "/bbs/?number=900&mode=view"


def test_detail_page(spark):
    r = pages.details(page(spark, DETAIL), base="https://s.example").first()
    assert (r.title, r.author, r.date, r.views, r.attachments, r.error) == ("A & B", "Ann", "2025-01-02", 2001, ["https://s.example/f/1.pdf"], None)
    assert r.body == "first line\nsecond\nthird"
    assert pages.details(page(spark, "<table></table>")).first().error == "no detail table"
    assert pages.details(page(spark, '<table class="tblDef"><tr><td>x</td></tr></table>')).first().error == "unexpected row count 1"


def test_file_board(spark):
    got = pages.manifest_items(page(spark, FILES), base="https://s.example", default_year="2020").orderBy("source_filename").collect()
    assert [(r.source_post_id, r.source_filename, r.competition, r.document_type, r.year) for r in got] == [
        (77, "one a.pdf", "baja", "judging", "2026"), (77, "two.pdf", "baja", "judging", "2026")]
    assert got[1].source_url == "https://cdn.example/func/download.php?n=2" and len({r.source_key for r in got}) == 2


def test_scans_in_blocks_equal_a_loop(spark):
    rng = random.Random(2)
    rows = [(k, p, rng.choice([None, rng.randrange(100)])) for k in ("hot", "cold") for p in rng.sample(range(200), 120 if k == "hot" else 4)]
    df = spark.createDataFrame(rows, "k string, p long, v long").repartition(4)
    filled, sums = {}, {}
    for k in ("hot", "cold"):
        last, total = None, 0
        for _, p, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            last = v if v is not None else last
            total += v or 0
            filled[k, p], sums[k, p] = last, total
    got = ordered.fill_forward(df, ["k"], "p", F.col("v"), "o", block=7)
    assert {(r.k, r.p): r.o for r in got.collect()} == filled
    got = ordered.running_sum(df, ["k"], "p", F.coalesce("v", F.lit(0)), "o", block=7)
    assert {(r.k, r.p): r.o for r in got.collect()} == sums
    numbers = ordered.row_numbers(df, ["k"], "p", "n", block=9).where("k = 'hot'").orderBy("p").collect()
    assert [r.n for r in numbers] == list(range(120))


def test_replies_answers_and_new_questions(spark):
    sep = "========== 원 글 =========="
    rows = [("b", 0, 9, 90, True, "orphan"), ("b", 1, 10, 100, False, "q"), ("b", 2, 11, 101, True, f"one\n{sep}\nq"), ("b", 3, 12, 102, True, f"  \n{sep}\nq"),
            ("b", 4, 13, 103, True, "two"), ("b", 5, 14, 104, False, "q2"), ("b", 6, 15, 105, True, "three")]
    df = spark.createDataFrame(rows, "board string, pos long, id long, number long, is_reply boolean, body string").withColumn("url", F.col("number").cast("string"))
    linked = board.attach_parent(df, block=2)
    assert [r.parent for r in linked.orderBy("pos").collect()] == [None, 100, 100, 100, 100, 104, 104]
    answers = board.answers_of(linked.where("is_reply and parent is not null"), keys=["board", "parent"])
    assert [(r.parent, r.answer_pos, r.answer_body) for r in answers.orderBy("parent", "answer_pos").collect()] == [(100, 0, "one"), (100, 1, "two"), (104, 0, "three")]
    pages_ = board.nest_answers(answers, ["board", "parent"], page=1).where("parent = 100").orderBy("part").collect()
    assert [[a.body for a in r.answers] for r in pages_] == [["one"], ["two"]]
    stored = spark.createDataFrame([(10,)], "id long")
    assert sorted(r.number for r in board.new_questions(df, stored).collect()) == [104, 105]


def test_merge_keeps_old_rows(spark):
    old = spark.createDataFrame([(1, "old"), (1, "old twin")], "id long, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "id long, v string")
    got = sorted((r.id, r.v) for r in board.merge_posts(old, new, ["id"], [F.col("v")]).collect())
    assert got == [(1, "old"), (1, "old twin"), (2, "a")]


def test_previous_question_skips_repeats(spark):
    rows = [("c", 0, "user", "a"), ("c", 1, "assistant", "x"), ("c", 2, "user", "b"), ("c", 3, "user", "b "), ("c", 4, "user", ""), ("c", 5, "user", "b"), ("c", 6, "user", "c"), ("d", 0, "user", "z")]
    df = spark.createDataFrame(rows, "k string, pos long, role string, text string")
    for block in (2, 100):
        got = {(r.k, r.pos): r.previous for r in cv.with_previous_questions(df, key="k", position="pos", block=block).where("role = 'user'").collect()}
        assert got == {("c", 0): None, ("c", 2): "a", ("c", 3): "a", ("c", 4): "b", ("c", 5): "a", ("c", 6): "b", ("d", 0): None}


def test_question_detectors(values):
    assert values(cv.needs_clarification, ["뭐", "이거 뭐야??", "방화벽 두께는 얼마인가"]) == [True, True, False]
    assert values(lambda c: cv.is_follow_up(c, F.lit(True)), ["그규정은 차량 전체에 대해 어떻게 적용됩니까", "짧은 질문", "포뮬러 차량 방화벽 두께 기준은 얼마입니까"]) == [True, True, False]
    assert values(lambda c: cv.is_follow_up(c, F.lit(False)), ["짧은 질문"]) == [False]


def test_history(spark):
    rows = [("c", i, "user" if i % 2 == 0 else "assistant", ("see https://x.y/z [문서 1] (유사도: 88.1%) " if i % 2 else "q") + "t" * (600 if i == 3 else 3)) for i in range(8)]
    df = spark.createDataFrame(rows, "k string, pos long, role string, text string")
    lines = cv.transcript(df, key="k", position="pos").first().transcript.split("\n")
    assert len(lines) == 6 and lines[0].startswith("사용자: qttt") and lines[1].endswith("...")
    out = [r.t for r in df.select("pos", cv.compress_message(F.col("role"), F.col("text")).alias("t")).orderBy("pos").collect()]
    assert out[1] == "see    ttt" and len(out[3]) == 503 and out[0] == "qttt"
    assert [r.pos for r in cv.recent_messages(df, keys=["k"], order=["pos"], n=3).orderBy("position").collect()] == [5, 6, 7]
