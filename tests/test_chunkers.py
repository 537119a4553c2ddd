import random

from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators import markdown_chunks as md, qna_chunks as qna, rule_chunks as rules

POSTS = """[
 {"id": 101, "category": "Formula", "title": "Two answers", "date": "2025-01-02", "url": "u101", "question_body": "Which bolt?",
  "answers": [{"body": "Use M6.", "url": "a1"}, {"body": "Or M8.", "url": "a2"}]},
 {"id": 102, "category": "EV", "title": "Open", "date": "2025-01-03", "url": "u102", "question_body": "Any news?", "answers": []},
 {"id": 103, "title": "Old form", "url": "u103", "question_body": "Q", "answer_body": "Legacy."},
 {"id": 104, "title": "", "question_body": "", "answers": []}
]"""


def test_posts(spark, tmp_path):
    (tmp_path / "posts.json").write_text(POSTS)
    from loreloom.sources.readers import read_posts

    rows = {(r.post_id, r.chunk_index): r for r in qna.chunk_posts(read_posts(spark, str(tmp_path / "posts.json"))).collect()}
    assert sorted(rows) == [("101", 0), ("101", 1), ("102", 0), ("103", 0)]
    assert rows["101", 1].url == "a2" and rows["101", 1].has_answer
    assert rows["101", 0].text == "[질문] Two answers\nWhich bolt?\n\n[답변]\nUse M6."
    assert rows["102", 0].text == "Open\n\nAny news?" and not rows["102", 0].has_answer
    assert rows["103", 0].url == "u103" and rows["103", 0].text.endswith("Legacy.")


def test_long_question_becomes_context(values):
    got = values(lambda c: qna.question_context(c), [" ".join(["word"] * 150)])[0]
    assert len(got.split()) == 101 and got.endswith(" ...")


def pack_by_hand(text, size, overlap):
    """Greedy packing over whitespace tokens, one segment after the other."""
    parts = []
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        if len(words) <= size:
            parts.append(line.strip())
        else:
            i = 0
            while True:
                parts.append(" ".join(words[i:i + size]))
                if i + size >= len(words):
                    break
                i += size - overlap
    out, cur = [], ""
    for p in parts:
        if cur and len(cur.split()) + len(p.split()) > size:
            out.append(cur)
            keep = cur.split()
            cur = (" ".join(keep[-overlap:]) if len(keep) >= overlap else cur) + "\n" + p
        else:
            cur = f"{cur}\n{p}" if cur else p
    return out + ([cur] if cur else [])


def test_packing_against_a_loop(values):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 20))) for _ in range(40)]
    got = values(lambda c: qna.chunks(c, size=25, overlap=6), texts)
    assert got == [[t] if len(t.split()) <= 25 else pack_by_hand(t, 25, 6) for t in texts]


def test_paragraphs_stay_whole(values):
    text = "one two.\n \nthree four. five\n\n" + " ".join(["x."] * 8)
    assert values(lambda c: qna.segments(c, size=4, overlap=1), [text])[0][:2] == ["one two.", "three four. five"]


def test_answers_of_a_hot_question_get_one_running_index(spark):
    rows = [("q", i, "answer " * (3 + i % 5)) for i in range(50)] + [("r", 0, "x")]
    df = spark.createDataFrame(rows, "q string, pos long, body string")
    out = qna.chunk_answers(df, keys=["q"], position="pos", title=F.lit("t"), context=F.lit("c"), answer=F.col("body"), size=5, overlap=1, block=7)
    got = [r.chunk_index for r in out.where("q = 'q'").orderBy("pos", "chunk_index").collect()]
    assert got == list(range(len(got))) and len(got) > 50


MARKDOWN = """# Title
preamble bullet
- not kept

## 1. Frame work
### Tubes
- **Tube choice** `[다수의견]` and `[미해결]` too
  - **결론** — steel works 2025-03-04
  - plain child 2024-01-01
  - <sub>출처: 2025-02-08</sub>

- **Weight table** `[단일제보]`

| part | kg |
|---|---|
| tube | 3 |

| more | 4 |
note below the table 2023-03-03
#### Limits
| a | b |
|---|---|
**단편**
- short one (2025-05-22)
- short two `[단일제보]`

- after a blank
> quoted note
more of it

## Second
free text
- **Tube choice** `[다수의견]`
  - again
"""


def blocks_of(spark, text, **options):
    df = spark.createDataFrame([("d", text)], "doc string, text string")
    return md.blocks(df, ["doc"], "text", **options).orderBy("pos").collect()


def test_markdown_blocks(spark):
    got = [(b.kind, b.chapter_num, b.chapter, b.section, b.topic, b.confidence, b.dates, b.lines) for b in blocks_of(spark, MARKDOWN)]
    f = (1, "Frame work", "Tubes")
    assert got == [
        ("topic", *f, "Tube choice  and (미해결) too", "다수의견", ["2024-01-01", "2025-02-08", "2025-03-04"],
         ["결론: steel works 2025-03-04", "plain child 2024-01-01", "출처: 2025-02-08"]),
        ("table", *f, "Weight table", "", ["2023-03-03"], ["| part | kg |", "|---|---|", "| tube | 3 |", "| more | 4 |", "note below the table 2023-03-03"]),
        ("table", *f, "Limits", "", [], ["| a | b |", "|---|---|"]),
        ("brief", *f, "단편", "", ["2025-05-22"], ["short one (2025-05-22)", "short two (단일제보)"]),
        ("brief", *f, "단편", "", [], ["after a blank"]),
        ("note", *f, "단편", "", [], ["quoted note", "more of it"]),
        ("note", None, "Second", "", "", "", [], ["free text"]),
        ("topic", None, "Second", "", "Tube choice", "다수의견", [], ["again"]),
    ]


def test_long_bullet_above_a_table(spark):
    text = "## 1. C\n- " + "long words " * 6 + "\n| a |\n|---|\n- short\n\n| b |\n"
    kept = [(b.kind, b.topic) for b in blocks_of(spark, text)]
    dropped = [(b.kind, b.topic) for b in blocks_of(spark, text, keep_long_captions=False)]
    # The short one is a caption; it does not end the open table.
    assert kept == [("brief", ""), ("table", "")]
    assert dropped == [("table", "")]


def chunks_of(spark, text, **options):
    df = spark.createDataFrame([("d", text)], "doc string, text string")
    return md.chunk_markdown(df, "text", keys=["doc"], **options).orderBy("pos", "chunk_index").collect()


def test_markdown_ids_are_stable_and_versions_move(spark):
    before = chunks_of(spark, MARKDOWN)
    after = chunks_of(spark, MARKDOWN.replace("### Tubes\n", "### Tubes\n- **New**\n  - entry\n\n"))
    assert {c.post_id for c in before} < {c.post_id for c in after}
    assert len({(c.post_id, c.chunk_index) for c in after}) == len(after)
    assert {c.source_version for c in before} != {c.source_version for c in after}
    repeated = [c.post_id for c in before if c.kind == "brief"]
    assert repeated[1] == repeated[0] + "-1"


def test_markdown_budget_and_table_header(spark):
    rows = "\n".join(f"| row{i} a b c | {i} |" for i in range(60))
    text = f"## 3. Data\n### S\n#### Big\n| name | n |\n|---|---|\n{rows}\n"
    got = chunks_of(spark, text, size=40)
    assert len(got) > 5 and all(len(c.text.split()) <= 40 for c in got)
    assert all(c.text.startswith("[분야] 3. Data > S\n[주제] Big\n| name | n |\n|---|---|\n") for c in got)
    joined = "\n".join(line for c in got for line in c.text.split("\n") if line.startswith("| row"))
    assert joined == rows


RULES = """한국 규정
3
제 1 장 총칙
머리말
제1조(목적) 이 규정은
목적을 정한다
제 2조 ( 정의 )
정의한다
제2장 차량
제3조
조문 내용
부칙
시행한다
"""


def test_rule_sections(spark):
    df = spark.createDataFrame([("d", RULES)], "doc string, text string")
    s = rules.sectionize(df, ["doc"], "text").orderBy("pos").collect()
    assert [(r.chapter_num, r.chapter, r.section_num, r.section, r.lines) for r in s] == [
        (1, "총칙", 1, "목적 - 이 규정은", ["목적을 정한다"]), (1, "총칙", 2, "정의", ["정의한다"]),
        (2, "차량", 3, "조문", ["조문 내용"]), (2, "차량", 9999, "부칙", ["시행한다"])]


def rule_docs(spark, text):
    return spark.createDataFrame([("d", text, "key", "Formula 심사규정", "2026")], "doc string, text string, source_key string, title string, year string")


def test_rule_chunks(spark):
    got = rules.chunk_rules(rule_docs(spark, RULES), "text", keys=["doc"]).orderBy("chapter_num", "section_num").collect()
    assert got[0].text == "[제1장] 총칙\n[제1조] 목적 - 이 규정은\n[규정문서] Formula 심사규정\n[규정분류] formula / 심사규정 - 목적 - 이 규정은\n목적을 정한다"
    assert got[0].source_version == "2026+key" and got[0].document_type == "judging"
    assert [r.chunk_index for r in got] == [0, 0, 0, 0]


def test_equal_sections_get_different_ids(spark):
    text = "제1장 가\n제1조 (나)\n하나\n제1조 (나)\n둘"
    got = rules.chunk_rules(rule_docs(spark, text), "text", keys=["doc"]).collect()
    ids = sorted(r.post_id for r in got)
    assert len(set(ids)) == 2 and ids[1] == ids[0] + "-1"


def test_long_section_overlaps_by_whole_lines(spark):
    lines = [f"line{i} " + "w " * 8 for i in range(90)]
    text = "제1장 가\n제1조 (나)\n" + "\n".join(lines)
    got = rules.chunk_rules(rule_docs(spark, text), "text", keys=["doc"], size=150).orderBy("chunk_index").collect()
    bodies = [[x for x in r.text.split("\n") if x.startswith("line")] for r in got]
    assert len(got) > 3 and all(len(r.text.split()) <= 150 for r in got)
    assert all(a[-1] == b[len(set(a) & set(b)) - 1] for a, b in zip(bodies, bodies[1:]))
    assert sorted({x for b in bodies for x in b}) == sorted(x.strip() for x in lines)


def test_generic_chunks_when_there_is_no_section(spark):
    text = "first part\n\n" + " ".join(f"w{i}" for i in range(300)) + "\n\nlast part"
    got = rules.chunk_rules(rule_docs(spark, text), "text", keys=["doc"], size=150).orderBy("chunk_index").collect()
    bodies = [r.text.split("\n", 2)[2] for r in got]
    assert bodies[0] == "first part" and bodies[-1].endswith("last part")
    assert [r.chunk_index for r in got] == list(range(len(got)))
    assert got[0].section == "본문" and got[0].post_id == "key"


def test_window_without_early_stop(values):
    text = " ".join(str(i) for i in range(10))
    keep = values(lambda c: rules.fit_to_budget(c, F.lit(6), overlap=2), [text])[0]
    drop = values(lambda c: rules.fit_to_budget(c, F.lit(6), overlap=2, drop_contained=True), [text])[0]
    assert keep == ["0 1 2 3 4 5", "4 5 6 7 8 9", "8 9"] and drop == keep[:2]


def test_manifest_filter(spark):
    rows = [(1, "Baja 안전규정", "a.pdf", "/r/a.pdf", "2026", True, ""), (2, "규정 개정안", "b.pdf", "/r/b.pdf", "2026", True, ""),
            (3, "old", "c.pdf", "/r/c.pdf", "2025", True, ""), (4, "gone", "d.pdf", "/r/d.pdf", "2026", False, ""), (5, "e", "name", "/r/e.pdf", "2026", True, "EV")]
    df = spark.createDataFrame(rows, "source_post_id long, title string, source_filename string, source_file string, year string, downloaded boolean, competition string")
    df = df.withColumn("date", F.lit("2026-01-01")).withColumn("document_type", F.lit(""))
    got = {r.source_post_id: r for r in rules.accept_manifest(df).collect()}
    assert sorted(got) == [1, 5]
    assert (got[1].competition, got[1].document_type) == ("baja", "safety")
    assert (got[5].competition, got[5].source_filename) == ("ev", "name.pdf")


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "text string")
    assert tuple(qna.chunk_stats(empty).first()) == (0, 0.0, 0, 0, 0)
    assert tx.WORDS.additive


def test_packing_with_a_tokenizer_whose_counts_do_not_add_up(values):
    """Sub-word tokens: packing recounts the growing chunk; a plain Python packing agrees."""
    import math
    import re

    from loreloom.functions import text as tx
    from loreloom.operators import qna_chunks as qna

    size, overlap = 12, 3
    count = lambda t: math.ceil(len(t) / 4)
    cut = lambda t: [t[i:i + 4] for i in range(0, len(t), 4)]

    def windows(t):
        tokens = cut(t)
        return ["".join(tokens[i:i + size]) for i in range(0, max(len(tokens) - overlap, 1), size - overlap)]

    def segments(t):
        out = []
        for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", t))):
            parts = [p] if count(p) <= size else filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+|\n", p)))
            out += [w for s in parts for w in ([s] if count(s) <= size else windows(s))]
        return out

    def chunks(t):
        if count(t) <= size:
            return [t]
        done, current = [], ""
        for s in segments(t):
            if current and count(current) + count(s) > size:
                done.append(current)
                tail = "".join(cut(current)[-overlap:]) if count(current) >= overlap else current
                current = f"{tail}\n{s}"
            else:
                current = f"{current}\n{s}".strip() if current else s
        return done + [current] if current else done

    texts = ["short", "one sentence here. another sentence there! a third one? yes.", "x" * 130, "para one is small\n\npara two is a little longer than that\n\nthree", "a b. " * 30]
    assert values(lambda c: qna.chunks(c, size=size, overlap=overlap, tokenizer=tx.pieces(4)), texts) == [chunks(t) for t in texts]
