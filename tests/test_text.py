import hashlib
import random
import re
import unicodedata
import uuid

from pyspark.sql import functions as F

from loreloom.functions import classify as cl, text as tx

ODD = ["", "  a b \t c\n\n\n\nd  ", "\x1cx\x1f y　", " ", "a\r\nb", "한글  텍스트​끝", "ﬁ①", "1,234", "12a", None]


def test_strip_and_clean_agree_with_python(values):
    def clean(t):
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[^\S\n]+", " ", t)).strip()

    texts = [t for t in ODD if t is not None]
    assert values(tx.strip, texts) == [t.strip() for t in texts]
    assert values(tx.clean_text, texts) == [clean(t) for t in texts]
    assert values(lambda c: tx.token_count(c), texts) == [len(t.split()) for t in texts]


def test_counts_and_parameters(values):
    assert values(tx.parse_count, ["1,234", "12a", "", " 7 ", None]) == [1234, 0, 0, 7, 0]
    assert values(tx.parse_int, [" 12 ", "-3", "x", None, ""]) == [12, -3, None, None, None]
    urls = ["/bbs/?number=12&mode=view", "/bbs/?mode=view", "https://x.example/?a=1&number=7#top"]
    assert values(lambda c: tx.query_parameter(c, "number", F.lit(5)), urls) == ["12", "5", "7"]


def test_slug_and_path(values):
    assert values(tx.slug, [" Smart E_Mobility!! ", "차량 기술", "--a--"]) == ["smart-e-mobility", "차량-기술", "a"]
    assert values(tx.safe_path_component, ['a/b:*c?"d".pdf', "...", " x  y. "]) == ["a_b_c_d_.pdf", "rule", "x y"]
    assert values(lambda c: tx.safe_path_component(c, 3), ["abcdef"]) == ["abc"]


def test_keys_agree_with_python(values):
    names = [f"{random.Random(7).random()}-{i}" for i in range(50)] + ["한글_0", ""]
    assert values(tx.uuid5_url, names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    want = "rules-" + hashlib.sha1("k:1:2:목적".encode()).hexdigest()[:12]
    got = values(lambda c: tx.section_id("rules", F.lit("k"), F.lit(1), F.lit(2), c), ["목적"])
    assert got == [want]
    assert values(tx.source_key, ["u"]) == [hashlib.sha256(b"u").hexdigest()]


def test_windows_stop_or_run_to_the_end(values):
    words = [" ".join(map(str, range(n))) for n in (0, 1, 5, 6, 9, 10)]

    def expect(n, size, step, full):
        toks, out = [str(i) for i in range(n)], []
        for i in range(0, n, step):
            out.append(" ".join(toks[i:i + size]))
            if not full and i + size >= n:
                break
        return out

    for full in (False, True):
        got = values(lambda c: tx.token_windows(c, 5, 3, to_the_end=full), words)
        assert got == [expect(n, 5, 3, full) for n in (0, 1, 5, 6, 9, 10)]


def test_markup(values):
    line = "**결론** — 와셔 `M6` `[다수의견]` <sub>출처: 2025-02-08</sub>"
    assert values(tx.label_line, [line]) == ["결론: 와셔 M6 (다수의견) 출처: 2025-02-08"]
    assert values(tx.label_line, ["a label that is far too long — x"]) == ["a label that is far too long — x"]
    assert values(tx.iso_dates, ["2025-02-08 a 2024-01-01 b 2025-02-08"]) == [["2024-01-01", "2025-02-08"]]


def test_rule_text_is_folded_and_rewritten(values):
    got = values(cl.normalize_rule_text, ["제3조", "제 12장 차량  기술규정", "ﬁrst​line", None])
    assert got == ["제 3 조", "제 12 장 차량기술규정", "first line", ""]
    assert values(cl.normalize_rule_text, ODD[6:7]) == [unicodedata.normalize("NFKC", "ﬁ①")]


def test_query_normalization_is_idempotent(values):
    queries = ["베기 클램프 노드 락", "체인 가드", "nord lock 너트", "일반너트 클램프", "방화 벽  규정", "ＡＢＣ", ""]
    once = values(cl.normalize_query, queries)
    assert values(cl.normalize_query, once) == once
    assert once[0] == "배기 클램프 노드락 Nord-Lock 너트 체결 풀림 방지"
    assert once[3] == "일반 너트 클램프 너트 체결 풀림 방지"


def test_classifiers(values):
    assert values(lambda c: cl.detect_competition(c), ["스마트 e 모빌리티 대회", "e-formula", "전기차", "포뮬러", "바하", "여기"]) == [
        "smart_e_mobility", "e_formula", "ev", "formula", "baja", None]
    assert values(lambda c: cl.normalize_competition(c), ["Formula", "e formula", "EV", "smart-emobility", "My Baja", "", None]) == [
        "formula", "e_formula", "ev", "smart_e_mobility", "baja", "other", "other"]
    assert values(lambda c: cl.infer_document_type(c), ["차량기술규정", "대회 운영 규정", "Event Operations", "event operations", "심사", "x"]) == [
        "vehicle-technical", "competition-rules", "other", "event-operation", "judging", "other"]
    assert values(lambda c: cl.is_draft(c), ["규정 개정(안)", "제정안", "최종", None]) == [True, True, False, False]
    assert values(cl.query_document_type, ["기술 부문 규정", "심사규정 알려줘", "안전벨트 폭", "안전 규정", "점심"]) == [
        "other", "judging", "vehicle-technical", "safety", None]


def test_preserved_words(values):
    assert values(cl.preserved_words, ["배기에서는 클램프를 관련 규정"]) == [["배기", "클램프"]]
    pairs = [("QS165 모터는", "QS165 모터 규정", True), ("QS165 모터는", "모터 규정", False), ("일반 너트를", "일반너트 규정", True), ("배기 클램프", "자작차", False)]
    got = [values(lambda c, r=r: cl.preserves_identifiers(c, F.lit(r)), [o])[0] for o, r, _ in pairs]
    assert got == [w for *_, w in pairs]


def test_years(values):
    assert values(tx.year_candidates, ["2026 a 2024-2026"]) == [["2024", "2026"]]
    assert values(lambda c: tx.best_year(c, "2020"), ["x", "2024 2021"]) == ["2020", "2024"]
