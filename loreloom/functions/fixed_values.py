"""Fixed values.

Word lists, patterns, labels and limits that decide results. They are plain data; every operator
takes them as a parameter, these are the defaults. Patterns use Java syntax: ``(?U)`` makes the
classes and ``\\b`` Unicode-aware, ``i`` ignores case.
"""

# Competition keys and their display labels.
COMPETITION_LABELS = {
    "formula": "Formula",
    "e_formula": "Formula",
    "smart_e_mobility": "EV",
    "baja": "Baja",
    "ev": "EV",
    "other": "기타",
}

# Document types and their display labels.
DOCUMENT_TYPE_LABELS = {
    "vehicle-technical": "차량기술규정",
    "competition-rules": "경기/대회규정",
    "judging": "심사규정",
    "event-operation": "경기진행",
    "safety": "안전규정",
    "other": "기타",
}

OTHER = "other"
OTHER_LABEL = "기타"

# Spellings of competition keys that are not keys themselves.
COMPETITION_ALIASES = {
    "eformula": "e_formula",
    "e-formula": "e_formula",
    "smart_emobility": "smart_e_mobility",
    "smart-emobility": "smart_e_mobility",
}
COMPETITION_SUBSTRINGS = (("formula", "formula"), ("baja", "baja"))

# First match wins: competition of a document (title, file name).
DOCUMENT_COMPETITION_PATTERNS = (
    ("smart_e_mobility", r"(?iU)스마트\s*e[- ]?모빌리티|smart[- ]?e[- ]?mobility|smart[- ]?e"),
    ("e_formula", r"(?iU)e[- ]?formula|e[- ]?포뮬러|전기\s*포뮬러"),
    ("baja", r"(?iU)\bbaja\b|바하"),
    ("formula", r"(?iU)포뮬러|formula|포뮬라"),
    ("ev", r"(?iU)\bev\b|전기차|전기\s*모빌리티|EV"),
)

# First match wins: competition of a query.
QUERY_COMPETITION_PATTERNS = (
    ("smart_e_mobility", r"(?iU)스마트\s*e\s*모빌리티|스마트.{0,5}모빌리티"),
    ("e_formula", r"(?iU)e[- ]?formula|e[- ]?포뮬러|전기\s*포뮬러"),
    ("formula", r"(?iU)포뮬러|formula|포뮬라"),
    ("baja", r"(?iU)바하|baja"),
    ("ev", r"(?iU)\bev\b|전기차|electric\s+vehicle"),
)

# First match wins: type of a document. The third pattern is the only case-sensitive one.
DOCUMENT_TYPE_PATTERNS = (
    ("vehicle-technical", r"(?iU)차량기술규정|차량기술|차량.*규정|vehicle.*technical"),
    ("competition-rules", r"(?iU)대회운영규정|대회규정|발표대회규정|competition.*rule|operating.*rule|운영.*규정"),
    ("event-operation", r"(?U)경기진행규정|경기진행|진행규정|event.*operation|operations?"),
    ("judging", r"(?iU)심사규정|심사|채점|judge|심사기준"),
    ("safety", r"(?iU)안전규정|안전"),
)

# Any match marks a draft.
DRAFT_PATTERNS = (
    r"(?iU)제정\s*\(?\s*안\s*\)?",
    r"(?iU)제정안",
    r"(?iU)개정\s*\(?\s*안\s*\)?",
    r"(?iU)개정안",
    r"(?iU)규정안",
    r"(?iU)안\s*제정안",
)

# Category of a query by its competition.
QUERY_CATEGORIES = {
    "smart_e_mobility": "EV",
    "e_formula": "Formula",
    "formula": "Formula",
    "baja": "Baja",
    "ev": "EV",
}

# Nearest family when a competition has no populated collection.
COMPETITION_FALLBACK = {"e_formula": "formula", "ev": "smart_e_mobility"}

# Queries: explicit forms that decide the document type.
TECHNICAL_SECTION_PATTERN = r"(?iU)기술\s*부문\s*규정"
DIRECT_QUERY_TYPES = ("competition-rules", "event-operation", "judging")
EXPLICIT_TYPE_PATTERNS = {"safety": r"(?iU)안전\s*규정", "judging": r"(?iU)심사\s*규정"}
COMPONENT_PATTERN = (
    r"(?iU)방화벽|안전\s*벨트|시트|프레임|롤\s*후프|브레이크|제동|조향|현가|"
    r"타이어|휠|엔진|배기|클램프|체인\s*가드|체인가드|축전지|배터리|"
    r"모터|고전압|페달|연료|섀시|차체|브라켓|\bglvs\b|\bbms\b"
)

# Every rewrite of rule text and nearly every one of queries concerns Hangul words.
HANGUL = "[가-힣]"

# Ordered rewrites of rule text.
RULE_TEXT_REWRITES = (
    (r"(?U)\b제\s*(\d+)\s*조\b", "제 $1 조"),
    (r"(?U)\b제\s*(\d+)\s*장\b", "제 $1 장"),
    (r"(?U)\b경기\s*진행규정\b", "경기진행규정"),
    (r"(?U)\b대회\s*운영규정\b", "대회운영규정"),
    (r"(?U)\b차량\s*기술규정\b", "차량기술규정"),
    (r"(?U)\b심사\s*규정\b", "심사규정"),
    (r"(?U)\b안전\s*규정\b", "안전규정"),
)

# Ordered rewrites of queries.
QUERY_REWRITES = (
    (r"(?iU)\b베기(?=\s*(?:클램프|매니폴드|파이프|머플러|시스템|가스|구))", "배기"),
    (r"(?iU)\b(?:노드\s+락|놀드\s*락|노르드\s*락|nordlock|nord\s+lock)\b", "노드락"),
    (r"(?iU)\b일반\s*너트\b", "일반 너트"),
    (r"(?iU)\b체인\s*가드\b", "체인가드"),
    (r"(?iU)\b방화\s*벽\b", "방화벽"),
    (r"(?iU)\b경기\s*진행\s*규정\b", "경기진행규정"),
    (r"(?iU)\b대회\s*운영\s*규정\b", "대회운영규정"),
    (r"(?iU)\b차량\s*기술\s*규정\b", "차량기술규정"),
    (r"(?iU)\b심사\s*규정\b", "심사규정"),
    (r"(?iU)\b안전\s*규정\b", "안전규정"),
)

# Synonyms appended to a query: (must match all of, must not match, appended text).
QUERY_EXPANSIONS = (
    (("노드락",), r"(?iU)\bnord-lock\b", " Nord-Lock"),
    (("클램프", "일반 너트|노드락"), "풀림 방지", " 너트 체결 풀림 방지"),
)

# Terms of a query that carry no meaning.
QUERY_STOP_WORDS = (
    "규정", "문서", "관련", "방법", "조건", "기준", "요건", "무엇", "어떤", "어디", "언제", "얼마", "어떻게",
    "조", "조항", "항", "규정집",
)
QUERY_TERM_PATTERN = r"([가-힣]{2,}|[a-z0-9_\-+]{2,})"
SECTION_REFERENCE = r"(?U)제\s*(\d+)\s*조"
CHAPTER_REFERENCE = r"(?U)제\s*(\d+)\s*장"

# Headings and noise of rule documents.
RULE_CHAPTER = r"(?U)\A\s*제\s*([0-9]+)\s*장\s*(.*)\z"
RULE_SECTION = r"(?U)\A\s*제\s*([0-9]+)\s*조\s*(?:\(([^)]*)\))?\s*(.*)\z"
RULE_SUPPLEMENT = r"(?U)\A\s*부칙\s*\z"
SUPPLEMENT_NUMBER = 9999
SUPPLEMENT_TITLE = "부칙"
DEFAULT_SECTION_TITLE = "조문"
BARE_PAGE_NUMBER = r"(?U)\A\s*\d+\s*\z"

# Follow-up and incomplete questions.
FOLLOW_UP_PATTERN = (
    r"(?iU)(^|\s)(그|이|저)(것|거|규정|부분|경우)|"
    r"^(아니|아니요|그게 아니라|정정|다시)|"
    r"(위에서|방금|앞에서|내가 말한|아까)"
)
INCOMPLETE_PATTERN = r"(?iU)\A(이거|저거|그거|이것|저것|그것)?\s*(어때|뭐야|가능해|알려줘|설명해줘)[?？ ]*\z"

# Words that must survive a rewrite.
IDENTIFIER_PATTERN = r"(?U)(\b(?=[A-Za-z0-9-]*[A-Za-z])(?=[A-Za-z0-9-]*[0-9A-Z])[A-Za-z0-9-]{2,}\b)"
COMPETITION_TERM_PATTERN = (
    r"((?iU)스마트\s*e\s*모빌리티|e[- ]?formula|e[- ]?포뮬러|포뮬러|formula|바하|baja|전기차|\bev\b)"
)
PRESERVATION_STOP_WORDS = (
    "관련", "관련된", "관해서", "규정", "규정집", "기준", "내용", "설명",
    "어떤식", "어떤식으로", "어떻게", "해야함", "하면", "가능한지", "가능해",
    "알려줘", "보여줘", "이거", "저거", "그거", "이것", "저것", "그것",
    "아니", "다시", "부분", "경우", "질문",
)
PARTICLE_SUFFIXES = (
    "에서는", "으로는", "이라고", "이라면", "에서", "에게", "으로", "까지",
    "부터", "처럼", "보다", "하고", "이며", "인데", "은", "는", "이", "가",
    "을", "를", "에", "와", "과", "도", "만", "의", "로",
)

# Markers inside texts.
QUESTION_MARK = "[질문]"
ANSWER_MARK = "[답변]"
NO_ANSWER_MARK = "답변 없음"
ORIGINAL_TEXT_SEPARATOR = r"(?U)={10,}\s*원\s*글\s*={10,}"
CODE_TOKEN_PATTERN = r"(?U)(\b(?=[A-Za-z0-9-]{4,})(?=[^\s]*[A-Za-z])(?=[^\s]*\d)[A-Za-z0-9-]+\b)"
CONCLUSION_PATTERN = r"(?m)^결론: (.{25,110})"

# Memos that name a reason in brackets.
REDACTED_MEMO_PREFIXES = ("오류 환불 (", "요청 저장 실패 환불 (")
USAGE_MEMO = "질문"

# Source types and groups of hits; the label of the knowledge base.
KB_TYPE = "aark"
KB_LABEL = "AARK"
SOURCE_GROUPS = ("rules", "qna", "aark", "other")

# Weights of the query boost, and the shares of boost and penalty in a score.
BOOST_WEIGHTS = {"competition": 0.18, "competition_other": -0.08, "type": 0.14, "type_other": -0.04,
                 "section": 0.20, "chapter": 0.12, "term": 0.06, "terms_max": 0.35}
BOOST_SHARE = 0.2
PENALTY_SHARE = 0.04
UNRESOLVED_GRADE = "미해결"
SINGLE_REPORT_GRADE = "단일제보"

# Sentences of the text that goes to the answering model.
DOCUMENT_LABEL = "[문서 "
DOCUMENTS_FOUND = "다음은 검색된 참고 문서입니다:\n\n"
DOCUMENTS_MISSING = "질문에 직접 관련된 참고 문서를 찾지 못했습니다. 문서 근거가 필요한 허용 여부·검차 판단은 단정하지 마세요.\n\n"
SEARCH_WORDING = "(검색에 사용된 쿼리: "
SEARCH_STATUS = "(검색 상태: "
MIXED_COMPETITIONS = (
    "(서로 다른 종목의 자료가 검색되었습니다. 이를 하나의 규정처럼 합치지 말고 "
    "종목별 공통점과 차이를 명시하세요. 허용 여부가 달라지면 먼저 종목을 확인하세요.)\n")
INCOMPLETE_QUESTION = "(질문이 불완전합니다. 추측해서 길게 답하지 말고 가장 중요한 확인 질문 하나만 하세요.)\n"
USER_QUESTION = "사용자 질문: "

# Groups of collections that a reader can choose: key, collection, label, source type.
COLLECTION_GROUPS = (("rules", "rules-all", "규정", "rules"), ("qna", "qna", "Q&A", "qna"), ("kb", "kb", "KB", "kb"))

# Lines of Markdown notes.
MARKDOWN_CHAPTER = r"(?U)\A##\s+(?:(\d+)\.\s*)?(.+?)\s*\z"
MARKDOWN_SECTION = r"(?U)\A###\s+(.+?)\s*\z"
MARKDOWN_SUBHEAD = r"(?U)\A####\s+(.+?)\s*\z"
MARKDOWN_BOLD = r"(?U)\A\*\*(.+?)\*\*\s*\z"
MARKDOWN_BULLET = r"(?U)\A-\s+(.*?)\s*\z"
MARKDOWN_NESTED = r"(?U)\A\s+-\s+(.*?)\s*\z"
MARKDOWN_ANY_BULLET = r"(?U)\A\s*-\s+(.*?)\s*\z"

# The four confidence grades and the Markdown form that carries them.
CONFIDENCE_VALUES = ("합의됨", "다수의견", "단일제보", "미해결")
CONFIDENCE_TAG = "`\\[(" + "|".join(CONFIDENCE_VALUES) + ")\\]`"
