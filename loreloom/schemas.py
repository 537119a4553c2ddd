"""Explicit schemas of the stored tables."""

ANSWERS = "array<struct<body:string,url:string>>"

POSTS = (
    "id bigint, category string, title string, author string, date string, views bigint, "
    f"question_body string, answers {ANSWERS}, answer_body string, comments array<string>, "
    "attachments array<string>, url string"
)

BOARD_ROWS = (
    "board string, pos bigint, id bigint, number bigint, category string, title string, author string, "
    "views bigint, date string, detail_url string, is_reply boolean"
)

MANIFEST = (
    "source_post_id bigint, title string, date string, detail_url string, source_url string, "
    "source_filename string, competition string, document_type string, year string, source_key string, "
    "source_version string, source_file string, downloaded boolean, downloaded_size bigint, source_sha256 string"
)

QNA_CHUNKS = (
    "post_id string, category string, title string, date string, url string, has_answer boolean, "
    "chunk_index bigint, text string"
)

QNA_PAYLOAD = ("category", "title", "author", "date", "url", "has_answer")
KB_PAYLOAD = ("source_type", "source_version", "chapter_num", "chapter", "section", "topic", "confidence",
              "dates", "kind")
RULES_PAYLOAD = ("source_type", "source_version", "source_post_id", "source_key", "source_file",
                 "source_filename", "source_url", "source_title", "competition", "document_type", "year",
                 "chapter", "chapter_num", "section", "section_num")

TURN_EVENTS = "turn_id string, seq bigint, ts timestamp, event_type string, payload string"
ORDER_EVENTS = (
    "order_id string, seq bigint, ts timestamp, event string, amount string, tid string, "
    "signature string, edi_date string"
)
