"""Text, token and key expressions. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreloom.functions import fixed_values as fixed

# The white space that str.strip()/str.split() know: Java's Unicode class, which needs (?U) in front
# of the pattern, plus the four separators it leaves out. (Spelling the class out is 10 times slower.)
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def squash(c: Column | str) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), rf"(?U){SPACE}+", " "))


def clean_text(c: Column | str) -> Column:
    """Collapse blanks inside lines, keep at most one empty line, trim."""
    one_blank = F.regexp_replace(_col(c), rf"(?U)[{SPACE}&&[^\n]]+", " ")
    return strip(F.regexp_replace(one_blank, r"\n{3,}", "\n\n"))


def or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def non_empty(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def parse_count(c: Column | str) -> Column:
    """``1,234`` -> 1234; anything that is not all digits -> 0."""
    digits = F.regexp_replace(strip(c), ",", "")
    return F.coalesce(F.when(digits.rlike(r"\A[0-9]+\z"), digits.try_cast("bigint")), F.lit(0).cast("bigint"))


def parse_int(c: Column | str) -> Column:
    """Integer or NULL, blanks around it allowed."""
    s = strip(_col(c).cast("string"))
    return F.when(s.rlike(r"\A[+-]?[0-9]+\z"), s.try_cast("bigint"))


def query_parameter(url: Column | str, name: str, fallback: Column | str | None = None) -> Column:
    """First value of a query-string parameter; relative links work as well."""
    found = non_empty(F.regexp_extract(_col(url), rf"[?&]{name}=([^&#]*)", 1))
    return found if fallback is None else F.coalesce(found, _col(fallback).cast("string"))


def slug(c: Column | str) -> Column:
    s = F.translate(strip(F.lower(_col(c))), " _", "--")
    s = F.regexp_replace(s, r"[^a-z0-9가-힣-]", "-")
    return F.regexp_replace(F.regexp_replace(s, "-+", "-"), r"^-+|-+\z", "")


def safe_path_component(c: Column | str, max_len: int = 120, default: str = "rule") -> Column:
    s = F.regexp_replace(_col(c), r'[\\/:*?"<>|]+', "_")
    s = F.regexp_replace(squash(s), r"^\.+|\.+\z", "")
    cut = F.coalesce(non_empty(F.substring(strip(s), 1, max_len)), F.lit(default))
    return strip(cut)


def cut(c: Column | str, chars: int) -> Column:
    return F.substring(_col(c), 1, chars)


def ellipsis(c: Column | str, chars: int) -> Column:
    """First *chars* characters and three dots when the text is longer."""
    col = _col(c)
    return F.when(F.length(col) > chars, F.concat(cut(col, chars), F.lit("..."))).otherwise(col)


def rewrite(c: Column, rules: Iterable[tuple[str, str]], *, only: str | None = None) -> Column:
    """Apply (pattern, replacement) pairs in order; texts without a match for *only* stay as they are."""
    out = c
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out if only is None else F.when(c.rlike(only), out).otherwise(c)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a costly expression to a name, so that using it several times computes it once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# --- tokens -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tokenizer:
    """The pluggable tokenizer: three Column -> Column callables.

    ``additive`` says that joining two texts with a line end adds their counts; packing then counts
    every segment once instead of recounting the growing chunk.
    """

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    count: Callable[[Column], Column]
    additive: bool = False


WORDS = Tokenizer(
    encode=lambda c: F.regexp_extract_all(c, F.lit(rf"((?U){NOT_SPACE}+)")),
    decode=lambda a: F.array_join(a, " "),
    count=lambda c: F.regexp_count(c, F.lit(rf"(?U){NOT_SPACE}+")),
    additive=True,
)


# Counts words but gives no tokens: what chunkers work with where no tokenizer is at hand.
COUNTS = Tokenizer(encode=lambda c: F.array().cast("array<string>"), decode=WORDS.decode, count=WORDS.count, additive=True)


def pieces(size: int = 4) -> Tokenizer:
    """A sub-word tokenizer: every run of up to *size* characters is a token, white space included.

    Joining two texts can shift the runs, so its counts do not add up.
    """
    return Tokenizer(
        encode=lambda c: F.regexp_extract_all(c, F.lit(rf"(?s)(.{{1,{size}}})")),
        decode=lambda a: F.array_join(a, ""),
        count=lambda c: F.ceil(F.length(c) / size).cast("int"),
    )


def token_count(c: Column | str, tokenizer: Tokenizer = WORDS) -> Column:
    return tokenizer.count(or_empty(c)).cast("bigint")


def character_slices(c: Column, chars: int) -> Column:
    """A text cut after every *chars* characters; an empty text has no slice."""
    count = F.ceil(F.length(c) / chars).cast("int")
    cut_up = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(c, i * chars + 1, F.lit(chars)))
    return F.when(count > 0, cut_up).otherwise(F.array().cast("array<string>"))


def token_windows(c: Column, size: int | Column, step: int | Column, *, to_the_end: bool = False,
                  tokenizer: Tokenizer = WORDS) -> Column:
    """Token windows as texts.

    The last window is the first that reaches the end of the text; ``to_the_end`` keeps starting
    windows until the last token, so the final ones may lie inside their predecessor.
    """
    size_c = F.lit(size) if isinstance(size, int) else size.cast("int")
    step_c = F.lit(step) if isinstance(step, int) else step.cast("int")

    def cut_up(tokens: Column) -> Column:
        n = F.size(tokens)
        last = n - 1 if to_the_end else F.greatest(n - (size_c - step_c) - 1, F.lit(0))
        windows = F.transform(
            F.sequence(F.lit(0), last, step_c), lambda i: tokenizer.decode(F.slice(tokens, i + 1, size_c))
        )
        return F.when(n > 0, windows).otherwise(F.array().cast("array<string>"))

    return let(tokenizer.encode(c), cut_up)


def truncate_tokens(c: Column | str, limit: int, mark: str = " ...", tokenizer: Tokenizer = WORDS) -> Column:
    col = or_empty(c)
    return let(tokenizer.encode(col), lambda tokens: F.when(
        F.size(tokens) > limit, F.concat(tokenizer.decode(F.slice(tokens, 1, limit)), F.lit(mark))).otherwise(col))


def match_tokens(c: Column | str, min_len: int = 2) -> Column:
    """Distinct lower-case words of at least *min_len* characters: the text-match unit."""
    words = F.regexp_extract_all(F.lower(or_empty(c)), F.lit(rf"([\p{{L}}\p{{N}}]{{{min_len},}})"))
    return F.array_distinct(words)


# --- keys ---------------------------------------------------------------------------------------

# Fixed value: the RFC 4122 name space for URLs.
NAMESPACE_URL_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_url(name: Column | str) -> Column:
    """RFC 4122 version-5 UUID in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL_HEX)), F.encode(_col(name), "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(F.substring(variant, nibble + 1, F.lit(1)), F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def point_id(post_id: Column | str, chunk_index: Column | str) -> Column:
    return uuid5_url(F.concat(_col(post_id).cast("string"), F.lit("_"), _col(chunk_index).cast("string")))


def sha1_prefix(parts: list[Column], sep: str, chars: int) -> Column:
    text = F.concat_ws(sep, *[or_empty(p.cast("string")) for p in parts])
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, chars)


def section_id(source_type: str, source_key: Column, chapter_num: Column, section_num: Column, title: Column) -> Column:
    return F.concat(F.lit(f"{source_type}-"), sha1_prefix([source_key, chapter_num, section_num, title], ":", 12))


def source_key(url: Column | str) -> Column:
    return F.sha2(F.encode(_col(url), "UTF-8"), 256)


def source_version(post_id: Column, title: Column, url: Column, year: Column) -> Column:
    return F.concat(year, F.lit("-"), sha1_prefix([post_id, title, url, year], ":", 12))


def default_source_version(key: Column, year: Column) -> Column:
    return F.concat(year, F.lit("+"), F.substring(or_empty(key), 1, 12))


def fingerprint(content: Column, modified: Column | None = None) -> Column:
    """``YYYY-MM-DD+<12 hex digits>`` of a document, or the digits alone without a time."""
    digest = F.substring(F.sha2(content, 256), 1, 12)
    return digest if modified is None else F.concat(F.date_format(modified, "yyyy-MM-dd"), F.lit("+"), digest)


# --- Markdown -----------------------------------------------------------------------------------

SOURCE_NOTE = r"<sub>\s*(?:출처:\s*)?(.*?)\s*</sub>"
ISO_DATE = r"\d{4}-\d{2}-\d{2}"


def strip_markup(c: Column | str) -> Column:
    return strip(rewrite(_col(c), [
        (SOURCE_NOTE, "출처: $1"),
        (fixed.CONFIDENCE_TAG, "($1)"),
        (r"\*\*(.+?)\*\*", "$1"),
        (r"`([^`]*)`", "$1"),
    ]))


def label_line(c: Column | str) -> Column:
    """``label — text`` -> ``label: text`` for labels of at most 14 characters."""
    return F.regexp_replace(strip_markup(c), r"(?s)\A(.{1,14}?)\s+—\s+(.*)\z", "$1: $2")


def iso_dates(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(c), F.lit(f"({ISO_DATE})"))))


def year_candidates(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"(20\d{2})"))))


def best_year(c: Column | str, default: str) -> Column:
    return F.coalesce(F.array_max(year_candidates(c)), F.lit(default))


def is_target_year(c: Column | str, year: str) -> Column:
    return F.array_contains(year_candidates(c), year)
