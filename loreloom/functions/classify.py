"""Normalization and rule-table classification. Rule tables come in as parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreloom.functions import fixed_values as fixed
from loreloom.functions import text as tx
from loreloom.functions.encode import nfkc

Rules = Sequence[tuple[str, str]]


def first_match(c: Column, rules: Rules, default: str | None = None) -> Column:
    """Key of the first pattern found in the text."""
    hits = [F.when(c.rlike(pattern), F.lit(key)) for key, pattern in rules]
    return F.coalesce(*hits, F.lit(default).cast("string"))


def any_match(c: Column, patterns: Iterable[str]) -> Column:
    """One alternation of all patterns; NULL matches nothing."""
    return F.coalesce(c.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def lookup(c: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """Label of a key. The table is a small literal map."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default).cast("string"))


def infer_competition(c: Column, rules: Rules = fixed.DOCUMENT_COMPETITION_PATTERNS) -> Column:
    return first_match(c, rules, fixed.OTHER)


def infer_document_type(c: Column, rules: Rules = fixed.DOCUMENT_TYPE_PATTERNS) -> Column:
    return first_match(c, rules, fixed.OTHER)


def detect_competition(c: Column, rules: Rules = fixed.QUERY_COMPETITION_PATTERNS) -> Column:
    """Competition a query names, NULL when it names none."""
    return first_match(c, rules)


def classify_document(title: Column, filename: Column) -> tuple[Column, Column]:
    both = F.concat_ws(" ", tx.non_empty(title), tx.non_empty(filename))
    return infer_competition(both), infer_document_type(both)


def normalize_competition(c: Column, keys: Iterable[str] = tuple(fixed.COMPETITION_LABELS),
                          aliases: Mapping[str, str] = fixed.COMPETITION_ALIASES,
                          substrings: Rules = fixed.COMPETITION_SUBSTRINGS) -> Column:
    raw = F.regexp_replace(F.lower(tx.strip(c)), rf"(?U){tx.SPACE}+", "_")
    return F.coalesce(
        F.when(raw.isin(*keys), raw),
        lookup(raw, aliases),
        *[F.when(raw.contains(part), F.lit(key)) for part, key in substrings],
        F.lit(fixed.OTHER),
    )


def normalize_document_type(c: Column, keys: Iterable[str] = tuple(fixed.DOCUMENT_TYPE_LABELS)) -> Column:
    raw = F.translate(F.lower(tx.strip(c)), " ", "-")
    return F.when(raw.isin(*keys), raw).otherwise(F.lit(fixed.OTHER))


def competition_label(c: Column) -> Column:
    return lookup(c, fixed.COMPETITION_LABELS, fixed.OTHER_LABEL)


def document_type_label(c: Column) -> Column:
    return lookup(c, fixed.DOCUMENT_TYPE_LABELS, fixed.OTHER_LABEL)


def category_of(competition: Column) -> Column:
    return lookup(competition, fixed.QUERY_CATEGORIES)


def is_draft(*parts: Column, patterns: Iterable[str] = fixed.DRAFT_PATTERNS) -> Column:
    return any_match(F.concat_ws(" ", *[tx.or_empty(p) for p in parts]), patterns)


def normalize_rule_text(c: Column, rewrites: Rules = fixed.RULE_TEXT_REWRITES) -> Column:
    return rewritten_rule_text(nfkc(tx.strip(tx.or_empty(c))), rewrites)


def rewritten_rule_text(folded: Column, rewrites: Rules = fixed.RULE_TEXT_REWRITES) -> Column:
    """The part of :func:`normalize_rule_text` after Unicode folding."""
    only = fixed.HANGUL if rewrites is fixed.RULE_TEXT_REWRITES else None
    return tx.squash(F.translate(tx.rewrite(folded, rewrites, only=only), "\u200b", " "))


def normalize_query(c: Column, rewrites: Rules = fixed.QUERY_REWRITES,
                    expansions: Iterable[tuple] = fixed.QUERY_EXPANSIONS) -> Column:
    """Spelling and spacing rewrites, then synonyms where absent; applying it twice changes nothing."""
    return expand_query(nfkc(tx.strip(tx.or_empty(c))), rewrites, expansions)


def expand_query(folded: Column, rewrites: Rules = fixed.QUERY_REWRITES,
                 expansions: Iterable[tuple] = fixed.QUERY_EXPANSIONS) -> Column:
    """The part of :func:`normalize_query` after Unicode folding."""
    q = tx.squash(F.translate(tx.rewrite(folded, rewrites), "\u200b", " "))
    for rule in expansions:
        q = tx.let(q, _expansion(*rule))
    return q


def _expansion(required: Iterable[str], forbidden: str, extra: str) -> Callable[[Column], Column]:
    def expand(q: Column) -> Column:
        wanted = reduce(lambda a, b: a & b, [q.rlike(r) for r in required])
        return F.when(wanted & ~q.rlike(forbidden), F.concat(q, F.lit(extra))).otherwise(q)

    return expand


def query_document_type(c: Column) -> Column:
    """Document type a query asks for: explicit names first, then vehicle components, then a guess."""
    guess = normalize_document_type(infer_document_type(c))
    return F.coalesce(
        F.when(c.rlike(fixed.TECHNICAL_SECTION_PATTERN), F.lit(fixed.OTHER)),
        F.when(guess.isin(*fixed.DIRECT_QUERY_TYPES), guess),
        F.when((guess == "safety") & c.rlike(fixed.EXPLICIT_TYPE_PATTERNS["safety"]), guess),
        F.when(c.rlike(fixed.COMPONENT_PATTERN), F.lit("vehicle-technical")),
        F.when(guess != fixed.OTHER, guess),
    )


def query_terms(normalized: Column, stop: Iterable[str] = fixed.QUERY_STOP_WORDS,
                pattern: str = fixed.QUERY_TERM_PATTERN) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(normalized), F.lit(pattern)))
    return F.array_except(words, F.array(*[F.lit(w) for w in stop]))


def references(normalized: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(normalized, F.lit(pattern))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("bigint"))))


def preserved_words(c: Column, suffixes: Iterable[str] = fixed.PARTICLE_SUFFIXES,
                    stop: Iterable[str] = fixed.PRESERVATION_STOP_WORDS) -> Column:
    """Hangul words without their particle (the first suffix listed that leaves two letters)."""
    runs = F.regexp_extract_all(tx.or_empty(c), F.lit("([가-힣]{2,})"))

    def stem(w: Column) -> Column:
        cuts = [F.when(w.endswith(s) & (F.length(w) - len(s) >= 2),
                       F.substring(w, F.lit(1), F.length(w) - len(s))) for s in suffixes]
        return F.coalesce(*cuts, w)

    return F.array_distinct(F.array_except(F.transform(runs, stem), F.array(*[F.lit(w) for w in stop])))


def preserves_identifiers(original: Column, rewritten: Column) -> Column:
    """True when every code, competition name and content word of a query survives its rewrite."""
    names = F.concat(F.regexp_extract_all(original, F.lit(fixed.IDENTIFIER_PATTERN)),
                     F.regexp_extract_all(original, F.lit(fixed.COMPETITION_TERM_PATTERN)))
    words = preserved_words(original)
    low = F.lower(rewritten)
    compact = F.regexp_replace(low, "[^가-힣a-z0-9]", "")
    return tx.let(low, lambda text: F.forall(names, lambda t: text.contains(F.lower(t)))) & tx.let(
        compact, lambda text: F.forall(words, lambda t: text.contains(t)))
