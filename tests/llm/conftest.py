import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Size long, kept string"

WORDS = "the quick brown fox jumps over a lazy dog while seven green birds sing in old trees and nobody minds at all today".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, columns with clashing names."""
    long_text = prose(1, 30_000)
    rows = [
        (1, "plain text of a few words", "en", "a", 1, 5, "x"), (2, "plain text of a few words", "en", "b", None, 6, "y"), (2, "plain text of a few words", "en", "b", None, 6, "y"),
        (3, None, "en", None, 1, None, None), (4, None, None, "a", 1, 1, "z"), (5, "", "de", "b", 0, 1, "z"), (6, "   \n\t ", "de", "a", 0, 1, "z"),
        (7, long_text, "fr", "a", 1, 1, "z"), (8, long_text + " more", "fr", "c", 1, 1, "z"), (None, "no id", "en", "c", 1, 1, "z"), (None, "plain text of a few words", None, None, None, None, None),
        (9, "Ünïcode ▁ text 日本語 🙂\u0000\u0085 end", "es", "c", 1, 1, "z"), (10, "one", "es", "c", 1, 1, "z"), (11, "ONE", "es", "c", 1, 1, "z"), (12, "x" * 50_000, "es", "c", 1, 1, "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def skewed_docs(spark):
    """A third of all rows share one text and one source; near copies; plain rows."""
    rows = [(i, "the very same text again and again and again", "en", "hot", 1, 1, "x") for i in range(100)]
    base = prose(2, 120).split()
    for i in range(100):
        words = list(base)
        for k in range(i % 6):
            words[(i * 7 + k * 31) % len(words)] = f"edit{i}"
        rows.append((100 + i, " ".join(words), "de", "hot", 1, 1, "x"))
    rows += [(200 + i, prose(100 + i, 20 + i), "fr", f"s{i % 5}", 1, 1, "x") for i in range(100)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)
