from collections import defaultdict

import pytest

from loreloom.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, N_turns int"


def brute(rows, part=chat.PART):
    talks = defaultdict(set)
    for r in rows:
        if r[0] is not None:
            talks[r[0]].add(r[1:4])
    nulls_first = lambda t: tuple((v is not None, v) for v in t)
    said = {c: tuple((t[1], t[2] or "") for t in sorted({(a, b, t or "") for a, b, t in ts}, key=nulls_first)) for c, ts in talks.items()}
    keep = [c for c, s in said.items() if not any(len(o) > len(s) and o[:len(s)] == s for o in said.values()) and c == min(k for k, o in said.items() if o == s)]
    out = set()
    for c in keep:
        parts = defaultdict(list)
        for t in sorted({(a, b, t or "") for a, b, t in talks[c]}, key=nulls_first):
            parts[None if t[0] is None else t[0] // part].append(f"<|im_start|>{'none' if t[1] is None else t[1]}\n{t[2]}<|im_end|>\n")
        out |= {(c, p, len(said[c]), sum(o == said[c] for o in said.values()), "".join(x)) for p, x in parts.items()}
    return out


ODD = [
    (1, 0, "user", "hi", 1), (1, 1, "assistant", "hello", 1), (2, 0, "user", "hi", 1), (3, 0, "user", "hi", 1), (3, 1, "assistant", "hello", 1), (3, 2, "user", "bye", None),
    (4, 0, "user", "hi", 1), (4, 1, "assistant", "hello", 1), (4, 2, "user", "bye", 2), (5, 0, None, None, 1), (6, 0, "", None, 1), (6, 0, "", None, 1), (7, None, "user", "late", 1), (7, 0, "user", "x", 1),
    (None, 0, "user", "hi", 1), (None, None, None, None, None), (8, 0, "user", "a", 1), (8, 0, "user", "b", 1), (9, 5, "user", "a", 1), (9, 5000, "user", "b" * 10_000, 1), (10, 0, "user", "hi", 1), (10, 1, "user", "hello", 1),
]
HOT = [(c, 0, "system", "same first turn", 0) for c in range(60)] + [(c, 1, "user", f"question {c % 7}", 0) for c in range(60)] + [(c, 2, "assistant", "answer", 0) for c in range(0, 60, 3)] + [(99, t, "user", f"t{t}", 0) for t in range(90)]


@pytest.mark.parametrize("rows", [ODD, HOT, []], ids=["odd", "hot", "empty"])
def test_rendered(spark, rows):
    got = chat.rendered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 16)
    got = {tuple(r) for r in chat.rendered(spark.createDataFrame(HOT, SCHEMA)).collect()}
    assert got == brute(HOT, 16) and len({p for c, p, *_ in got if c == 99}) == 6
