import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from loreloom.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, N_convs int, path string"


def brute(rows, rebuild=True, every=20):
    talks = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in talks.items()}
    said = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        said[c] = tuple(own.get(c - c % every, [])[:h] + ts[h:]) if rebuild else tuple(ts)
    members = defaultdict(set)
    for c, ts in said.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].add(c)
    kids = defaultdict(set)
    for path in members:
        if path:
            kids[path[:-1]].add(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in kids[path])
    out = []
    for path, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(said[c]) == len(path)))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_talks(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        kind = r.randrange(4)
        for t in range(r.randrange(1, most)):
            text = "hot first turn" if not t and kind else f"turn {t}" if kind == 1 else f"a {r.randrange(2)} b"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text, 0, "x"))
    r.shuffle(rows)
    return rows


ODD = [
    (1, 0, "user", "hi there", 1, ""), (2, 0, "user", "hi there", 1, ""), (2, 1, None, None, 1, ""), (3, None, "user", "first", 1, ""), (3, 0, "user", "second", None, None),
    (4, 0, None, "", 1, ""), (5, 0, "", None, 1, ""), (None, 0, "user", "no conversation", 1, ""), (None, None, None, None, None, None), (6, 3, "user", "b", 1, ""), (6, 3, "user", "a", 1, ""),
    (6, 3, "user", "a", 1, ""), (6, 3, "assistant", "c", 1, ""), (20, 0, "user", "base", 1, ""), (21, 0, "user", "own", 1, ""), (22, 0, "user", "x" * 40_000, 1, ""), (22, 1, "user", "w " * 9_000, 1, ""),
    (-7, 0, "user", "hi there", 1, ""), (7, 0, "user", "hi there", 1, ""), (40, -5, "user", "minus", 1, ""), (40, 5_000, "user", "far", 1, ""), (41, 0, "a", "b", 1, ""), (42, 0, "", "ab", 1, ""),
]
DEEP = [(c, t, "user", f"t{t}" if t < 37 or c == 3 else f"t{t} of {c}", 0, "") for c in range(6) for t in range((60, 37, 12, 50, 50, 1)[c])]
COPIES = [(c, t, "user", f"same {t}", 0, "") for c in range(60) for t in range(5)] + random_talks(9, 30, 5)


def result(spark, rows, rebuild=True):
    nodes = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), shared_openings=rebuild)
    assert nodes.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, nodes.collect()), key=str)


@pytest.mark.parametrize("rows", [ODD, COPIES, []], ids=["odd", "copies", "empty"])
@pytest.mark.parametrize("rebuild", [True, False])
def test_nodes(spark, rows, rebuild):
    every = [r for r in rows if r[0] is None or r[0] >= 0]  # Python rounds remainders of negative ids another way
    assert result(spark, every, rebuild) == brute(every, rebuild)


def test_negative_ids(spark):
    assert result(spark, ODD, False) == brute(ODD, False)


@pytest.mark.parametrize("segment, cell, part", [(4, 1_024, 3), (16, 4, 1_024), (30, 2, 7)])
@pytest.mark.parametrize("rows", [DEEP, random_talks(1, 70, 9)], ids=["deep", "hot"])
def test_blocks_and_crowded_beginnings(spark, monkeypatch, rows, segment, cell, part):
    for name, value in (("SEGMENT", segment), ("CELL", cell), ("PART", part), ("BUCKET", 16), ("SMALL", 2)):
        monkeypatch.setattr(prefix_trie, name, value)
    assert result(spark, rows) == brute(rows)


def test_only_conversations_without_ids(spark):
    assert result(spark, [(None, 1, "user", "x", 1, "")]) == []


def test_whole_table(spark):
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = sorted(map(tuple, prefix_trie.prefix_trie(talks, shared_openings=True).collect()), key=str)
    assert got == brute([tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()])
