import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from loreloom.llm import exact_dedup, ngram_join


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            kept = left and i == keep
            left = left and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", ["odd_docs", "no_docs", "skewed_docs"])
def test_exact_groups(request, name):
    docs = request.getfixturevalue(name)
    got = [tuple(r) for r in exact_dedup.exact_groups(docs).collect()]
    assert sorted(got, key=str) == brute_exact(docs.collect())


@pytest.mark.parametrize("name", ["odd_docs", "no_docs", "skewed_docs"])
def test_drop_copies_keeps_rows_whole(request, name):
    docs = request.getfixturevalue(name)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    rows, given = left.collect(), {tuple(r) for r in docs.collect()}
    texts = [r.text or "" for r in rows]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in docs.collect()})
    assert all(tuple(r) in given for r in rows)
    want = {(i, s) for i, _, _, kept, s in brute_exact(docs.collect()) if kept}
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows} == want


def test_filter_never_misses_a_repeat():
    rng = np.random.default_rng(0)
    hashes = rng.integers(-(1 << 63), 1 << 63, 5000)
    hashes = np.concatenate([hashes, hashes[:500]])
    bits = 1 << 16
    one, two = exact_dedup._pack(exact_dedup.positions(hashes[:3000], bits)), exact_dedup._pack(exact_dedup.positions(hashes[3000:], bits))
    import pyarrow as pa

    table = exact_dedup._hit_twice(pa.Table.from_batches([one, two]))
    seen = np.unpackbits(np.frombuffer(table["bits"][0].as_py(), np.uint8))[exact_dedup.positions(hashes, bits)].all(0)
    assert seen[:500].all() and seen[5000:].all() and seen[500:5000].mean() < 0.2


def word_sets(rows):
    sets = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        shingles = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        sets.setdefault(r.doc_id, []).append(shingles)
    return sets


def brute_groups(rows):
    sets = [(i, s) for i, many in word_sets(rows).items() for s in many]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    named = [(i, s) for i, s in sets if i is not None and s]
    for n, (i, a) in enumerate(named):
        for j, b in named[:n]:
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("name", ["odd_docs", "no_docs", "skewed_docs"])
def test_near_groups(request, name):
    docs = request.getfixturevalue(name)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in ngram_join.near_groups(docs).collect()), key=str)
    assert got == brute_groups(docs.collect())


def test_near_groups_in_small_blocks(spark, skewed_docs, monkeypatch):
    """Many blocks, ranges and cut branches give the same groups."""
    for name, value in (("BLOCK_BYTES", 20_000), ("RANGE_BYTES", 30_000), ("BLOCK", 8), ("BUCKET", 16), ("SCOUTS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in ngram_join.near_groups(skewed_docs).collect()), key=str)
    assert got == brute_groups(skewed_docs.collect())


def brute_links(rows):
    """Sets of one id that link with a set; the number of other (id, set) pairs with a linking set."""
    pairs = {(i, frozenset(s)) for i, many in word_sets(rows).items() for s in many}
    named = [(i, s) for i, s in pairs if i is not None and s]
    links = {p: sum(100 * len(p[1] & s) >= 75 * len(p[1] | s) for i, s in named if (i, s) != p) if p in named else 0 for p in pairs}
    first = {p: min(i for i, s in named if s == p[1]) if p in named else p[0] for p in pairs}
    return sorted(((i, len(s), first[i, s], links[i, s]) for i, many in word_sets(rows).items() for s in map(frozenset, many)), key=str)


@pytest.mark.parametrize("name", ["odd_docs", "no_docs", "skewed_docs", "shared ids"])
@pytest.mark.parametrize("block", [512, 7])
def test_every_link_is_counted(request, spark, monkeypatch, name, block):
    """Also links between sets that are connected without them, and copies on both sides."""
    monkeypatch.setattr(ngram_join, "LINK_BLOCK", block)
    if name == "shared ids":
        base = [f"w{i}" for i in range(60)]
        edit = lambda k: " ".join(base[:50] + [f"e{k}"] * 2 + base[52:])
        docs = spark.createDataFrame([(5, edit(1)), (5, edit(2)), (7, edit(1)), (8, edit(2)), (8, edit(2).replace(" ", "  ")), (9, "alone " * 9), (3, "alone " * 9)], "doc_id long, text string")
    else:
        docs = request.getfixturevalue(name)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "class_id", "n_links")) for r in ngram_join.near_groups(docs).collect()), key=str)
    assert got == brute_links(docs.collect())
    if name == "skewed_docs":
        assert sum(g[3] for g in got if 100 <= (g[0] or 0) < 200) > 2 * 99


def test_one_of_each_group_stays(skewed_docs):
    left = ngram_join.drop_near_copies(skewed_docs)
    assert left.columns == skewed_docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c in brute_groups(skewed_docs.collect())})


def texts_of_one_id(spark):
    base = [f"w{i}" for i in range(60)]
    edit = lambda k: " ".join(base[:50] + [f"e{k}"] * 2 + base[52:])
    unique = " ".join(f"u{i}" for i in range(40))
    return spark.createDataFrame([(5, unique), (5, edit(1)), (3, edit(2)), (9, edit(3)), (9, " ".join(f"v{i}" for i in range(30)) + " end"),
                                  (2, " ".join(f"v{i}" for i in range(30))), (None, edit(1)), (4, None), (4, "")], "Doc_id long, Text string")


def test_a_unique_text_under_the_id_of_a_near_copy_stays(spark):
    docs = texts_of_one_id(spark)
    left = ngram_join.drop_near_copies(docs)
    rows = docs.collect()
    # 9 links both groups, so 2 stands for all; the unique text of 5 and rows that link with nothing stay.
    assert sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, [rows[0], rows[5], *rows[6:]]), key=str)
    groups = {(r.doc_id, r.component_id) for r in ngram_join.near_groups(docs, "Doc_id", "Text").collect()}
    assert groups == {(5, 2), (3, 2), (9, 2), (2, 2), (4, 4), (None, None)}


@pytest.mark.parametrize("name", ["odd_docs", "no_docs"])
def test_drop_near_copies_on_odd_rows(request, name):
    docs = request.getfixturevalue(name)
    left, groups = ngram_join.drop_near_copies(docs), brute_groups(docs.collect())
    assert left.columns == docs.columns
    first = {i: c for i, _, c in groups}
    # No group here has two texts under one id, so exactly the rows of other ids go.
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if first[r.doc_id] == r.doc_id)


def test_strangers_meet_a_large_part_without_its_pairs(spark, monkeypatch):
    """Without scouting rounds everything is left to the last phase, with several blocks on both sides."""
    for name, value in (("SCOUTS", 1), ("BLOCK", 4), ("BUCKET", 8)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(60):
        words = list(base) if i % 3 else base[:40] + [f"c{i % 5}_{k}" for k in range(40)]
        for at in rng.integers(0, 80, 3):
            words[at] = f"e{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in ngram_join.near_groups(docs).collect()), key=str)
    assert got == brute_groups(docs.collect())


def test_rounds_delete_their_tables(spark, skewed_docs):
    from pathlib import Path

    from loreloom.session import work_folder

    root = Path(work_folder(spark, "x").removeprefix("file:")).parent
    before = set(root.glob("round-*"))
    ngram_join.near_groups(skewed_docs).count()
    assert len(set(root.glob("round-*")) - before) <= 1  # the last parts


def test_prefix_tree_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = [np.flatnonzero(rng.random(50) < 0.6) for _ in range(3)]
        sets = []
        for _ in range(int(rng.integers(2, 30))):
            b = base[rng.integers(3)]
            sets.append(np.unique(np.append(b[rng.random(len(b)) > rng.random() * 0.3], rng.integers(0, 50, 2))))
        sizes = np.array([len(s) for s in sets]) + rng.integers(0, 3, len(sets))
        tree = ngram_join.PrefixTree(sets, sizes)
        for s, size in zip(sets, sizes, strict=True):
            flags = np.zeros(51, bool)
            flags[s] = True
            common = [len(np.intersect1d(s, t)) for t in sets]
            want = {j for j, c in enumerate(common) if 100 * c >= 75 * (size + sizes[j] - c)}
            assert set(tree.walk(flags, len(s), int(size), np.ones(len(sets), bool)).tolist()) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}
