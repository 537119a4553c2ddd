import re
from collections import Counter, defaultdict

import pytest

from loreloom.llm import mixing, sharding


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        rest, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w > 2 * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / w for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("name", ["odd_docs", "skewed_docs", "no_docs"])
def test_mix(request, name):
    docs = request.getfixturevalue(name)
    rows = mixing.mix_plan(docs).collect()
    given = docs.collect()
    assert len(rows) == len(given)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
    assert all(r.source_size == sizes[r.source] for r in rows)
    want = brute_targets(dict(sizes))
    for r in rows:
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert r.taken == r.copies * r["size"] and 0 <= r.taken <= 2 * r["size"]
    words = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in given]
    assert Counter(words) == Counter((r.doc_id, r["size"]) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(docs).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in rows for _ in range(r.copies))
    if name == "skewed_docs":
        for s in sizes:
            assert sum(r.taken for r in rows if r.source == s) == pytest.approx(want[s], rel=0.05)


def test_given_columns_of_any_name_are_mixed(odd_docs):
    from pyspark.sql import functions as F

    named = odd_docs.withColumns({"__size": F.lit("a"), "__id": F.lit("b"), "__copies": F.lit("c"), "__row": F.lit("d"), "__class": F.lit("e")})
    out = mixing.mixed(named)
    assert out.columns == named.columns
    assert {tuple(r[c] for c in ("__size", "__id", "__copies", "__row", "__class")) for r in out.collect()} == {tuple("abcde")}


def test_no_text_and_its_name_are_two_texts(spark):
    """Each of two groups fits a shard; as one group they could not stay whole."""
    rows = [(i, None if i % 2 else "null text") for i in range(60)]
    placed = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=2).collect()
    assert {len({r.shard for r in placed if r.doc_id % 2 == k}) for k in (0, 1)} == {1}


@pytest.mark.parametrize("name", ["odd_docs", "skewed_docs", "no_docs"])
def test_shards(request, name):
    docs = request.getfixturevalue(name)
    rows = sharding.shard_documents(docs, shards=4).collect()
    given = docs.collect()
    assert sorted(str((r.doc_id, r["size"])) for r in rows) == sorted(str((r.doc_id, len((r.text or "").encode()) + 1)) for r in given)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(4)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(4))
    if name == "skewed_docs":
        # A third of the rows cannot stay together in a quarter of the shards' room, but should not touch all four.
        hot = Counter(r.shard for r in rows if r.doc_id < 100)
        assert len(hot) <= 3
        near = defaultdict(set)
        for r in rows:
            near[r.text_crc32].add(r.shard)
        small = [len(v) for k, v in near.items() if sum(1 for r in rows if r.text_crc32 == k) in range(2, 30)]
        assert sum(small) <= 1.2 * len(small)


def test_groups_stay_whole_where_every_text_has_copies(spark):
    """No shard has room beyond its quota, so groups come together only by swaps and by as many rounds as it takes."""
    docs = spark.range(4096).selectExpr("id AS doc_id", "concat('text ', id % 1024) AS text")
    rows = sharding.shard_documents(docs, shards=8).collect()
    assert set(Counter(r.shard for r in rows).values()) == {512}
    groups = defaultdict(Counter)
    for r in rows:
        groups[r.text_crc32][r.shard] += 1
    pairs = sum(n * (n - 1) // 2 for g in groups.values() for n in g.values())
    print("pairs kept", pairs / (1024 * 6), "whole", sum(len(g) == 1 for g in groups.values()) / 1024)
    assert pairs >= 0.8 * 1024 * 6
