"""Stores and sources that have to hold at any size: JSON arrays by byte ranges, bucketed tables, routed collections."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loreloom.operators import orders as od, retrieval as rt
from loreloom.sources import buckets, json_arrays, readers, sinks


def nasty(r):
    return "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", " ", "\n", "é", "x", '\\"', "}{", "\\\\"]) for _ in range(r.randrange(12)))


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_arrays_are_read_by_byte_ranges(spark, tmp_path, small_ranges):
    r = random.Random(4)
    rows = [{"id": i, "title": nasty(r), "deep": {"a": [{"b": nasty(r)}, {}], "c": {}}} for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(rows[:200], ensure_ascii=False))
    (tmp_path / "b.json").write_text(" [\n" + ",\n".join(json.dumps(x, indent=1) for x in rows[200:]) + "\n]\n")
    (tmp_path / "c.json").write_text("[]")
    path = str(tmp_path)
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 10
    objects = json_arrays.read_objects(spark, path).collect()
    assert sorted((Path(o.file).name, o.object) for o in objects) == sorted([("a.json", i) for i in range(200)] + [("b.json", i) for i in range(100)])
    assert sorted((json.loads(o.json) for o in objects), key=lambda x: x["id"]) == rows
    typed = json_arrays.read_array(spark, path, "id long, title string, deep struct<a: array<struct<b: string>>>").orderBy("id").collect()
    assert [(x.id, x.title, x.deep.a[0].b) for x in typed] == [(x["id"], x["title"], x["deep"]["a"][0]["b"]) for x in rows]


def test_posts_of_an_array(spark, tmp_path):
    posts = [{"id": 7, "title": 'a "}" b', "answers": [{"body": "x", "url": "u"}]}, {"id": 8, "title": None}]
    (tmp_path / "posts.json").write_text(json.dumps(posts))
    got = readers.read_posts(spark, str(tmp_path / "posts.json")).orderBy("id").collect()
    assert [(str(p.id), p.title, len(p.answers or [])) for p in got] == [("7", 'a "}" b', 1), ("8", None, 0)]


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, at int")


def content(spark, path):
    rows = buckets.current(spark, path)
    return {} if rows is None else {r.k: r.v for r in rows.collect()}


def test_a_load_rewrites_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    assert buckets.current(spark, path) is None
    assert buckets.load(table(spark, [(i, "old", 0) for i in range(500)]), path, "k", buckets=16) == 0
    update = [(3, "first", 1), (3, "last", 2), (900, "new", 1)]
    assert buckets.load(table(spark, update), path, "k", order=[F.col("at")]) == 1
    assert content(spark, path) == {i: "old" for i in range(500)} | {3: "last", 900: "new"}
    rewritten = [p for p in (tmp_path / "t/files/load=1").iterdir() if p.name.startswith("bucket=")]
    assert 1 <= len(rewritten) <= 2
    assert buckets.vacuum(spark, path) == len(rewritten) and content(spark, path)[3] == "last"


def test_an_uncommitted_load_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.load(table(spark, [(1, "a", 0)]), path, "k", buckets=4)
    buckets.load(table(spark, [(1, "b", 0), (2, "b", 0)]), path, "k")
    (tmp_path / "t/manifest/version=1/_SUCCESS").unlink()
    assert content(spark, path) == {1: "a"}
    buckets.load(table(spark, [(1, "c", 0)]), path, "k")  # takes the number of the failed load
    assert content(spark, path) == {1: "c"}


def test_prune_and_recreate(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.load(table(spark, [(i, "a", 0) for i in range(50)]), path, "k", buckets=8)
    buckets.load(table(spark, [(1, "b", 0), (77, "b", 0)]), path, "k", prune=True)
    assert content(spark, path) == {1: "b", 77: "b"}
    buckets.load(table(spark, [(5, "c", 0)]), path, "k", recreate=True, buckets=2)
    assert content(spark, path) == {5: "c"}
    buckets.load(table(spark, []), path, "k", prune=True)
    assert content(spark, path) == {}


def test_routing_replaces_touched_collections_and_splits_a_hot_one(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        rows = [("ev" if i % 3 else "baja", "rules", f"s{i}", i, "2026", f"text {i} " * 20) for i in range(3_000)]
        docs = spark.createDataFrame(rows, "competition string, document_type string, source_key string, chunk_index int, year string, text string").repartition(8)
        path = str(tmp_path / "c")
        written = [r.collection for r in sinks.route(docs, path, "2026").collect()]
        assert len(written) == 2 and sum(len(list((tmp_path / f"c/collection={c}").glob("*.parquet"))) for c in written) > 4
        hot = next(c for c in written if "ev" in c)
        again = sinks.route(docs.where("competition = 'ev' AND chunk_index < 10"), path, "2026", [hot, "rules-none-2026"])
        assert [r.collection for r in again.collect()] == [hot]
        assert {r.collection: r["count"] for r in spark.read.parquet(path).groupBy("collection").count().collect()}[hot] == 6
        assert sinks.route(docs.limit(0), path, "2026", written).count() == 0 and not list((tmp_path / "c").glob("collection=*/*.parquet"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_an_order_with_a_third_of_all_events(spark):
    events = [("hot", i, "cancelled" if i % 2 else "paid") for i in range(600)] + [(f"o{i}", i, "paid" if i % 2 else "cancelled") for i in range(1_200)]
    e = spark.createDataFrame(events, "order_id string, seq long, event string").withColumn("ts", F.lit("2026-01-01").cast("timestamp")).repartition(4)
    orders = e.select("order_id").distinct().select("order_id", F.lit(1).cast("long").alias("user_id"), F.lit(2).cast("long").alias("quantity"), F.lit("2026-01-01").cast("timestamp").alias("created_at"))
    got = {r.order_id: (r.status, r.decided_seq, r.cancelled_seq) for r in od.settle(orders, e, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert got["hot"] == ("cancelled", 0, 1) and got["o1"] == ("paid", 1, None) and got["o2"] == ("pending", None, None)


def test_text_match_with_a_word_in_a_third_of_all_points(spark, monkeypatch):
    monkeypatch.setattr(rt, "MATCH_PIECE", 32)
    r = random.Random(2)
    tokens = [[f"w{r.randrange(60)}" for _ in range(8)] + (["hot"] if i % 3 == 0 else []) for i in range(400)] + [[], ["hot"]]
    asked = [["hot"], ["hot", "w1"], ["w1", "w2"], ["unheard"], ["hot", "unheard"], []] + [[f"w{i}", f"w{i + 1}"] for i in range(20)]
    points = spark.createDataFrame(list(enumerate(tokens)), "id long, tokens array<string>").repartition(4)
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, match array<string>")
    want = {(q, i) for q, m in enumerate(asked) if m for i, t in enumerate(tokens) if set(m) <= set(t)}
    got = [tuple(x) for x in rt.text_match(points, queries, max_broadcast=2).collect()]
    assert len(got) == len(want) and set(got) == want
