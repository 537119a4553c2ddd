import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loreloom import schemas
from loreloom.operators import ordered, orders as od, qna_chunks as qna, turns as tn
from loreloom.plans.streams import run
from loreloom.sources import readers, sinks
from loreloom.streaming import ingest, orders as so, turns as st
from loreloom.session import work_folder

T0 = datetime(2026, 1, 1)


def event(turn, seq, ms, kind, payload=None):
    return (turn, seq, T0 + timedelta(milliseconds=ms), kind, None if payload is None else payload if isinstance(payload, str) and payload.startswith("!") else json.dumps(payload))


def turn(name, *steps, start=0):
    return [event(name, i, start + 100 * i, kind, payload) for i, (kind, payload) in enumerate(steps)]


USAGE = {"input_tokens": 5, "output_tokens": 7, "thinking_tokens": 1, "resolved_model": "m2", "resolved_model_id": "m2-id", "finish_reason": "stop"}
FALL = {"from": "m1", "to": "m2", "reason": {"provider": "p", "code": "slow", "message": "too slow"}}
EVENTS = (
    turn("clean", ("rewrite", "better"), ("retrieval", {"status": "ok", "retrieval_ms": 9, "rerank_ms": 2, "competition": "baja"}), ("sources", [{"source_key": "k1"}, {"source_key": ""}]),
         ("model", {"resolved_model": "m2", "resolved_model_id": "m2-id"}), ("token", "a"), ("token", "b"), ("usage", USAGE), ("done", {}))
    + turn("fallback", ("model", {"resolved_model": "m1"}), ("fallback", FALL), ("model", {"resolved_model": "m2"}), ("token", "x"), ("usage", USAGE), ("done", {}), start=1000)
    + turn("early", ("retrieval", {"status": "failed"}), ("error", {"message": "none"}), ("done", {}), start=2000)
    + turn("partial", ("token", "x"), ("error", {"provider": "q", "code": "c", "message": "y" * 2000}), ("done", {}), start=3000)
    + turn("nobody", ("model", {"resolved_model": "m1"}), ("fallback", FALL), ("fallback", {"from": "m2", "to": "m3"}), ("error", "plain"), ("done", {}), start=4000)
)


def stream(spark, tmp_path, rows, schema, name="in"):
    """Rows in three files, read one per micro-batch."""
    folder = str(tmp_path / name)
    third = max(1, -(-len(rows) // 3))
    for i in range(0, len(rows), third):
        spark.createDataFrame(rows[i:i + third], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def as_set(df):
    return {r.turn_id: tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()}


def test_turns_in_batch_and_stream(spark, tmp_path):
    batch = tn.roll_up(spark.createDataFrame(EVENTS, schemas.TURN_EVENTS))
    got = {r.turn_id: r for r in batch.collect()}
    assert {k: r.status for k, r in got.items()} == {"clean": "success", "fallback": "success_fallback", "early": "error", "partial": "partial_error", "nobody": "error"}
    c = got["clean"]
    assert (c.first_token_ms, c.generation_ms, c.total_ms, c.source_ids, c.rewritten_query, c.competition, c.input_tokens) == (400, 600, 700, ["k1"], "better", "baja", 5)
    assert (got["fallback"].resolved_model, got["fallback"].attempted_models, got["fallback"].error_code) == ("m2", ["m1", "m2"], "slow")
    assert (got["nobody"].resolved_model, got["nobody"].attempted_models, got["nobody"].error_message) == (None, ["m1", "m2", "m3"], "plain")
    assert len(got["partial"].error_message) == 1000 and got["early"].error_provider == "application"


@pytest.mark.parametrize("seed", [1, 2])
def test_turns_in_any_order_of_arrival(spark, tmp_path, seed):
    batch = tn.roll_up(spark.createDataFrame(EVENTS, schemas.TURN_EVENTS))
    late = [event("open", 0, 7_200_000, "token", "x"), event("open", 1, 7_200_001, "token", "y"), event("open", 2, 7_200_002, "token", "z")]
    shuffled = random.Random(seed).sample(EVENTS, len(EVENTS))
    # Three mixed micro-batches before the watermark moves, then one that closes the turns.
    folder = str(tmp_path / "in")
    for part in (shuffled[::3], shuffled[1::3], shuffled[2::3], late[:1], late[1:]):
        spark.createDataFrame(part, schemas.TURN_EVENTS).coalesce(1).write.mode("append").parquet(folder)
    events = spark.readStream.schema(schemas.TURN_EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    streamed = run(st.roll_up_stream(events, delay="1 hour"), f"turns-test-{seed}").drop("batch")
    assert as_set(streamed.select(batch.columns)) == as_set(batch)


def test_a_late_early_event_does_not_win(spark, tmp_path):
    rows = [event("t", 3, 300, "usage", {"input_tokens": 50}), event("t", 1, 100, "usage", {"input_tokens": 20}), event("t", 2, 200, "model", {"resolved_model": "late"}),
            event("t", 0, 0, "model", {"resolved_model": "early"}), event("t", 4, 400, "done", {}), event("z", 0, 9_000_000, "token", "x")]
    got = run(st.roll_up_stream(stream(spark, tmp_path, rows, schemas.TURN_EVENTS), delay="0 seconds"), "turns-late").where("turn_id = 't'").first()
    want = tn.roll_up(spark.createDataFrame(rows, schemas.TURN_EVENTS)).where("turn_id = 't'").first()
    assert (got.input_tokens, got.resolved_model, got.attempted_models) == (50, "late", ["early", "late"])
    assert got.asDict() | {"batch": None} == want.asDict() | {"batch": None}


def test_turns_of_a_bucket_close_one_by_one(spark, tmp_path):
    """Turns of one state with other ends, a pause inside a turn, a turn without a name, and a turn that stays open."""
    def at(name, *minutes):
        return [event(name, m, m * 60_000, "token" if i else "model", "x" if i else {"resolved_model": f"m{m}"}) for i, m in enumerate(minutes)]

    first = at("a", 0, 1) + at("b", 0, 30) + at("null", 5) + at(None, 2, 3) + at("c", 40)
    second = at("b", 35) + at("d", 50, 52) + at("e", 400)
    folder = str(tmp_path / "in")
    for part in (first, second, at("f", 401)):
        spark.createDataFrame(part, schemas.TURN_EVENTS).coalesce(1).write.mode("append").parquet(folder)
    events = spark.readStream.schema(schemas.TURN_EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    streamed = run(st.roll_up_stream(events, delay="10 minutes", buckets=1), "turns-bucket")
    batch = tn.roll_up(spark.read.schema(schemas.TURN_EVENTS).parquet(folder).where("turn_id NOT IN ('e', 'f') OR turn_id IS NULL"))
    got, want = as_set(streamed.drop("batch").select(batch.columns)), as_set(batch)
    assert set(got) == {"a", "b", "c", "d", "null", None}
    models = batch.columns.index("attempted_models")
    assert all(got[k][:models] + got[k][models + 1:] == want[k][:models] + want[k][models + 1:] for k in got)
    assert streamed.select("turn_id", "batch").where("turn_id = 'a'").first().batch < streamed.where("turn_id = 'd'").first().batch


def test_a_call_serves_all_turns_of_a_bucket():
    import pandas as pd

    class Held:
        def __init__(self):
            self.calls, self.value, self.timers = 0, None, []

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.calls, self.value = self.calls + 1, None

        def registerTimer(self, at):
            self.calls, self.timers = self.calls + 1, [*self.timers, at]

        def deleteTimer(self, at):
            self.calls, self.timers = self.calls + 1, [t for t in self.timers if t != at]

    class Now:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    held, turns = Held(), st.TurnProcessor(1_000)
    turns.init(held)
    rows = pd.DataFrame({"turn_id": [f"t{i}" for i in range(500)] * 2, "body": [json.dumps({"start": i * 1000, "end": i * 1000 + j, "done": 0, "places": {}}) for j in (0, 7) for i in range(500)]})
    assert not list(turns.handleInputRows((3,), iter([rows]), Now(0))) and held.calls <= 4 and held.timers == [1_001]
    closed = list(turns.handleExpiredTimer((3,), Now(1_101), None))
    assert len(closed) == 1 and closed[0]["turn_id"].tolist() == [f"t{i}" for i in range(100)] and held.calls <= 8 and held.timers == [1_101]
    assert json.loads(closed[0]["body"][9])["end"] == 9_007
    assert len(list(turns.handleExpiredTimer((3,), Now(10_000), None))[0]) == 400 and held.value is None and held.timers == []


def test_silent_turns_are_closed_by_the_timer(spark, tmp_path):
    rows = turn("silent", ("token", "x")) + [event("late", 0, 3_600_000, "token", "y"), event("later", 0, 7_200_000, "token", "z")]
    got = run(st.roll_up_stream(stream(spark, tmp_path, rows, schemas.TURN_EVENTS), delay="0 seconds"), "silent-test")
    assert {r.turn_id for r in got.collect()} >= {"silent"}


def test_orders_expire_and_late_payments_settle(spark, tmp_path):
    schema = "order_id string, seq long, ts timestamp, event string, amount long, quantity long, user_id long, rejected string"

    def row(order, seq, minute, kind, amount=500, rejected=None):
        made = kind == "created"
        return (order, seq, T0 + timedelta(minutes=minute), kind, amount, 5 if made else None, 1 if made else None, rejected)

    rows = [row("a", 0, 0, "created"), row("b", 1, 0, "created"), row("a", 2, 1, "paid", 499), row("a", 3, 2, "paid"), row("a", 4, 3, "paid"), row("z", 5, 4, "paid"),
            row("c", 6, 150, "created"), row("c", 7, 151, "paid", 500, "bad signature"), row("c", 8, 152, "fail"), row("c", 9, 153, "paid"),
            row("b", 10, 400, "paid"), row("a", 11, 401, "cancelled"), row("a", 12, 402, "cancelled")]
    got = run(so.settle_stream(stream(spark, tmp_path, rows, schema), delay="0 seconds"), "orders-test")
    moves = {}
    for r in got.orderBy("batch", F.expr("array_position(array('pending', 'expired', 'paid', 'failed', 'cancelled'), status)")).collect():
        moves.setdefault(r.order_id, []).append(r.status)
    assert moves == {"a": ["pending", "paid", "cancelled"], "b": ["pending", "expired", "paid"], "c": ["pending", "failed"]}


ORDER = "order_id string, seq long, ts timestamp, event string, amount long, quantity long, user_id long, rejected string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_orders_in_any_order_of_arrival(spark, tmp_path, seed):
    made = {o: (o, 0, T0, "created", 500, 5, None if o == "d" else 1, None) for o in "abcdef"}
    plot = {"a": ("paid", "cancelled", "paid"), "b": ("cancelled", "fail", "paid"), "c": ("paid",), "d": ("paid", "cancelled"), "e": ("cancelled",), "f": ("cancelled", "paid", "cancelled", "fail")}
    moves = [(o, i + 1, T0 + timedelta(minutes=i + 1), kind, 500, None, None, None) for o, kinds in plot.items() for i, kind in enumerate(kinds)]
    moves.append(("c", 9, T0 + timedelta(minutes=1), "paid", 499, None, None, None))
    rows = random.Random(seed).sample([*made.values(), *moves], len(made) + len(moves))
    got = run(so.settle_stream(stream(spark, tmp_path, rows, ORDER), delay="2 hours"), f"orders-any-{seed}")
    by_rank = F.expr("array_position(array('pending', 'expired', 'paid', 'failed', 'cancelled'), status)")
    last = {r.order_id: (r.status, r.granted) for r in got.orderBy("batch", by_rank).collect()}
    orders = spark.createDataFrame([(o, r[6], r[5], T0) for o, r in made.items()], "order_id string, user_id long, quantity long, created_at timestamp")
    events = spark.createDataFrame([m for m in moves if m[4] == 500], ORDER)
    want = {r.order_id: (r.status, r.granted) for r in od.settle(orders, events, F.lit(T0)).collect()}
    assert last == want


def test_cancelled_after_a_payment_that_comes_late(spark, tmp_path):
    rows = [("o", 0, T0, "created", 500, 5, 1, None), ("o", 5, T0 + timedelta(minutes=5), "cancelled", 500, None, None, None), ("o", 3, T0 + timedelta(minutes=3), "paid", 500, None, None, None)]
    got = run(so.settle_stream(stream(spark, tmp_path, rows, ORDER), delay="1 hour"), "orders-late")
    assert [r.status for r in got.orderBy("batch").collect()][-1] == "cancelled"


def test_a_shorter_document_leaves_no_old_chunk(spark, tmp_path):
    schema, folder = "post_id long, text string", str(tmp_path / "posts")
    long_text = "\n\n".join(f"part {i} " + "word " * 700 for i in range(7))
    for part in ([(1, long_text), (2, "kept")], [(1, "short"), (1, "tiny")], [(3, "new")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    posts = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    path = work_folder(spark, "points")

    def to_points(batch):
        return sinks.payload(qna.chunk_documents(batch, "text"), ["post_id"])

    ingest.ingest(posts, path, work_folder(spark, "points-state"), to_points).awaitTermination()
    assert {(r.post_id, r.content) for r in sinks.current_documents(spark, path, "post_id").collect()} == {(1, "short"), (2, "kept"), (3, "new")}
    out = sinks.compacted(spark, path, work_folder(spark, "points-compact"), "post_id")
    assert sinks.current_documents(spark, out, "post_id").count() == 3


def test_upsert_prune_and_versions(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "point_id string, v long")
    new = spark.createDataFrame([("b", 2, 0), ("b", 3, 1), ("d", 2, 0)], "point_id string, v long, pos long")
    once = sinks.upsert(old, new, "point_id", [F.col("pos")])
    assert {tuple(r) for r in once.collect()} == {("a", 1), ("b", 3), ("c", 1), ("d", 2)}
    assert {tuple(r) for r in sinks.upsert(once, new, "point_id", [F.col("pos")]).collect()} == {tuple(r) for r in once.collect()}
    assert {r.point_id for r in sinks.pruned(once, new, "point_id").collect()} == {"b", "d"}
    assert {r.point_id for r in sinks.stale(once, new, "point_id").collect()} == {"a", "c"}
    path = work_folder(spark, "versions")
    sinks.append_version(old, path, 0)
    for _ in range(2):  # a repeated batch changes nothing
        sinks.append_version(new.drop("pos").where("v = 2"), path, 1)
    assert {tuple(r) for r in sinks.current(spark, path).collect()} == {("a", 1), ("b", 2), ("c", 1), ("d", 2)}


def test_load_recreates_or_adds(spark):
    path = work_folder(spark, "load")
    a = spark.createDataFrame([("a", 1), ("b", 1)], "point_id string, v long")
    b = spark.createDataFrame([("b", 2)], "point_id string, v long")
    for options, want in (({"recreate": True}, {("a", 1), ("b", 1)}), ({"recreate": False}, {("a", 1), ("b", 2)}), ({"recreate": False, "prune": True}, {("b", 2)}), ({"recreate": True}, {("b", 2)})):
        points = a if not want - {("a", 1), ("b", 1)} else b
        out = sinks.load(points, path, **options)
        assert {tuple(r) for r in spark.read.parquet(out).collect()} == want


def test_pairing_and_documents(spark, tmp_path):
    chunks = spark.createDataFrame([(1,), (2,)], "chunk_id long")
    vectors = spark.createDataFrame([(2, [1.0]), (3, [1.0, 2.0])], "chunk_id long, vector array<double>")
    report = readers.pairing_report(chunks, vectors, ["chunk_id"], "vector", 2)
    assert tuple(report.first()) == (2, 2, 1, 1, 1)
    with pytest.raises(ValueError):
        readers.assert_paired(report)
    (tmp_path / "d.md").write_text("한글 text")
    r = readers.read_documents(spark, str(tmp_path / "d.md")).first()
    assert r.text == "한글 text" and r.source_version[10] == "+" and r.sha256.startswith(r.source_version[11:])


def test_copy_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    copy = sinks.enrich_copy(a, spark.createDataFrame([(1, [1.0])], "id long, sparse array<double>"), "id")
    assert sinks.copy_differences(a, copy, ["id", "v"]).count() == 0 and copy.where("sparse is null").count() == 1
    assert ordered.first_per_key(a, ["v"], [F.col("id")]).count() == 2


def test_copy_differences_count_rows(spark):
    a = spark.createDataFrame([(1, "x", [0.0]), (1, "x", [0.0]), (2, None, None), (3, "", [float("nan")]), (4, "same", [1.0])], "id long, v string, w array<double>")
    b = spark.createDataFrame([(1, "x", [-0.0]), (2, "", None), (3, None, [float("nan")]), (4, "same", [1.0]), (5, "new", [])], "id long, v string, w array<double>")
    got = sorted(str(tuple(r)) for r in sinks.copy_differences(a, b, ["id", "v", "w"]).collect())
    want = a.exceptAll(b).unionByName(b.exceptAll(a))
    assert got == sorted(str(tuple(r)) for r in want.collect()) and len(got) == 6
    assert sinks.copy_differences(a, a.repartition(3), ["id", "v", "w"]).count() == 0


def test_texts_are_no_keys_of_a_comparison(spark, monkeypatch):
    """Sides of long texts are held by digests, so what a task holds does not grow with the texts."""
    a = spark.range(50).select("id", F.repeat(F.lit("long text "), 200).alias("v"))
    seen = []
    monkeypatch.setattr(sinks, "written", lambda df, name: seen.append(df.schema) or df)
    assert sinks.copy_differences(a, a, ["id", "v"]).count() == 0
    assert [f.dataType.simpleString() for f in seen[0]] == ["bigint", "binary"]


def test_closed_days_count_every_asker_once(spark):
    """Days come once the watermark has passed them, however a user's rows are spread over arrivals."""
    import random

    from loreloom.streaming import activity

    r = random.Random(3)
    rows = [(f"2024-01-{d:02d} {r.randrange(24):02d}:{r.randrange(60):02d}:00", r.choice([None, *range(6)])) for d in range(1, 8) for _ in range(40)]
    rows.sort(key=str)
    folder = work_folder(spark, "asked")
    events = spark.createDataFrame(rows, "t string, user_id long").select(F.col("t").cast("timestamp").alias("ts"), "user_id")
    events.limit(0).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    third = len(rows) // 3

    def arrive():
        for part in (rows[:third], rows[third:2 * third], rows[2 * third:]):
            spark.createDataFrame(part, "t string, user_id long").select(F.col("t").cast("timestamp").alias("ts"), "user_id").repartition(3).write.mode("append").parquet(folder)
            yield

    got = {str(x.date): (x.questions, x.askers) for x in run(activity.closed_days(stream, user="user_id"), "closed", arrivals=arrive()).collect()}
    local = events.withColumn("day", F.to_date(F.col("ts") + F.expr("interval 9 hours")))
    want = {str(x.day): (x.n, x.a) for x in local.groupBy("day").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("user_id", F.lit(-1))).alias("a")).collect()}
    assert 6 <= len(got) <= len(want) and all(want[d] == v for d, v in got.items())


def test_rows_without_an_order_arrive_first(spark, tmp_path):
    from loreloom.plans.streams import Arrivals

    spark.createDataFrame([(None, 1), (3, 2), (None, 3), (9, 4), (5, 5)], "ts long, v int").write.parquet(str(tmp_path / "t.parquet"))
    arrivals = Arrivals(spark, str(tmp_path), "t")
    seen = [sorted(r.v for r in spark.read.schema("ts long, v int").parquet(arrivals.folder).collect()) for _ in arrivals]
    assert {1, 3} <= set(seen[0]) and seen[-1] == [1, 2, 3, 4, 5]
