import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loreloom.functions.steps import apply_entry
from loreloom.operators import ledger as lg, orders as od, usage as us


def ts(text):
    return F.lit(text).cast("timestamp")


@pytest.mark.parametrize("block", [5, 10_000])
def test_fold_equals_a_loop_for_hot_and_cold_users(spark, block):
    rng = random.Random(block)
    kinds = ["usage", "usage", "usage", "refund", "purchase", "cancel", "floor", "set", "grant"]
    entries = [(u, i, rng.choice(kinds), rng.randrange(0, 30)) for u, n in ((1, 120), (2, 6), (3, 40)) for i in range(n)]
    opening = {1: (20, 5), 2: (3, 0)}
    want, state = {}, {**{u: (0, 0) for u in (1, 2, 3)}, **opening}
    for u, i, kind, amount in sorted(entries):
        c, p, change, ok = apply_entry(*state[u], kind, amount)
        assert 0 <= p <= c
        state[u] = (c, p)
        want[u, i] = (change, ok, c, p)
    df = spark.createDataFrame(random.Random(1).sample(entries, len(entries)), "user_id long, position long, type string, amount long").repartition(4)
    balances = spark.createDataFrame([(u, c, p) for u, (c, p) in opening.items()] + [(9, 7, 7)], "user_id long, credits long, paid_credits long")
    got = {(r.user_id, r.position): (r.change, r.accepted, r.credits, r.paid_credits) for r in lg.fold_balances(df, balances, block=block).collect()}
    assert got == want
    ends = {r.user_id: (r.credits, r.paid_credits) for r in lg.final_balances(df, balances, block=block).collect()}
    assert ends == {**state, 9: (7, 7)}


def test_free_before_paid_and_bounded_reclaim():
    assert apply_entry(10, 4, "usage", 7) == (3, 3, -7, True)
    assert apply_entry(10, 4, "usage", 11) == (10, 4, 0, False)
    assert apply_entry(3, 3, "refund", 2) == (5, 3, 2, True)
    assert apply_entry(5, 3, "cancel", 10) == (2, 0, -3, True)
    assert apply_entry(10, 4, "set", 2) == (2, 2, -8, True)
    assert apply_entry(25, 22, "floor", 20) == (42, 22, 17, True)


def users(spark):
    rows = [(1, "g1", 3, 0, None), (2, "g2", 20, 0, None), (3, "g3", 27, 0, None), (4, "g4", 0, 0, datetime(2025, 1, 1)), (5, "g5", 30, 25, None)]
    df = spark.createDataFrame(rows, "id long, google_id string, credits long, paid_credits long, deleted_at timestamp")
    return df.withColumns({"email": F.concat("google_id", F.lit("@x")), "name": F.lit("n"), "picture": F.lit(None).cast("string"), "created_at": ts("2025-01-01"),
                           "updated_at": ts("2025-01-01"), "privacy_consent_version": F.lit("v0")})


def test_refill_touches_live_free_balances_only(spark):
    after, rows, total = lg.refill_to_floor(users(spark), 20, "admin_refill", F.lit("m"))
    assert {r.id: r.credits for r in after.collect()} == {1: 20, 2: 20, 3: 27, 4: 0, 5: 45}
    assert sorted((r.user_id, r.amount) for r in rows.collect()) == [(1, 17), (5, 15)] and tuple(total.first()) == (2, 32)


def test_monthly_refill_runs_once_on_the_local_first(spark):
    none = spark.createDataFrame([], "period string")
    due = lg.monthly_refill(users(spark), none, ts("2026-08-31 15:00:00"), 20)
    assert tuple(due[2].first()) == ("2026-09", "applied", 20, 2, 32)
    assert {r.id: r.credits for r in due[0].collect()}[1] == 20 and due[1].first().memo == "월 기본 이용권 충전 (2026-09)"
    again = lg.monthly_refill(due[0], due[2].select("period"), ts("2026-09-01 03:00:00"), 20)
    assert again[2].first().reason == "already_applied" and again[1].count() == 0
    late = lg.monthly_refill(users(spark), none, ts("2026-09-01 15:00:00"), 20)
    assert late[2].first().reason == "not_due" and {r.id: r.credits for r in late[0].collect()}[1] == 3


def test_sign_up(spark):
    profiles = spark.createDataFrame([("g4", "new@x", "back", "p", None), ("g9", "nine@x", "nine", "p", "v1"), ("g8", "e@x", "no consent", "p", "")],
                                     "google_id string, email string, name string, picture string, privacy_consent_version string")
    after, refused = lg.sign_ups(users(spark), profiles, ts("2026-01-01"), 10)
    got = {r.google_id: r for r in after.collect()}
    assert (got["g4"].email, got["g4"].credits, got["g4"].deleted_at) == ("new@x", 0, None)
    assert (got["g9"].credits, got["g9"].paid_credits) == (10, 0) and got["g1"].name == "n" and "g8" not in got
    assert [r.google_id for r in refused.collect()] == ["g8"]


def test_purge(spark):
    sessions = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id long, user_id long")
    turns = spark.createDataFrame([(10, "success", "2026-01-01 00:00:00"), (20, "pending", "2026-01-01 11:50:00"), (30, "pending", "2026-01-01 09:00:00")], "session_id long, status string, t string")
    payments = spark.createDataFrame([(1, "pending", "2026-01-01 01:00:00"), (5, "pending", "2026-01-01 11:59:00")], "user_id long, status string, t string")
    tables = {"sessions": sessions, "messages": sessions.select(F.col("id").alias("session_id")), "turns": turns.withColumn("created_at", F.col("t").cast("timestamp")),
              "payments": payments.withColumn("created_at", F.col("t").cast("timestamp")), "ledger": sessions.select("user_id")}
    asked = spark.createDataFrame([(1,), (2,), (3,), (5,), (99,)], "user_id long")
    p = lg.purge_accounts(asked, users(spark), tables, ts("2026-01-01 12:00:00"))
    assert {r.user_id: r.outcome for r in p["outcome"].collect()} == {1: "deleted", 2: "pending", 3: "deleted", 5: "payment_pending", 99: "not_found"}
    assert {r.id: r.credits for r in p["users"].collect()} == {1: 0, 2: 20, 3: 0, 4: 0, 5: 30}
    assert [p[t].count() for t in ("sessions", "messages", "turns", "ledger", "payments")] == [1, 1, 1, 1, 2]


def test_order_events_and_states(spark):
    orders = spark.createDataFrame([("a", 1, 5, 500, "2026-01-01 00:00:00"), ("b", 2, 5, 500, "2026-01-01 00:00:00"), ("c", None, 5, 500, "2026-01-01 00:00:00"),
                                    ("d", 4, 5, 500, "2026-01-01 11:30:00"), ("e", 5, 5, 500, "2026-01-01 00:00:00")], "order_id string, user_id long, quantity long, amount long, t string")
    orders = orders.withColumn("created_at", F.col("t").cast("timestamp")).drop("t")
    good = od.signature(F.col("tid"), F.col("amount"), F.col("edi_date"), F.lit("s"))
    rows = [("a", 1, "paid", "499", "ok"), ("a", 2, "paid", "500", "bad"), ("a", 3, "paid", "x", "none"), ("a", 4, "cancelled", "500", "none"), ("a", 5, "paid", "500", "ok"), ("a", 6, "paid", "500", "ok"),
            ("a", 7, "fail", "500", "none"), ("a", 8, "cancelled", "500", "none"), ("a", 9, "cancelled", "500", "none"), ("b", 1, "fail", "500", "none"), ("b", 2, "paid", "500", "ok"),
            ("c", 1, "paid", "500", "ok"), ("zz", 1, "paid", "500", "ok")]
    e = spark.createDataFrame(rows, "order_id string, seq long, event string, amount string, sign string").withColumns({"tid": F.lit("t"), "edi_date": F.lit("d"), "ts": ts("2026-01-01 01:00:00")})
    e = e.withColumn("signature", F.when(F.col("sign") == "ok", good).when(F.col("sign") == "bad", F.lit("ff")))
    checked = od.check_events(e, orders, "s")
    assert {(r.order_id, r.seq): r.rejected for r in checked.where("rejected is not null").collect()} == {
        ("a", 1): "amount mismatch", ("a", 2): "bad signature", ("a", 3): "unreadable amount", ("zz", 1): "unknown order"}
    got = {r.order_id: (r.status, r.granted, r.decided_seq, r.cancelled_seq) for r in od.settle(orders, checked, ts("2026-01-01 12:00:00")).collect()}
    assert got == {"a": ("cancelled", 5, 5, 8), "b": ("failed", None, 1, None), "c": ("paid", 0, 1, None), "d": ("pending", None, None, None), "e": ("expired", None, None, None)}


def test_pricing(spark):
    r = spark.createDataFrame([(9, 100), (10, 100), (1001, 100), (1, 0), (1000, 0), (None, 100)], "quantity long, unit_price long")
    got = [(x.amount, x.rejected is None) for x in od.price_orders(r).collect()]
    assert got == [(None, False), (1000, True), (None, False), (None, False), (None, False), (None, False)]


def test_periods(spark):
    df = users(spark)
    with pytest.raises(ValueError):
        us.in_period(df, 8, ts("2026-01-01"))
    assert us.in_period(df, None, ts("2030-01-01")).count() == 5 and us.in_period(df, 7, ts("2025-01-08")).count() == 5
    assert us.in_period(df, 7, ts("2025-01-09")).count() == 0
    with pytest.raises(ValueError):
        us.search_users(df, sort="age")


def test_rates(values):
    got = values(lambda c: us.rate(F.split(c, "/")[0].cast("long"), F.split(c, "/")[1].cast("long")), ["1/3", "0/0", "2/2", "1/8"])
    assert got == [33.3, None, 100.0, 12.5]


def test_memos(values):
    assert values(lambda c: us.public_memo(F.lit("refund"), c), ["오류 환불 (model)", "요청 저장 실패 환불 (x)", "환불"]) == ["오류 환불", "요청 저장 실패 환불", "환불"]
    assert values(lambda c: us.public_memo(F.lit("usage"), c), ["model x"]) == ["질문"]
