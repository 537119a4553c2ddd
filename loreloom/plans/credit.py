"""The credit ledger and the orders on the given events, customers, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreloom.operators import ledger as lg, ordered, orders as od
from loreloom.plans import tables as tb
from loreloom.plans.registry import query, table

SECRET = "test-secret"


def entries(spark, d):
    """Ledger entries in event order; refills are grants, every 20th kind of amount sets the balance."""
    kind = F.when(F.col("type") == "monthly_refill", F.when(F.abs("amount") >= 100, "set").otherwise("floor")).otherwise(F.col("type"))
    return tb.ledger_rows(spark, d).select("user_id", F.col("id").alias("position"), kind.alias("type"), F.abs("amount").alias("amount"))


def opening(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("credits")).withColumn("paid_credits", F.lit(0).cast("bigint"))


# One step per entry, as a recursive query over the entries of every user side by side.
FOLD = tb.with_views(tb.LEDGER).replace("WITH ", "WITH RECURSIVE ", 1) + """
, e AS (SELECT user_id, id AS position, abs(amount) AS amount, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n, count(*) OVER (PARTITION BY user_id) AS total,
  CASE WHEN type = 'monthly_refill' THEN CASE WHEN abs(amount) >= 100 THEN 'set' ELSE 'floor' END ELSE type END AS type FROM ledger),
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, count(*) AS credits, CAST(0 AS BIGINT) AS paid, CAST(NULL AS BIGINT) AS position, CAST(0 AS BIGINT) AS change, CAST(false AS BOOLEAN) AS accepted FROM ledger GROUP BY user_id
  UNION ALL
  SELECT user_id, n, c, p, position, c - before AS change, CASE type WHEN 'usage' THEN before >= amount WHEN 'refund' THEN true WHEN 'purchase' THEN true ELSE c <> before END AS accepted FROM (
    SELECT e.user_id, e.n, e.position, e.type, e.amount, f.credits AS before,
      CASE e.type WHEN 'usage' THEN CASE WHEN f.credits >= e.amount THEN f.credits - e.amount ELSE f.credits END WHEN 'refund' THEN f.credits + e.amount WHEN 'purchase' THEN f.credits + e.amount
        WHEN 'cancel' THEN f.credits - least(e.amount, f.paid) WHEN 'set' THEN e.amount ELSE f.credits + greatest(0, e.amount - (f.credits - f.paid)) END AS c,
      CASE e.type WHEN 'usage' THEN CASE WHEN f.credits >= e.amount THEN least(f.paid, f.credits - e.amount) ELSE f.paid END WHEN 'purchase' THEN f.paid + e.amount
        WHEN 'cancel' THEN f.paid - least(e.amount, f.paid) WHEN 'set' THEN least(f.paid, e.amount) ELSE f.paid END AS p
    FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
"""


@query("LED-1 LED-2 LED-3 LED-4 LED-5 LED-6", FOLD + "SELECT user_id, position, change, accepted, credits, paid AS paid_credits FROM f WHERE n > 0")
def balance_fold(spark, d):
    return lg.fold_balances(entries(spark, d), opening(spark, d)).select("user_id", "position", "change", "accepted", "credits", "paid_credits")


@query("LED-1", FOLD + "SELECT user_id, arg_max(credits, n) AS credits, arg_max(paid, n) AS paid_credits FROM f GROUP BY user_id")
def balance_fold_in_blocks(spark, d):
    """The same with every user cut into many blocks."""
    return lg.final_balances(entries(spark, d), opening(spark, d), block=40)


@query("LED-6", tb.with_views(tb.USERS) + "SELECT id, CASE WHEN deleted_at IS NULL THEN 700 ELSE credits END AS credits, CASE WHEN deleted_at IS NULL THEN least(paid_credits, 700) ELSE paid_credits END AS paid_credits FROM users")
def bulk_set_credits(spark, d):
    return lg.set_credits(tb.users(spark, d), F.lit(700).cast("bigint"), bulk=True)[0].select("id", "credits", "paid_credits")


@query("LED-6", tb.with_views(tb.USERS) + "SELECT id AS user_id, 700 - credits AS amount, 'admin' AS type FROM users WHERE deleted_at IS NULL AND credits <> 700")
def bulk_set_rows(spark, d):
    return lg.set_credits(tb.users(spark, d), F.lit(700).cast("bigint"), bulk=True)[1]


FLOOR = tb.with_views(tb.USERS) + "SELECT {what} FROM (SELECT *, CASE WHEN deleted_at IS NULL THEN greatest(0, 2000 - (credits - paid_credits)) ELSE 0 END AS lift FROM users) "


@query("LED-7", FLOOR.format(what="id, CAST(credits + lift AS BIGINT) AS credits, paid_credits"))
def refilled_balances(spark, d):
    return lg.refill_to_floor(tb.users(spark, d), 2000, "admin_refill", F.lit("refill"))[0].select("id", "credits", "paid_credits")


@query("LED-7", FLOOR.format(what="CAST(count(*) FILTER (lift > 0) AS BIGINT) AS affected_users, CAST(sum(lift) AS BIGINT) AS total_credits"))
def refill_totals(spark, d):
    return lg.refill_to_floor(tb.users(spark, d), 2000, "admin_refill", F.lit("refill"))[2]


@query("LED-8", FLOOR.format(what="'2024-02' AS period, 'applied' AS reason, CAST(2000 AS BIGINT) AS target_credits, CAST(count(*) FILTER (lift > 0) AS BIGINT) AS affected_users, CAST(sum(lift) AS BIGINT) AS total_credits")
       + " UNION ALL SELECT '2024-01', 'not_due', 2000, 0, 0 UNION ALL SELECT '2024-01', 'already_applied', 2000, 0, 0")
def monthly_refills(spark, d):
    """Due on the first local day, not on another one, and never twice."""
    users, events = tb.users(spark, d), table(spark, d, "events")
    runs = events.select(F.date_format("ts", "yyyy-MM").alias("period")).distinct()
    reports = [lg.monthly_refill(users, runs, tb.as_of(t), 2000)[2] for t in ("2024-01-31 15:30:00", "2024-01-15 00:00:00", "2023-12-31 15:00:00")]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


@query("LED-9", """
SELECT l_orderkey, l_linenumber, quantity, CASE WHEN quantity BETWEEN low AND greatest(low, 30) THEN NULL ELSE 'quantity must be ' || CAST(low AS VARCHAR) || '~' || CAST(greatest(low, 30) AS VARCHAR) END AS rejected,
  CASE WHEN quantity BETWEEN low AND greatest(low, 30) THEN quantity * price END AS amount FROM (
  SELECT *, greatest(1, CAST(ceil(1000 / price) AS BIGINT)) AS low FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, 50 + CAST(round(l_tax * 100) AS BIGINT) * 50 AS price FROM lineitem))""")
def priced_orders(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("l_quantity").cast("bigint").alias("quantity"),
                                           (50 + F.round(F.col("l_tax") * 100).cast("bigint") * 50).alias("unit_price"))
    return od.price_orders(r, max_quantity=30).drop("unit_price")


@query("LED-10", f"""
SELECT o_orderkey, sha256('tid' || CAST(o_orderkey AS VARCHAR) || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || strftime(o_orderdate, '%Y%m%d') || '{SECRET}') AS signature, o_orderstatus <> 'P' AS valid FROM orders""")
def signed_orders(spark, d):
    o = table(spark, d, "orders")
    parts = [F.concat(F.lit("tid"), F.col("o_orderkey")), F.floor("o_totalprice").cast("bigint"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(SECRET)]
    good = od.signature(*parts)
    received = F.when(F.col("o_orderstatus") == "P", F.reverse(good)).otherwise(good)
    return o.select("o_orderkey", good.alias("signature"), od.signature_matches(good, received).alias("valid"))


# Every user of the event table has one order; purchase = paid, error = fail, click = cancelled, signup = paid
# with another amount, view = a paid event that is signed wrong.
ORDERS = """
orders_of AS (SELECT CAST(user_id AS VARCHAR) AS order_id, CASE WHEN user_id % 10 <> 3 THEN user_id END AS user_id, 5 + user_id % 7 AS quantity, 100 * (5 + user_id % 7) AS amount, min(ts) AS created_at FROM events GROUP BY user_id),
order_events AS (SELECT CASE WHEN json_extract_string(props, '$.k') = '7' THEN 'lost' ELSE CAST(user_id AS VARCHAR) END AS order_id, event_id AS seq, ts,
    CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'cancelled' ELSE 'paid' END AS event,
    CASE WHEN event_type = 'signup' THEN 'x' || json_extract_string(props, '$.k') WHEN json_extract_string(props, '$.k') < '3' AND event_type = 'purchase' THEN '1' ELSE CAST(100 * (5 + user_id % 7) AS VARCHAR) END AS amount,
    event_type = 'view' AS forged FROM events),
checked AS (SELECT e.*, CASE WHEN o.order_id IS NULL THEN 'unknown order' WHEN forged THEN 'bad signature' WHEN TRY_CAST(e.amount AS BIGINT) IS NULL THEN 'unreadable amount'
    WHEN e.event = 'paid' AND CAST(e.amount AS BIGINT) <> o.amount THEN 'amount mismatch' END AS rejected FROM order_events e LEFT JOIN orders_of o USING (order_id))
"""


def orders_of(spark, d):
    u = F.col("user_id")
    quantity = (5 + u % 7).cast("bigint")
    grouped = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
    return grouped.select(u.cast("string").alias("order_id"), F.when(u % 10 != 3, u).alias("user_id"), quantity.alias("quantity"),
                          (quantity * 100).alias("amount"), "created_at")


def order_events(spark, d):
    return order_events_of(table(spark, d, "events"))


def order_events_of(e):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    order_id = F.when(k == "7", "lost").otherwise(F.col("user_id").cast("string"))
    right = (100 * (5 + F.col("user_id") % 7)).cast("string")
    amount = F.when(kind == "signup", F.concat(F.lit("x"), k)).when((k < "3") & (kind == "purchase"), "1").otherwise(right)
    tid, day = F.concat(F.lit("t"), F.col("event_id")), F.date_format("ts", "yyyyMMdd")
    sign = od.signature(tid, amount, day, F.lit(SECRET))
    return e.select(order_id.alias("order_id"), F.col("event_id").alias("seq"), "ts",
                    F.when(kind == "error", "fail").when(kind == "click", "cancelled").otherwise("paid").alias("event"),
                    amount.alias("amount"), tid.alias("tid"), day.alias("edi_date"),
                    F.when(kind == "view", F.reverse(sign)).when(kind == "purchase", sign).alias("signature"))


@query("LED-12 LED-10", "WITH " + ORDERS + "SELECT order_id, seq, event, rejected FROM checked")
def checked_events(spark, d):
    return od.check_events(order_events(spark, d), orders_of(spark, d), SECRET).select("order_id", "seq", "event", "rejected")


SETTLED = """, decided AS (SELECT order_id, min(seq) AS seq, arg_min(event, seq) AS event FROM checked WHERE rejected IS NULL AND event IN ('paid', 'fail') GROUP BY order_id),
undone AS (SELECT c.order_id, min(c.seq) AS seq FROM checked c JOIN decided d ON d.order_id = c.order_id AND d.event = 'paid' AND c.seq > d.seq WHERE c.event = 'cancelled' AND c.rejected IS NULL GROUP BY c.order_id),
settled AS (SELECT o.order_id, o.user_id, o.quantity, CASE WHEN u.seq IS NOT NULL THEN 'cancelled' WHEN d.event = 'paid' THEN 'paid' WHEN d.event = 'fail' THEN 'failed' WHEN o.created_at < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 60 MINUTE THEN 'expired' ELSE 'pending' END AS status,
  CASE WHEN d.event = 'paid' THEN CASE WHEN o.user_id IS NULL THEN 0 ELSE o.quantity END END AS granted, d.seq AS decided_seq, u.seq AS cancelled_seq FROM orders_of o LEFT JOIN decided d USING (order_id) LEFT JOIN undone u USING (order_id))
"""


def settled(spark, d):
    o = orders_of(spark, d)
    return od.settle(o, od.check_events(order_events(spark, d), o, SECRET), tb.as_of())


@query("LED-11", "WITH " + ORDERS + SETTLED + "SELECT order_id, status, CAST(granted AS BIGINT) AS granted, decided_seq, cancelled_seq FROM settled")
def settled_orders(spark, d):
    return settled(spark, d).select("order_id", "status", "granted", "decided_seq", "cancelled_seq")


@query("LED-11 LED-4 LED-5", "WITH " + ORDERS + SETTLED + """
SELECT user_id, CAST(sum(CASE WHEN cancelled_seq IS NULL THEN granted ELSE 0 END) AS BIGINT) AS credits FROM settled WHERE granted > 0 GROUP BY user_id""")
def order_balances(spark, d):
    none = spark.createDataFrame([], "user_id bigint, credits bigint, paid_credits bigint")
    return lg.final_balances(od.ledger_entries(settled(spark, d)), none).select("user_id", "credits")


@query("LED-13", tb.with_views(tb.PAYMENTS) + "SELECT id, CASE WHEN status = 'pending' AND created_at < TIMESTAMP '2001-01-01 00:00:00' - INTERVAL 60 MINUTE THEN 'expired' ELSE status END AS status FROM payments")
def expired_orders(spark, d):
    return od.expire_stale(tb.payments(spark, d), tb.as_of("2001-01-01 00:00:00"))[0].select("id", "status")


@query("LED-13", tb.with_views(tb.PAYMENTS) + "SELECT CAST(count(*) AS BIGINT) AS expired FROM payments WHERE status = 'pending' AND created_at < TIMESTAMP '2001-01-01 00:00:00' - INTERVAL 60 MINUTE")
def expired_count(spark, d):
    return od.expire_stale(tb.payments(spark, d), tb.as_of("2001-01-01 00:00:00"))[1]


PURGE = tb.with_views(tb.USERS, tb.SESSIONS, tb.PAYMENTS, """
young AS (SELECT DISTINCT user_id FROM payments WHERE status = 'pending' AND created_at >= TIMESTAMP '2001-06-01 00:00:00' - INTERVAL 15 MINUTE),
turns_of AS (SELECT id AS session_id, CASE WHEN title = '1-URGENT' THEN 'pending' ELSE 'success' END AS status, created_at FROM sessions),
busy AS (SELECT DISTINCT s.user_id FROM turns_of t JOIN sessions s ON s.id = t.session_id WHERE t.status = 'pending' AND t.created_at >= TIMESTAMP '2001-06-01 00:00:00' - INTERVAL 15 MINUTE),
asked AS (SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') UNION SELECT -1),
outcome AS (SELECT user_id, CASE WHEN user_id NOT IN (SELECT id FROM users) THEN 'not_found' WHEN user_id IN (SELECT user_id FROM busy) THEN 'pending' WHEN user_id IN (SELECT user_id FROM young) THEN 'payment_pending' ELSE 'deleted' END AS outcome FROM asked)
""")


def purged(spark, d):
    sessions = tb.sessions(spark, d)
    turns = sessions.select(F.col("id").alias("session_id"), F.when(F.col("title") == "1-URGENT", "pending").otherwise("success").alias("status"), "created_at")
    asked = table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "FURNITURE")).select(F.col("c_custkey").alias("user_id"))
    asked = asked.unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("user_id")))
    tables = {"sessions": sessions, "messages": tb.messages(spark, d), "turns": turns, "ledger": tb.ledger_rows(spark, d), "payments": tb.payments(spark, d)}
    return lg.purge_accounts(asked, tb.users(spark, d), tables, tb.as_of("2001-06-01 00:00:00"))


@query("LED-14", PURGE + "SELECT user_id, outcome FROM outcome")
def purge_outcomes(spark, d):
    return purged(spark, d)["outcome"]


@query("LED-14", PURGE + """SELECT name, CAST(remaining AS BIGINT) AS remaining FROM (SELECT 'sessions' AS name, count(*) AS remaining FROM sessions WHERE user_id NOT IN (SELECT user_id FROM outcome WHERE outcome = 'deleted')
UNION ALL SELECT 'messages', count(*) FROM lineitem JOIN sessions s ON s.id = l_orderkey WHERE s.user_id NOT IN (SELECT user_id FROM outcome WHERE outcome = 'deleted')
UNION ALL SELECT 'payments', count(*) FROM payments
UNION ALL SELECT 'ledger', count(*) FROM events WHERE user_id NOT IN (SELECT user_id FROM outcome WHERE outcome = 'deleted')
UNION ALL SELECT 'users', sum(CASE WHEN id IN (SELECT user_id FROM outcome WHERE outcome = 'deleted') THEN 0 ELSE credits END) FROM users)""")
def purge_remainders(spark, d):
    p = purged(spark, d)
    counts = [p[n].agg(F.count("*").alias("remaining")).select(F.lit(n).alias("name"), "remaining") for n in ("sessions", "messages", "payments", "ledger")]
    counts.append(p["users"].agg(F.sum("credits").alias("remaining")).select(F.lit("users").alias("name"), "remaining"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("LED-15", tb.with_views(tb.USERS) + """
SELECT email, CASE WHEN p.pid IS NOT NULL THEN 'renamed' ELSE u.name END AS name, credits, deleted_at IS NOT NULL AND p.pid IS NULL AS retired FROM users u LEFT JOIN (SELECT DISTINCT 'g' || CAST(o_custkey AS VARCHAR) AS pid FROM orders WHERE o_orderstatus = 'F') p ON p.pid = 'g' || CAST(u.id AS VARCHAR)
UNION ALL SELECT 'g' || s_name || '@example.com', 'renamed', 10, false FROM supplier WHERE s_acctbal > 0""")
def signed_up_users(spark, d):
    users = tb.users(spark, d).withColumns({"google_id": F.concat(F.lit("g"), F.col("id")), "picture": F.lit(None).cast("string"), "updated_at": F.col("created_at")})
    back = table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.concat(F.lit("g"), F.col("o_custkey")).alias("google_id")).distinct()
    back = back.join(users.select("google_id", "email"), "google_id").withColumn("privacy_consent_version", F.lit(None).cast("string"))
    new = table(spark, d, "supplier").select(F.concat(F.lit("g"), F.col("s_name")).alias("google_id"), F.concat(F.lit("g"), F.col("s_name"), F.lit("@example.com")).alias("email"),
                                             F.when(F.col("s_acctbal") > 0, "v1").alias("privacy_consent_version"))
    profiles = back.unionByName(new).withColumn("name", F.lit("renamed")).withColumn("picture", F.lit("p"))
    after, _ = lg.sign_ups(users, profiles, tb.as_of(), 10)
    return after.select("email", "name", "credits", F.col("deleted_at").isNotNull().alias("retired"))
