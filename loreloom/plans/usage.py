"""Usage reports on the derived users, sessions, messages, ledger rows, turns and payments."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreloom.operators import usage as us
from loreloom.plans import tables as tb
from loreloom.plans.registry import query

SHIPPED = "TIMESTAMP '2001-11-04 00:00:00'"


def _shipped():
    return tb.as_of(tb.AS_OF_SHIPPED)


def _text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("ANA-1", tb.with_views(tb.USERS, tb.SESSIONS, tb.MESSAGES) + """
SELECT u.id, u.email, u.credits, CAST(coalesce(sum(m.input_tokens), 0) AS BIGINT) AS total_input_tokens, CAST(coalesce(sum(m.output_tokens), 0) AS BIGINT) AS total_output_tokens,
  CAST(coalesce(sum(m.thinking_tokens), 0) AS BIGINT) AS total_thinking_tokens, strftime(max(m.created_at), '%Y-%m-%d %H:%M:%S') AS last_active_at
FROM users u LEFT JOIN sessions s ON s.user_id = u.id LEFT JOIN messages m ON m.session_id = s.id AND m.role = 'assistant' WHERE u.deleted_at IS NULL GROUP BY u.id, u.email, u.credits""")
def user_list(spark, d):
    return us.user_list(tb.users(spark, d), tb.sessions(spark, d), tb.messages(spark, d)).select(
        "id", "email", "credits", *[f"total_{t}" for t in us.TOKENS], _text("last_active_at"))


BY_MODEL = """
SELECT s.user_id, m.model, CAST(sum(m.input_tokens) AS BIGINT) AS input_tokens, CAST(coalesce(sum(m.output_tokens), 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(m.thinking_tokens), 0) AS BIGINT) AS thinking_tokens, count(*) AS message_count
FROM sessions s JOIN messages m ON m.session_id = s.id AND m.role = 'assistant' WHERE m.input_tokens IS NOT NULL {where} GROUP BY s.user_id, m.model"""


@query("ANA-2", tb.with_views(tb.SESSIONS, tb.MESSAGES) + BY_MODEL.format(where=""))
def usage_by_user_and_model(spark, d):
    return us.usage_by_user_and_model(tb.sessions(spark, d), tb.messages(spark, d))


@query("ANA-2", tb.with_views(tb.SESSIONS, tb.MESSAGES) + "SELECT user_id, CAST(count(*) AS BIGINT) AS models, CAST(sum(message_count) AS BIGINT) AS messages FROM (" + BY_MODEL.format(where="") + ") GROUP BY user_id")
def nested_usage(spark, d):
    n = us.nested_usage(us.usage_by_user_and_model(tb.sessions(spark, d), tb.messages(spark, d)))
    return n.select("user_id", F.size("models").cast("bigint").alias("models"),
                    F.aggregate("models", F.lit(0).cast("bigint"), lambda a, m: a + m["message_count"]).alias("messages"))


@query("ANA-3", tb.with_views(tb.SESSIONS, tb.MESSAGES) + "SELECT * EXCLUDE (user_id) FROM (" + BY_MODEL.format(where="AND s.user_id = (SELECT max(o_custkey) FROM orders)") + ")")
def heaviest_user_by_model(spark, d):
    sessions = tb.sessions(spark, d)
    return us.user_usage_by_model(sessions, tb.messages(spark, d), sessions.agg(F.max("user_id")).scalar())


@query("ANA-4", tb.with_views(tb.USERS, tb.SESSIONS, tb.MESSAGES, tb.LEDGER) + """
SELECT u.id, coalesce(c.n, 0) AS conversation_count, CAST(coalesce(m.q, 0) AS BIGINT) AS question_count, CAST(coalesce(l.used, 0) AS BIGINT) AS credits_used, CAST(coalesce(l.refunded, 0) AS BIGINT) AS credits_refunded,
  CAST(coalesce(m.i, 0) AS BIGINT) AS input_tokens, CAST(coalesce(m.o, 0) AS BIGINT) AS output_tokens, CAST(coalesce(m.t, 0) AS BIGINT) AS thinking_tokens
FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM sessions GROUP BY user_id) c ON c.user_id = u.id
LEFT JOIN (SELECT s.user_id, count(*) FILTER (m.role = 'user') AS q, sum(m.input_tokens) FILTER (m.role = 'assistant') AS i, sum(m.output_tokens) FILTER (m.role = 'assistant') AS o, sum(m.thinking_tokens) FILTER (m.role = 'assistant') AS t
           FROM sessions s JOIN messages m ON m.session_id = s.id GROUP BY s.user_id) m ON m.user_id = u.id
LEFT JOIN (SELECT user_id, sum(abs(amount)) FILTER (type = 'usage') AS used, sum(amount) FILTER (type = 'refund' AND amount > 0) AS refunded FROM ledger GROUP BY user_id) l ON l.user_id = u.id""")
def lifetime_stats(spark, d):
    return us.lifetime_stats(tb.users(spark, d), tb.sessions(spark, d), tb.messages(spark, d), tb.ledger_rows(spark, d))


@query("ANA-5", tb.with_views(tb.USERS) + "SELECT count(*) AS total_users, CAST(sum(credits) AS BIGINT) AS current_credits, CAST(count(*) FILTER (credits <= 500) AS BIGINT) AS low_credit_users FROM users WHERE deleted_at IS NULL")
def user_totals(spark, d):
    return us.user_totals(tb.users(spark, d), 500)


@query("ANA-6 ANA-14", tb.with_views(tb.USERS) + f"SELECT count(*) AS new_users FROM users WHERE created_at >= {SHIPPED} - INTERVAL 30 DAY")
def new_users(spark, d):
    return us.new_users(tb.users(spark, d), 30, _shipped())


@query("ANA-7 ANA-14", tb.with_views(tb.SESSIONS, tb.MESSAGES) + f"SELECT count(DISTINCT s.user_id) AS active_users FROM messages m JOIN sessions s ON s.id = m.session_id WHERE m.role = 'user' AND m.created_at >= {SHIPPED} - INTERVAL 30 DAY")
def active_users(spark, d):
    return us.active_users(tb.sessions(spark, d), tb.messages(spark, d), 30, _shipped())


@query("ANA-8", tb.with_views(tb.SESSIONS, tb.MESSAGES) + """
SELECT CAST(count(*) FILTER (role = 'user') AS BIGINT) AS questions, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS answers, CAST(sum(input_tokens) FILTER (role = 'assistant') AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) FILTER (role = 'assistant') AS BIGINT) AS output_tokens, CAST(sum(thinking_tokens) FILTER (role = 'assistant') AS BIGINT) AS thinking_tokens FROM messages m JOIN sessions s ON s.id = m.session_id""")
def activity(spark, d):
    return us.activity(tb.sessions(spark, d), tb.messages(spark, d), None, _shipped())


@query("ANA-9 ANA-14", tb.with_views(tb.LEDGER) + """
SELECT CAST(coalesce(sum(abs(amount)) FILTER (type = 'usage'), 0) AS BIGINT) AS credits_used, CAST(coalesce(sum(amount) FILTER (type = 'refund' AND amount > 0), 0) AS BIGINT) AS credits_refunded
FROM ledger WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY""")
def credit_flow(spark, d):
    return us.credit_flow(tb.ledger_rows(spark, d), 7, tb.as_of())


@query("ANA-10 ANA-11", tb.with_views(tb.TURNS) + """
SELECT *, CASE WHEN tracked_turns - pending_turns > 0 THEN round_even(successful_turns * 100 / (tracked_turns - pending_turns), 1) END AS success_rate,
  CASE WHEN successful_turns > 0 THEN round_even(fallback_turns * 100 / successful_turns, 1) END AS fallback_rate FROM (
SELECT count(*) AS tracked_turns, CAST(count(*) FILTER (status IN ('success', 'success_fallback')) AS BIGINT) AS successful_turns, CAST(count(*) FILTER (status = 'success_fallback') AS BIGINT) AS fallback_turns,
  CAST(count(*) FILTER (status IN ('error', 'partial_error')) AS BIGINT) AS failed_turns, CAST(count(*) FILTER (status = 'pending') AS BIGINT) AS pending_turns,
  CAST(count(*) FILTER (retrieval_status IN ('partial', 'failed')) AS BIGINT) AS degraded_retrieval_turns, round(avg(first_token_ms), 0) AS avg_first_token_ms, round(avg(total_ms), 0) AS avg_total_ms FROM turns)""")
def reliability(spark, d):
    return us.reliability(tb.turns(spark, d), None, tb.as_of())


MODEL_USAGE = """SELECT m.model, count(*) AS message_count, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(thinking_tokens), 0) AS BIGINT) AS thinking_tokens
FROM messages m JOIN sessions s ON s.id = m.session_id WHERE m.role = 'assistant' AND (input_tokens IS NOT NULL OR output_tokens IS NOT NULL OR thinking_tokens IS NOT NULL) GROUP BY m.model"""


@query("ANA-12", tb.with_views(tb.SESSIONS, tb.MESSAGES) + MODEL_USAGE + " ORDER BY message_count DESC, model")
def usage_by_model(spark, d):
    return us.usage_by_model(tb.sessions(spark, d), tb.messages(spark, d), None, _shipped())


@query("ANA-13", tb.with_views(tb.SESSIONS, tb.MESSAGES) + f"""
SELECT strftime(day, '%Y-%m-%d') AS date, coalesce(questions, 0) AS questions, coalesce(active_users, 0) AS active_users FROM (
  SELECT CAST(unnest(generate_series(CAST({SHIPPED} + INTERVAL 9 HOUR AS DATE) - 13, CAST({SHIPPED} + INTERVAL 9 HOUR AS DATE), INTERVAL 1 DAY)) AS DATE) AS day)
LEFT JOIN (SELECT CAST(m.created_at + INTERVAL 9 HOUR AS DATE) AS d, count(*) AS questions, count(DISTINCT s.user_id) AS active_users FROM messages m JOIN sessions s ON s.id = m.session_id
  WHERE m.role = 'user' AND m.created_at >= {SHIPPED} - INTERVAL 13 DAY GROUP BY d) ON d = day""")
def daily_series(spark, d):
    return us.daily(tb.sessions(spark, d), tb.messages(spark, d), _shipped()).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("ANA-15", tb.with_views(tb.SESSIONS, tb.MESSAGES, tb.PRICES) + """
SELECT u.model, round((input_tokens * coalesce(p.input, q.input) + output_tokens * coalesce(p.output, q.output) + thinking_tokens * coalesce(p.thinking, q.thinking)) / 1000000, 6) AS cost
FROM (""" + MODEL_USAGE + ") u LEFT JOIN prices p ON p.model = u.model, (SELECT * FROM prices WHERE model = 'model-1') q")
def cost_by_model(spark, d):
    usage = us.usage_by_model(tb.sessions(spark, d), tb.messages(spark, d), None, _shipped())
    return us.with_cost(usage, tb.prices(spark, d), "model-1").select("model", F.round("cost", 6).alias("cost"))


@query("ANA-15", tb.with_views(tb.SESSIONS, tb.MESSAGES, tb.PRICES) + """
SELECT user_id, round(sum((input_tokens * coalesce(p.input, q.input) + output_tokens * coalesce(p.output, q.output) + thinking_tokens * coalesce(p.thinking, q.thinking)) / 1000000), 4) AS cost
FROM (""" + BY_MODEL.format(where="") + ") u LEFT JOIN prices p ON p.model = u.model, (SELECT * FROM prices WHERE model = 'model-1') q GROUP BY user_id")
def cost_by_user(spark, d):
    usage = us.usage_by_user_and_model(tb.sessions(spark, d), tb.messages(spark, d))
    return us.with_cost(usage, tb.prices(spark, d), "model-1").groupBy("user_id").agg(F.round(F.sum("cost"), 4).alias("cost"))


@query("ANA-16", tb.with_views(tb.USERS, tb.SESSIONS) + "SELECT s.id, s.user_id, s.title, u.email, u.name AS user_name, strftime(s.updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM sessions s JOIN users u ON u.id = s.user_id ORDER BY s.updated_at DESC, s.id DESC")
def session_list(spark, d):
    return us.session_list(tb.sessions(spark, d), tb.users(spark, d)).select("id", "user_id", "title", "email", "user_name", _text("updated_at"))


@query("ANA-16", tb.with_views(tb.SESSIONS) + "SELECT id, title FROM sessions WHERE deleted_at IS NULL AND user_id = (SELECT max(o_custkey) FROM orders)")
def open_sessions(spark, d):
    s = tb.sessions(spark, d)
    return us.open_sessions(s, s.agg(F.max("user_id")).scalar()).select("id", "title")


@query("ANA-17", "SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn")
def messages_in_order(spark, d):
    from loreloom.plans.registry import table

    return us.messages_in_order(table(spark, d, "conversations"), session="conv_id", order=["turn"]).select("conv_id", "turn", "role", "text")


@query("ANA-18", tb.with_views(tb.TURNS) + "SELECT id, status, total_ms FROM turns WHERE status = 'error' ORDER BY created_at DESC, id DESC LIMIT 500")
def turn_diagnostics(spark, d):
    return us.turn_diagnostics(tb.turns(spark, d), 9999, "error").select("id", "status", "total_ms")


@query("ANA-19", tb.with_views(tb.LEDGER) + """
SELECT user_id, id, amount, type, CASE WHEN type = 'usage' THEN '질문' WHEN type = 'refund' AND memo LIKE '오류 환불 (%' THEN '오류 환불' ELSE memo END AS memo FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM ledger) WHERE r <= 30""")
def transaction_history(spark, d):
    return us.transaction_history(tb.ledger_rows(spark, d), 30, public=True).select("user_id", "id", "amount", "type", "memo")


@query("ANA-20", tb.with_views(tb.PAYMENTS) + """
SELECT user_id, order_id, goods_name, quantity, amount, status, method, unit_price, tid, granted, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM payments) WHERE r <= 5""")
def payments_per_user(spark, d):
    return us.payment_list(tb.payments(spark, d), 5, per_user=True, admin=True).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).drop("rank")


@query("ANA-20", tb.with_views(tb.PAYMENTS) + "SELECT order_id, goods_name, quantity, amount, status, method FROM payments ORDER BY id DESC LIMIT 50")
def newest_payments(spark, d):
    return us.payment_list(tb.payments(spark, d), 50).drop("created_at")


@query("ANA-21", tb.with_views(tb.USERS) + "SELECT id, name, credits FROM users WHERE contains(lower(name), '12') OR contains(lower(email), '12') ORDER BY credits DESC, id")
def user_search(spark, d):
    return us.search_users(tb.users(spark, d), "12", sort="credits", descending=True).select("id", "name", "credits")
