"""Usage analytics over users, sessions, messages, ledger rows, turns and payments.

Messages are aggregated per session before they meet the sessions, so a join never carries single
messages. The moment of a report is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions import fixed_values as fixed
from loreloom.operators import ordered

TOKENS = ("input_tokens", "output_tokens", "thinking_tokens")
PERIODS = (7, 30, None)
LOCAL_ZONE = "Asia/Seoul"
DAILY = 14
LOW_CREDITS = 5
SORT_KEYS = ("name", "credits", "tokens", "last_active", "created")
PUBLIC_PAYMENT = ("order_id", "goods_name", "quantity", "amount", "status", "method", "created_at", "approved_at",
                  "cancelled_at", "fail_reason")
ADMIN_PAYMENT = (*PUBLIC_PAYMENT, "user_id", "user_email", "unit_price", "tid", "granted", "reclaimed", "cancel_reason")


def _sum0(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("bigint"))


def live(users: DataFrame) -> DataFrame:
    return users.where(F.col("deleted_at").isNull())


def in_period(df: DataFrame, days: int | None, as_of: Column, column: str = "created_at") -> DataFrame:
    """Rows of the last 7 or 30 days before *as_of*; None keeps all."""
    if days not in PERIODS:
        raise ValueError("days must be 7, 30, or None")
    return df if days is None else df.where(F.col(column) >= as_of - F.make_dt_interval(F.lit(days)))


def per_session(messages: DataFrame, by: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    return messages.groupBy("session_id", *by).agg(
        *[F.sum(t).alias(t) for t in TOKENS], F.count("*").alias("message_count"), *extra)


def _of_users(sessions: DataFrame, per: DataFrame) -> DataFrame:
    owners = sessions.select(F.col("id").alias("session_id"), "user_id")
    return owners.join(per, "session_id")


def user_list(users: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Live users with the token totals and the last time of their answers, zeros without any."""
    answers = per_session(messages.where(F.col("role") == "assistant"), extra=[F.max("created_at").alias("last")])
    totals = _of_users(sessions, answers).groupBy(F.col("user_id").alias("id")).agg(
        *[F.sum(t).alias(f"total_{t}") for t in TOKENS], F.max("last").alias("last_active_at"))
    joined = live(users).join(totals, "id", "left")
    return joined.withColumns({f"total_{t}": F.coalesce(f"total_{t}", F.lit(0).cast("bigint")) for t in TOKENS})


def usage_by_user_and_model(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Answers with a recorded input count, per user and model."""
    counted = messages.where((F.col("role") == "assistant") & F.col("input_tokens").isNotNull())
    return _of_users(sessions, per_session(counted, ["model"])).groupBy("user_id", "model").agg(
        *[_sum0(t).alias(t) for t in TOKENS], F.sum("message_count").alias("message_count"))


def nested_usage(by_model: DataFrame) -> DataFrame:
    """One row per user; its list is as long as the list of models."""
    entry = F.struct("model", *TOKENS, "message_count")
    return by_model.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("models"))


def user_usage_by_model(sessions: DataFrame, messages: DataFrame, user_id: Column) -> DataFrame:
    """The same for one user: the filter reaches the scan of the sessions."""
    return usage_by_user_and_model(sessions.where(F.col("user_id") == user_id), messages).drop("user_id").orderBy("model")


def lifetime_stats(users: DataFrame, sessions: DataFrame, messages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Conversations, questions, credits used and refunded, token totals of every user."""
    is_answer = F.col("role") == "assistant"
    per = messages.groupBy("session_id").agg(
        F.count_if(F.col("role") == "user").alias("question_count"), *[F.sum(F.when(is_answer, F.col(t))).alias(t) for t in TOKENS])
    owned = sessions.select(F.col("id").alias("session_id"), "user_id").join(per, "session_id", "left")
    talk = owned.groupBy(F.col("user_id").alias("id")).agg(
        F.count("*").alias("conversation_count"), F.sum("question_count").alias("question_count"), *[F.sum(t).alias(t) for t in TOKENS])
    credit = ledger.groupBy(F.col("user_id").alias("id")).agg(*_credit_flow())
    joined = users.select("id").join(talk, "id", "left").join(credit, "id", "left")
    names = ("conversation_count", "question_count", "credits_used", "credits_refunded", *TOKENS)
    return joined.select("id", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in names])


def _credit_flow() -> list[Column]:
    kind, amount = F.col("type"), F.col("amount")
    zero = F.lit(0).cast("bigint")
    return [F.coalesce(F.sum(F.when(kind == "usage", F.abs(amount))), zero).alias("credits_used"),
            F.coalesce(F.sum(F.when((kind == "refund") & (amount > 0), amount)), zero).alias("credits_refunded")]


# --- overview -----------------------------------------------------------------------------------


def user_totals(users: DataFrame, low: int = LOW_CREDITS) -> DataFrame:
    return live(users).agg(F.count("*").alias("total_users"), _sum0("credits").alias("current_credits"),
                           F.count_if(F.col("credits") <= low).alias("low_credit_users"))


def new_users(users: DataFrame, days: int | None, as_of: Column) -> DataFrame:
    """Retired users count as well."""
    return in_period(users, days, as_of).agg(F.count("*").alias("new_users"))


def active_users(sessions: DataFrame, messages: DataFrame, days: int | None, as_of: Column) -> DataFrame:
    asked = in_period(messages.where(F.col("role") == "user"), days, as_of).select(F.col("session_id").alias("id")).distinct()
    return sessions.join(asked, "id", "left_semi").agg(F.count_distinct("user_id").alias("active_users"))


def activity(sessions: DataFrame, messages: DataFrame, days: int | None, as_of: Column) -> DataFrame:
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    per = in_period(messages, days, as_of).groupBy(F.col("session_id").alias("id")).agg(
        F.count_if(user).alias("questions"), F.count_if(answer).alias("answers"), *[F.sum(F.when(answer, F.col(t))).alias(t) for t in TOKENS])
    kept = per.join(sessions.select("id"), "id", "left_semi")
    return kept.agg(*[_sum0(c).alias(c) for c in ("questions", "answers", *TOKENS)])


def credit_flow(ledger: DataFrame, days: int | None, as_of: Column) -> DataFrame:
    return in_period(ledger, days, as_of).agg(*_credit_flow())


def rate(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, NULL without a denominator."""
    return F.when(whole > 0, F.bround(part * 100 / whole, 1))


def reliability(turns: DataFrame, days: int | None, as_of: Column) -> DataFrame:
    """Turn counts by outcome, average latencies, success and fallback rates."""
    s, r = F.col("status"), F.col("retrieval_status")
    t = in_period(turns, days, as_of).agg(
        F.count("*").alias("tracked_turns"), F.count_if(s.isin("success", "success_fallback")).alias("successful_turns"),
        F.count_if(s == "success_fallback").alias("fallback_turns"), F.count_if(s.isin("error", "partial_error")).alias("failed_turns"),
        F.count_if(s == "pending").alias("pending_turns"), F.count_if(r.isin("partial", "failed")).alias("degraded_retrieval_turns"),
        F.round(F.avg("first_token_ms"), 0).alias("avg_first_token_ms"), F.round(F.avg("total_ms"), 0).alias("avg_total_ms"))
    ok = F.col("successful_turns")
    return t.withColumn("success_rate", rate(ok, F.col("tracked_turns") - F.col("pending_turns"))).withColumn(
        "fallback_rate", rate(F.col("fallback_turns"), ok))


def usage_by_model(sessions: DataFrame, messages: DataFrame, days: int | None, as_of: Column) -> DataFrame:
    """Answers with any recorded token count, per model."""
    any_count = F.coalesce(*TOKENS).isNotNull()
    counted = in_period(messages.where((F.col("role") == "assistant") & any_count), days, as_of)
    kept = per_session(counted, ["model"]).join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    total = kept.groupBy("model").agg(F.sum("message_count").alias("message_count"), *[_sum0(t).alias(t) for t in TOKENS])
    return total.orderBy(F.desc("message_count"), "model")


def daily(sessions: DataFrame, messages: DataFrame, as_of: Column, *, days: int = DAILY, zone: str = LOCAL_ZONE) -> DataFrame:
    """Questions and askers per local day, zeros filled in. The rows are a rolling window, the days a
    calendar, so the first day is partial."""
    day = F.to_date(F.from_utc_timestamp("created_at", zone))
    asked = messages.where((F.col("role") == "user") & (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days - 1))))
    per = asked.groupBy("session_id", day.alias("date")).agg(F.count("*").alias("n"))
    found = _of_users(sessions, per).groupBy("date").agg(F.sum("n").alias("questions"), F.count_distinct("user_id").alias("active_users"))
    today = F.to_date(F.from_utc_timestamp(as_of, zone))
    spine = messages.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("date"))
    joined = spine.join(found, "date", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select("date", F.coalesce("questions", zero).alias("questions"), F.coalesce("active_users", zero).alias("active_users")).orderBy("date")


def with_cost(usage: DataFrame, prices: DataFrame, primary: str) -> DataFrame:
    """Cost in USD of token sums by model; models without a price cost what the primary one does."""
    listed = prices.select("model", *[F.col(c).alias(f"__{c}") for c in ("input", "output", "thinking")])
    default = prices.where(F.col("model") == primary).select(F.struct("input", "output", "thinking")).scalar()
    joined = usage.join(listed, "model", "left").withColumn("__d", default)
    parts = [F.col(f"{c}_tokens") * F.coalesce(f"__{c}", F.col("__d")[c]) for c in ("input", "output", "thinking")]
    cost = sum(parts[1:], parts[0]) / 1_000_000
    return joined.withColumn("cost", cost).drop("__d", *[f"__{c}" for c in ("input", "output", "thinking")])


# --- lists --------------------------------------------------------------------------------------


def session_list(sessions: DataFrame, users: DataFrame, user_id: Column | None = None) -> DataFrame:
    """Sessions with their owner, newest first."""
    rows = sessions if user_id is None else sessions.where(F.col("user_id") == user_id)
    owners = users.select(F.col("id").alias("user_id"), "email", F.col("name").alias("user_name"))
    return rows.join(owners, "user_id").orderBy(F.desc("updated_at"), F.desc("id"))


def open_sessions(sessions: DataFrame, user_id: Column) -> DataFrame:
    return sessions.where((F.col("user_id") == user_id) & F.col("deleted_at").isNull()).orderBy(F.desc("updated_at"), F.desc("id"))


def messages_in_order(messages: DataFrame, *, session: str = "session_id", order: Sequence[str] = ("created_at",),
                      session_id: Column | None = None) -> DataFrame:
    rows = messages if session_id is None else messages.where(F.col(session) == session_id)
    return rows.orderBy(*([session] if session_id is None else []), *order)


def turn_diagnostics(turns: DataFrame, limit: int = 100, status: str | None = None) -> DataFrame:
    """Newest turns, between 1 and 500 of them."""
    rows = turns if status is None else turns.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(limit, 500)))


def public_memo(kind: Column, memo: Column) -> Column:
    """Memos without model names and reasons."""
    hidden = [memo.startswith(p) for p in fixed.REDACTED_MEMO_PREFIXES]
    cut = hidden[0]
    for h in hidden[1:]:
        cut = cut | h
    return F.when(kind == "usage", F.lit(fixed.USAGE_MEMO)).when((kind == "refund") & cut, F.split_part(memo, F.lit(" ("), F.lit(1))).otherwise(memo)


def transaction_history(ledger: DataFrame, limit: int = 30, *, public: bool = False) -> DataFrame:
    """Newest ledger rows of every user."""
    top = ordered.top_per_key(ledger, ["user_id"], [F.desc("id")], limit)
    return top.withColumn("memo", public_memo(F.col("type"), F.col("memo"))) if public else top


def payment_list(payments: DataFrame, limit: int = 50, *, per_user: bool = False, admin: bool = False) -> DataFrame:
    """Newest payments, of all or of each user, without raw answers of the payment service."""
    columns = [c for c in (ADMIN_PAYMENT if admin else PUBLIC_PAYMENT) if c in payments.columns]
    if per_user:
        top = ordered.top_per_key(payments, ["user_id"], [F.desc("id")], limit)
        return top.select("user_id", *[c for c in columns if c != "user_id"], "rank")
    return payments.orderBy(F.desc("id")).limit(limit).select(*columns)


def search_users(users: DataFrame, text: str = "", *, sort: str | None = None, descending: bool = False) -> DataFrame:
    """Users whose name or address holds the text, in the order of one of five keys."""
    if sort is not None and sort not in SORT_KEYS:
        raise ValueError(f"sort must be one of {SORT_KEYS}")
    low = text.lower()
    rows = users if not low else users.where(F.lower("name").contains(low) | F.lower("email").contains(low))
    if sort is None:
        return rows
    zero, empty = F.lit(0), F.lit("")
    keys = {
        "name": lambda: F.lower(F.coalesce("name", empty)), "credits": lambda: F.coalesce("credits", zero),
        "tokens": lambda: sum((F.coalesce(f"total_{t}", zero) for t in TOKENS), F.lit(0)),
        "last_active": lambda: F.coalesce(F.col("last_active_at").cast("string"), empty),
        "created": lambda: F.coalesce(F.col("created_at").cast("string"), empty),
    }
    key = keys[sort]()
    return rows.orderBy(key.desc() if descending else key.asc(), "id")
