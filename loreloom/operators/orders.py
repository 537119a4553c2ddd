"""Orders: pricing, signatures, event checks, the state machine, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.session import cut_lineage

MIN_CARD_AMOUNT = 1_000
MAX_QUANTITY = 1_000
EXPIRY_MINUTES = 60
STATUSES = ("pending", "expired", "paid", "failed", "cancelled")


def min_quantity(unit_price: Column, floor: int = MIN_CARD_AMOUNT) -> Column:
    """Least quantity whose amount reaches the card minimum."""
    return F.greatest(F.lit(1), F.ceil(F.lit(floor) / F.greatest(F.lit(1), unit_price))).cast("bigint")


def price_orders(requests: DataFrame, *, quantity: str = "quantity", unit_price: str = "unit_price",
                 max_quantity: int = MAX_QUANTITY, floor: int = MIN_CARD_AMOUNT) -> DataFrame:
    """Adds ``amount`` and ``rejected`` (NULL for valid requests)."""
    low = min_quantity(F.col(unit_price), floor)
    high = F.greatest(low, F.lit(max_quantity))
    q = F.col(quantity)
    reason = F.when(q.isNull() | (q < low) | (q > high), F.concat(F.lit("quantity must be "), low, F.lit("~"), high)).when(
        q * F.col(unit_price) < floor, F.concat(F.lit("amount must be at least "), F.lit(floor)))
    return requests.withColumn("rejected", reason).withColumn(
        "amount", F.when(F.col("rejected").isNull(), q * F.greatest(F.lit(1), F.col(unit_price))).cast("bigint"))


def signature(*parts: Column) -> Column:
    """Hex SHA-256 of the concatenated fields; NULL fields count as empty."""
    return F.sha2(F.concat(*[tx.or_empty(p.cast("string")) for p in parts]), 256)


def signature_matches(expected: Column, received: Column) -> Column:
    return F.coalesce((received != "") & (expected == received), F.lit(False))


def check_events(events: DataFrame, orders: DataFrame, secret: str) -> DataFrame:
    """Adds ``rejected``: why an event must not touch its order, NULL when it may.

    Events: ``order_id, event, amount`` (text), ``tid, edi_date, signature``. An absent signature is
    not checked, a wrong one rejects. The amount must be readable, and equal the order's to pay it.
    """
    known = orders.select("order_id", F.col("amount").alias("__amount"))
    e = events.join(known, "order_id", "left")
    expected = signature(F.col("tid"), F.col("amount"), F.col("edi_date"), F.lit(secret))
    signed = tx.or_empty("signature") != ""
    number = tx.parse_int("amount")
    reason = (
        F.when(tx.strip(tx.or_empty("order_id")) == "", "no order").when(F.col("__amount").isNull(), "unknown order")
        .when(signed & ~signature_matches(expected, F.col("signature")), "bad signature")
        .when(number.isNull(), "unreadable amount")
        .when((F.col("event") == "paid") & (number != F.col("__amount")), "amount mismatch")
    )
    return e.withColumn("rejected", reason).drop("__amount")


def settle(orders: DataFrame, events: DataFrame, as_of: Column, *, expiry_minutes: int = EXPIRY_MINUTES) -> DataFrame:
    """Final state of every order after its accepted events, whatever their number.

    The first paid or fail event decides a pending or expired order; the first cancel after payment
    cancels it; replays change nothing; an undecided order expires. A paid order without a buyer
    grants nothing. Both steps are minima, so a hot order sends one row per task; the decisions are written once, so Spark
    splits the cancels of a hot order by their bytes.
    Orders: ``order_id, user_id, quantity, created_at``; events: ``order_id, seq, ts, event, rejected``.
    """
    valid = events.where(F.col("rejected").isNull()) if "rejected" in events.columns else events
    deciding = valid.where(F.col("event").isin("paid", "fail"))
    decided = cut_lineage(deciding.groupBy("order_id").agg(F.min(F.struct("seq", "event", "ts")).alias("__d")))
    paid = decided.where(F.col("__d.event") == "paid").select("order_id", F.col("__d.seq").alias("__paid"))
    cancels = valid.where(F.col("event") == "cancelled").select("order_id", "seq", "ts")
    undone = cancels.join(paid, "order_id").where(F.col("seq") > F.col("__paid")).groupBy("order_id").agg(
        F.min(F.struct("seq", "ts")).alias("__c"))
    o = orders.join(decided, "order_id", "left").join(undone, "order_id", "left")
    late = F.col("created_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(expiry_minutes))
    status = F.when(F.col("__c").isNotNull(), "cancelled").when(F.col("__d.event") == "paid", "paid").when(
        F.col("__d").isNotNull(), "failed").when(late, "expired").otherwise("pending")
    was_paid = F.coalesce(F.col("__d.event") == "paid", F.lit(False))
    granted = F.when(was_paid, F.when(F.col("user_id").isNull(), F.lit(0)).otherwise(F.col("quantity"))).cast("bigint")
    return o.withColumns({
        "status": status, "granted": granted, "decided_seq": F.col("__d.seq"), "cancelled_seq": F.col("__c.seq"),
        "approved_at": F.when(was_paid, F.col("__d.ts")), "cancelled_at": F.col("__c.ts")}).drop("__d", "__c")


def ledger_entries(settled: DataFrame) -> DataFrame:
    """Purchase and reclaim entries of settled orders, for the balance fold."""
    granting = settled.where(F.coalesce("granted", F.lit(0)) > 0)
    bought = granting.select("user_id", F.col("decided_seq").alias("position"), F.lit("purchase").alias("type"), F.col("granted").alias("amount"))
    back = granting.where(F.col("cancelled_seq").isNotNull()).select(
        "user_id", F.col("cancelled_seq").alias("position"), F.lit("cancel").alias("type"), F.col("granted").alias("amount"))
    return bought.unionByName(back)


def expire_stale(payments: DataFrame, as_of: Column, minutes: int = EXPIRY_MINUTES) -> tuple[DataFrame, DataFrame]:
    """Pending orders older than an hour become expired: (payments, one row with their number)."""
    stale = (F.col("status") == "pending") & (F.col("created_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    return payments.withColumn("status", F.when(stale, "expired").otherwise(F.col("status"))), payments.agg(F.count_if(stale).alias("expired"))
