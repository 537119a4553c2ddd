"""Pure step functions: one entry against one state. Batch folds and streams share them."""

from __future__ import annotations

# Kinds of ledger entries.
USAGE, REFUND, PURCHASE, CANCEL, SET, FLOOR, GRANT = "usage", "refund", "purchase", "cancel", "set", "floor", "grant"

# Events that change an order.
PAID, FAIL, CANCELLED, EXPIRE = "paid", "fail", "cancelled", "expire"
GRANTABLE = ("pending", "expired")


def apply_entry(credits: int, paid: int, kind: str, amount: int) -> tuple[int, int, int, bool]:
    """(credits, paid part, change, accepted) after one ledger entry; 0 <= paid <= credits holds.

    usage spends the free part first and is refused when the balance is short; refund and grant go
    to the free part; purchase raises both; cancel takes back what is left of the paid part; set
    fixes the balance; floor lifts the free part to the amount.
    """
    if kind == USAGE:
        if credits < amount:
            return credits, paid, 0, False
        return credits - amount, min(paid, credits - amount), -amount, True
    if kind in (REFUND, GRANT):
        return credits + amount, paid, amount, True
    if kind == PURCHASE:
        return credits + amount, paid + amount, amount, True
    if kind == CANCEL:
        back = max(0, min(amount, paid))
        return credits - back, paid - back, -back, back > 0
    if kind == SET:
        return amount, min(paid, amount), amount - credits, amount != credits
    if kind == FLOOR:
        lift = max(0, amount - (credits - paid))
        return credits + lift, paid, lift, lift > 0
    raise ValueError(f"unknown ledger entry {kind!r}")


def order_step(status: str, event: str) -> str:
    """Next status of an order; an event that does not apply changes nothing."""
    if event == PAID and status in GRANTABLE:
        return "paid"
    if event == FAIL and status in GRANTABLE:
        return "failed"
    if event == CANCELLED and status == "paid":
        return "cancelled"
    if event == EXPIRE and status == "pending":
        return "expired"
    return status
