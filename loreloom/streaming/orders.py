"""Order settlement as a stream: replays are harmless, abandoned orders expire, late payments settle.

The state keeps what decides an order, by ``seq``: the first payment per amount, the first failure and the
cancellations. The status is worked out from that, so the order of arrival does not matter; a status that a late
event corrects is told again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loreloom.functions.steps import CANCELLED, EXPIRE, FAIL, PAID, order_step

EXPIRY_MS = 60 * 60 * 1000
TRANSITIONS = "order_id string, seq bigint, event string, status string, granted bigint"
Move = tuple[int | None, str, str, int | None]


def new_order() -> dict:
    """No creation seen; firsts: {(event, amount): (seq, time)}; told: statuses sent on."""
    return {"made": None, "firsts": {}, "cancels": [], "expired": False, "told": []}


def note(s: dict, event: str, seq: int, at: int, amount: int | None, quantity: int | None, user_id: int | None, expiry_ms: int) -> None:
    """Keep what an event says about its order."""
    if event == "created":
        if s["made"] is None or seq < s["made"][0]:
            s["made"] = [seq, user_id, quantity, amount, at + expiry_ms]
    elif event == CANCELLED:
        s["cancels"] = sorted({*s["cancels"], seq})
    elif event in (PAID, FAIL):
        name = f"{event} {amount if event == PAID and amount is not None else ''}"
        s["firsts"][name] = min(s["firsts"].get(name, [seq, at]), [seq, at])


def decision(s: dict) -> tuple[int, int, str] | None:
    """(seq, time, event) of the first event that decides the order; a payment of another amount does not."""
    seen = [(*s["firsts"][name], name.split()[0]) for name in (FAIL + " ", PAID + " ", f"{PAID} {s['made'][3]}") if name in s["firsts"]]
    return min(seen, default=None)


def moves(s: dict) -> list[Move]:
    """Every change of status of the order, from its creation."""
    if s["made"] is None:
        return []
    first, user_id, quantity, _, deadline = s["made"]
    decided, out = decision(s), [(first, "created", "pending", None)]
    steps = [(None, EXPIRE)] if s["expired"] or decided and decided[1] > deadline else []
    if decided:
        steps.append((decided[0], decided[2]))
        steps += [(seq, CANCELLED) for seq in s["cancels"] if seq > decided[0]][:1]
    for seq, event in steps:
        status = order_step(out[-1][2], event)
        if status != out[-1][2]:
            out.append((seq, event, status, (0 if user_id is None else quantity) if status in ("paid", "cancelled") else None))
    return out


def untold(s: dict) -> list[Move]:
    """Changes not sent on yet; the last one again where an earlier answer was corrected."""
    every = moves(s)
    fresh = [m for m in every if m[2] not in s["told"]] or [m for m in every[-1:] if m[2] != s["told"][-1]]
    s["told"] = [*[t for t in s["told"] if t not in {m[2] for m in fresh}], *[m[2] for m in fresh]]
    return fresh


def forget(s: dict, watermark_ms: int) -> None:
    """Drop cancellations that no event still to come can bring into play: those before a decision the watermark has passed."""
    decided = decision(s) if s["made"] else None
    if decided and decided[1] < watermark_ms:
        s["cancels"] = [c for c in s["cancels"] if c > decided[0]][:1]


class OrderProcessor(StatefulProcessor):
    """State of one order. Its ``created`` event may come before or after the others; an order without one tells nothing."""

    def __init__(self, expiry_ms: int = EXPIRY_MS):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("order", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        s = json.loads(held[0]) if held else new_order()
        open_ = s["made"] is not None
        for chunk in rows:
            for row in chunk[chunk["rejected"].isna()].itertuples(index=False):
                amount, quantity, user_id = (None if pd.isna(x) else int(x) for x in (row.amount, row.quantity, row.user_id))
                note(s, row.event, int(row.seq), row.ts.value // 1_000_000, amount, quantity, user_id, self.expiry_ms)
        forget(s, timerValues.getCurrentWatermarkInMs())
        if s["made"] is not None and not open_:
            self.handle.registerTimer(s["made"][4])
        out = untold(s)
        self.state.update((json.dumps(s),))
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if held:
            s = json.loads(held[0])
            s["expired"] |= decision(s) is None
            out = untold(s)
            self.state.update((json.dumps(s),))
            yield _frame(key[0], out)

    def close(self) -> None:
        pass


def _frame(order_id: str, rows: list[Move]) -> pd.DataFrame:
    df = pd.DataFrame([(order_id, *r) for r in rows], columns=["order_id", "seq", "event", "status", "granted"])
    return df.astype({"seq": "Int64", "granted": "Int64"})


def settle_stream(events: DataFrame, *, delay: str = "10 minutes", expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """Transitions of every order, from ``order_id, seq, ts, event, amount, quantity, user_id, rejected``."""
    return events.withWatermark("ts", delay).groupBy("order_id").transformWithStateInPandas(
        OrderProcessor(expiry_ms), TRANSITIONS, "Append", "EventTime")
