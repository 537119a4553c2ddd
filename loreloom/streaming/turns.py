"""Turn roll-up as a stream: turns are held in buckets and closed once the watermark passes its last event or a long silence."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loreloom.operators import turns as tn

STALE_MS = 15 * 60 * 1000
BUCKETS = 512  # states; open turns are dealt to them


def combined(held: dict, more: dict) -> dict:
    """Both sides' contributions as one; the order of the sides does not matter."""
    out = held | more
    for name in held.keys() & more.keys():
        pair = held[name], more[name]
        if name == "places":
            out[name] = {m: min(side[m] for side in pair if m in side) for m in pair[0].keys() | pair[1].keys()}
        else:
            # Structs carry their seq, the rest are numbers; a seq that comes again carries the same event.
            out[name] = (min if name in tn.LEAST else max)(pair, key=lambda x: x["seq"] if isinstance(x, dict) else x)
    return out


class TurnProcessor(StatefulProcessor):
    """Events may come in any order and in any micro-batch, as long as they come before the watermark.

    A turn closes when the watermark passes its ``done`` event, or *stale_ms* after its last event. A key is a bucket of turns: a
    call and its state serve all turns of the bucket, whose timer is that of the first of them to close.
    """

    def __init__(self, stale_ms: int = STALE_MS):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("turns", "turns string, timer bigint")

    def closes(self, body: dict) -> int:
        return body["end"] // 1000 + 1 + (0 if body["done"] else self.stale_ms)

    def hold(self, turns: dict, before: int | None) -> None:
        timer = min(map(self.closes, turns.values()), default=None)
        if before is not None and before != timer:
            self.handle.deleteTimer(before)
        if timer is None:
            self.state.clear()
            return
        self.handle.registerTimer(timer)
        self.state.update((json.dumps(list(turns.items())), timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get()
        turns = dict(json.loads(before[0])) if before else {}
        for chunk in rows:
            for turn, event in zip(chunk["turn_id"], chunk["body"]):
                turn, body = turn if isinstance(turn, str) else None, json.loads(event)
                turns[turn] = combined(turns[turn], body) if turn in turns else body
        self.hold(turns, before[1] if before else None)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if held:
            turns = json.loads(held[0])
            passed = timerValues.getCurrentWatermarkInMs()
            closed = [self.closes(body) < passed or self.closes(body) <= held[1] for _, body in turns]  # a fired timer is not kept
            self.hold(dict(t for t, done in zip(turns, closed) if not done), held[1])
            done = [t for t, done in zip(turns, closed) if done]
            yield pd.DataFrame({"turn_id": [turn for turn, _ in done], "body": [json.dumps(body) for _, body in done]}, dtype=object)

    def close(self) -> None:
        pass


def roll_up_stream(events: DataFrame, *, delay: str = "1 minute", stale_ms: int = STALE_MS, buckets: int = BUCKETS) -> DataFrame:
    """The fields of the batch roll-up, for turns as they close."""
    rows = tn.contributions(events.withWatermark("ts", delay))
    body = rows.drop("turn_id", "ts")
    rows = rows.select(F.pmod(F.xxhash64("turn_id"), F.lit(buckets)).alias("bucket"), "turn_id", "ts", F.to_json(F.struct(*body.columns)).alias("body"))
    closed = rows.groupBy("bucket").transformWithStateInPandas(TurnProcessor(stale_ms), "turn_id string, body string", "Append", "EventTime")
    turns = closed.select("turn_id", F.from_json("body", body.schema).alias("b")).select("turn_id", "b.*")
    by_place = F.array_sort(F.transform(F.map_entries("places"), lambda e: F.struct(e["value"], e["key"])))
    return tn.finished(turns.withColumn("attempted_models", F.when(F.size("places") > 0, F.transform(by_place, lambda e: e["key"]))))
