"""Rules that depend on earlier verdicts, as keyed state over a stream.

Rows wait in state until the watermark has passed their second; a timer then takes all that are due of a key, orders them
and walks them on from the verdicts before. So verdicts equal those of a batch over the same rows, in whatever order and
triggers the rows came in up to the watermark's delay; later rows are left out, as they are by every append-mode aggregate.

A call to the state costs far more than a row, so waiting rows lie together in wide buckets of event time; one of more than
DENSE rows is split into FAN narrower ones, down to a second. What a task holds is one Arrow batch and one bucket of one
key, however many rows a key or a trigger has, and calls go with keys and buckets instead of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater import contracts as C

SECOND = 1_000_000
DENSE = 1000
FAN = 64
WIDTHS = tuple(FAN ** n for n in (4, 3, 2, 1, 0))  # seconds of a bucket, by level


def _processor(columns: tuple[str, ...], state_schema: str, open_state, walk, forget) -> StatefulProcessor:
    """A processor whose class is made here, so that it travels to the workers by value.

    `columns` are long columns of the input that a bucket keeps; the first two order it. `open_state(frame)` gives
    the state a new key starts with (None: every key starts without), `walk(state, row)` yields the next state and the
    row's verdict, and `forget(state)` says when, in event time (ms), a state that no row has touched may go (None: never).
    """
    lists = ", ".join(f"{c} array<bigint>" for c in columns)
    second_us, widths, dense, most = SECOND, WIDTHS, DENSE, 10_000

    class InEventOrder(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.buckets = handle.getMapState("buckets", "level int, place bigint", f"{lists}, parts array<bigint>")
            self.waiting = handle.getValueState("waiting", "places array<bigint>")
            self.state = handle.getValueState("state", state_schema)
            self.ends = handle.getValueState("ends", "at bigint")

        def put(self, level: int, place: int, rows: list[tuple]) -> None:
            """Add rows to a bucket, or to those it was split into."""
            held = self.buckets.getValue((level, place))
            parts = None if held is None else held[-1]
            if parts is None:
                if held is not None:
                    rows = [*zip(*held[:-1]), *rows]
                if len(rows) <= dense or level == len(widths) - 1:
                    self.buckets.updateValue((level, place), (*map(list, zip(*rows)), None))
                    return
            below: dict[int, list[tuple]] = {}
            for row in rows:
                below.setdefault(row[0] // second_us // widths[level + 1], []).append(row)
            if parts is None or not below.keys() <= set(parts):
                self.buckets.updateValue((level, place), (*[[]] * len(columns), sorted({*(parts or ()), *below})))
            for part, its in below.items():
                self.put(level + 1, part, its)

        def take(self, level: int, place: int, last: int) -> Iterator[list[tuple]]:
            """Yield, in order, the rows of a bucket up to the second `last` and drop them; return a second before which
            none of the others is (None: there are none)."""
            held = self.buckets.getValue((level, place))
            if held[-1] is None:
                rows = sorted(zip(*held[:-1]), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
                due = [r for r in rows if r[0] // second_us <= last]
                rest = rows[len(due):]
                if due:
                    yield due
                    if rest:
                        self.buckets.updateValue((level, place), (*map(list, zip(*rest)), None))
                    else:
                        self.buckets.removeKey((level, place))
                return rest[0][0] // second_us if rest else None
            parts, after = sorted(held[-1]), None
            while parts and after is None and parts[0] * widths[level + 1] <= last:
                after = yield from self.take(level + 1, parts[0], last)
                if after is None:
                    parts.pop(0)
            if not parts:
                self.buckets.removeKey((level, place))
                return None
            if len(parts) < len(held[-1]):
                self.buckets.updateValue((level, place), (*[[]] * len(columns), parts))
            return parts[0] * widths[level + 1] if after is None else after

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            for frame in rows:
                if open_state is not None and not self.state.exists():
                    opening = open_state(frame)
                    if opening is not None:
                        self.state.update(opening)
                frame = frame[frame["at"].notna()]
                new: dict[int, list[tuple]] = {}
                for row in zip(*([None if pd.isna(v) else int(v) for v in frame[c]] for c in columns)):
                    new.setdefault(row[0] // second_us // widths[0], []).append(row)
                held = self.waiting.get()
                places = set(held[0]) if held is not None else set()
                if not new.keys() <= places:
                    self.waiting.update((sorted({*places, *new}),))
                for place, its in new.items():
                    self.handle.registerTimer((min(r[0] for r in its) // second_us + 1) * 1000)
                    self.put(0, place, its)
            yield from ()

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            at = expiredTimerInfo.getExpiryTimeInMs()
            last = max(timerValues.getCurrentWatermarkInMs(), at) // 1000 - 1
            held = self.waiting.get()
            places = sorted(held[0]) if held is not None else []
            before, after, state, touched = len(places), None, None, False
            ids, verdicts = [], []

            def made() -> pd.DataFrame:
                return pd.DataFrame({"request_id": pd.array(ids, "Int64"), **{f"key_{i}": [k] * len(ids) for i, k in enumerate(key)},
                                     "verdict": verdicts})

            while places and after is None and places[0] * widths[0] <= last:
                due = self.take(0, places[0], last)
                while True:
                    try:
                        bucket = next(due)
                    except StopIteration as ended:
                        after = ended.value
                        break
                    if not touched:
                        state, touched = self.state.get(), True
                    for row in bucket:
                        state, verdict = walk(state, row)
                        ids.append(row[1])
                        verdicts.append(verdict)
                    if len(ids) >= most:
                        yield made()
                        ids, verdicts = [], []
                if after is None:
                    places.pop(0)
            if len(places) < before:
                self.waiting.update((places,)) if places else self.waiting.clear()
            if after is not None:
                self.handle.registerTimer((after + 1) * 1000)
            if touched:
                if state is not None:
                    self.state.update(state)
                    end = forget(state)
                    if end is not None:
                        self.ends.update((end,))
                        self.handle.registerTimer(end)
                if ids:
                    yield made()
            elif forget is not None:
                end = self.ends.get()
                if end is not None and end[0] == at:  # no row has moved the end since
                    self.state.clear()
                    self.ends.clear()

        def close(self) -> None:
            pass

    return InEventOrder()


def admit_stream(hits: DataFrame, limit: int = C.RATE_LIMIT_HITS, seconds: int = C.RATE_LIMIT_SECONDS,
                 delay: str = "10 minutes") -> DataFrame:
    """Streaming form of the sliding-window limit over (request_id, client, ts): (request_id, client, admitted).

    A client's state is at most `limit` admitted times, and goes when the last of them has left the window.
    """
    span = seconds * SECOND

    def walk(state, row):
        admitted = [t for t in (state[0] if state else []) if row[0] - t <= span]
        granted = len(admitted) < limit
        return ((admitted + [row[0]] if granted else admitted,), granted)

    def forget(state):
        # The last admitted time is out of the window one second after this at the latest, on no bucket's own end.
        return (max(state[0]) + span) // 1000 + 1001 if state[0] else None

    timed = hits.withWatermark("ts", delay).select(
        F.col("request_id").cast("bigint"), F.col("client").cast("string"), F.unix_micros("ts").alias("at"), "ts")
    processor = _processor(("at", "request_id"), "times array<bigint>", None, walk, forget)
    out = timed.groupBy("client").transformWithStateInPandas(
        processor, "request_id bigint, key_0 string, verdict boolean", "Append", "EventTime")
    return out.select("request_id", F.col("key_0").alias("client"), F.col("verdict").alias("admitted"))


def reserve_stream(requests: DataFrame, stock: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming form of first-come reservation over (request_id, sku, node_id, qty, requested_at):
    (request_id, sku, node_id, outcome).

    `stock` is a batch table with the opening quantity per (sku, node_id); a key it does not know is answered with
    unknown_stock, a quantity below 1 with invalid_qty, and an absent one with rejected, as in batch. What is left
    of a key is one number, and stays.
    """

    def opening(frame: pd.DataFrame):
        held = frame["available_qty"].iloc[0]
        return None if pd.isna(held) else (int(held),)

    def walk(state, row):
        qty = row[2]
        if state is None:
            return None, "unknown_stock"
        if qty is not None and qty <= 0:
            return state, "invalid_qty"
        if qty is not None and qty <= state[0]:
            return (state[0] - qty,), "reserved"
        return state, "rejected"

    opened = requests.withWatermark("requested_at", delay).select(
        F.col("request_id").cast("bigint"), "sku", "node_id", F.col("qty").cast("bigint"),
        F.unix_micros("requested_at").alias("at"), "requested_at",
    ).join(stock.select("sku", "node_id", F.col("available_qty").cast("bigint")), ["sku", "node_id"], "left")
    processor = _processor(("at", "request_id", "qty"), "available bigint", opening, walk, lambda state: None)
    out = opened.groupBy("sku", "node_id").transformWithStateInPandas(
        processor, "request_id bigint, key_0 string, key_1 string, verdict string", "Append", "EventTime")
    return out.select("request_id", F.col("key_0").alias("sku"), F.col("key_1").alias("node_id"), F.col("verdict").alias("outcome"))
