"""Folds over a key's rows in event-time order, whatever micro-batch they come in.

Rows wait in state until the watermark has passed them, filed by the stretch of event time they fall into. An event-time
timer then releases those that are due, stretch by stretch and in (ts, attempt_id) order, to the fold, so a worker holds
one stretch of a key, not all that waits; late rows are dropped by Spark as everywhere. A fold may also ask to be woken at
a time without any row, as for the end of a cooldown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


#: Length of a stretch of event time, and rows that are held before they are filed.
STRETCH_US, HELD = 3_600_000_000, 100_000


class InTimeOrder(StatefulProcessor):
    """State ``waiting``: rows the watermark has not passed, in the parts of their stretch; ``parts``: how many parts a
    stretch has; ``folded``: what the fold keeps; ``timer``: when to wake."""

    def __init__(self, row: dict[str, str], state: str, out: list[str], fold: Callable, tick: Callable | None, wake: Callable | None):
        self.row, self.state, self.out, self.fold, self.tick, self.wake = row, state, out, fold, tick, wake

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(f"{n}: {t}" for n, t in self.row.items())
        self.waiting = handle.getMapState("waiting", "stretch long, part long", f"rows array<struct<{fields}>>")
        self.parts = handle.getMapState("parts", "stretch long", "parts long")
        self.folded = handle.getValueState("folded", self.state)
        self.timer = handle.getValueState("timer", "at_ms long")

    def _sleep(self, at_us: int | None) -> None:
        """One timer a key: the earliest time that something is due."""
        if at_us is None:
            return
        at = at_us // 1000 + 1
        known = self.timer.get()[0] if self.timer.exists() else None
        if known is None or at < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _file(self, chunks: list[pd.DataFrame]) -> None:
        """Add rows to their stretches, one part each."""
        held = pd.concat(chunks, ignore_index=True)
        for stretch, rows in held.groupby(held["ts_us"] // STRETCH_US):
            plain = rows.astype({n: "Int64" for n, t in self.row.items() if t in ("bigint", "int")}).astype(object)
            at = (int(stretch),)
            part = self.parts.getValue(at)[0] if self.parts.containsKey(at) else 0
            self.waiting.updateValue((*at, part), ([tuple(r) for r in plain.where(plain.notna(), None).itertuples(index=False)],))
            self.parts.updateValue(at, (part + 1,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, chunks, held = None, [], 0
        for chunk in rows:
            if len(chunk):
                chunks.append(chunk[list(self.row)])
                held += len(chunk)
                least = int(chunk["ts_us"].min())
                first = least if first is None else min(first, least)
            if held >= HELD:
                self._file(chunks)
                chunks, held = [], 0
        if chunks:
            self._file(chunks)
        self._sleep(first)
        yield self._frame(key, [])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        state, next_us = (tuple(self.folded.get()) if self.folded.exists() else None), None
        for stretch in sorted(k[0] for k in self.parts.keys()):
            if stretch * STRETCH_US >= now_us:
                next_us = stretch * STRETCH_US
                break
            parts = range(self.parts.getValue((stretch,))[0])
            held = [_Row(list(self.row), r) for n in parts for r in self.waiting.getValue((stretch, n))[0]]
            due = sorted((r for r in held if r.ts_us < now_us), key=lambda r: (r.ts_us, r.attempt_id is None, r.attempt_id or 0))
            later, out = [r for r in held if r.ts_us >= now_us], []
            for row in due:
                state, more = self.fold(state, row)
                out += more
            if due or not later:
                for n in parts:
                    self.waiting.removeKey((stretch, n))
                if later:
                    self.waiting.updateValue((stretch, 0), ([r.values for r in later],))
                    self.parts.updateValue((stretch,), (1,))
                else:
                    self.parts.removeKey((stretch,))
            if out:
                yield self._frame(key, out)
            if later:
                next_us = min(r.ts_us for r in later)
                break
        out = []
        if self.tick and state is not None:
            state, out = self.tick(state, now_us)
        if state is not None:
            self.folded.update(state)
        elif self.folded.exists():
            self.folded.clear()
        wake = self.wake(state) if self.wake and state is not None else None
        self._sleep(min((t for t in (next_us, wake) if t is not None), default=None))
        yield self._frame(key, out)

    def _frame(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["key", *self.out])

    def close(self) -> None:
        pass


class _Row:
    """A waiting row with its fields as attributes."""

    __slots__ = ("names", "values")

    def __init__(self, names: list[str], values: tuple):
        self.names, self.values = names, tuple(values)

    def __getattr__(self, name: str) -> Any:
        return self.values[self.names.index(name)]


def in_time_order(rows: DataFrame, state: str, out: str, fold: Callable, tick: Callable | None = None, wake: Callable | None = None, delay: str = "1 hour") -> DataFrame:
    """key and the out columns of a fold over each key's rows (key, ts, attempt_id, ...).

    fold(state or None, row) and tick(state, now_us) return the new state and rows of output; wake(state) names the time
    (microseconds) at which tick must run even if no row comes. Rows reach the fold with their columns and ts_us.
    """
    timed = rows.withColumn("ts_us", F.unix_micros("ts")).withWatermark("ts", delay)
    waiting = {f.name: f.dataType.simpleString() for f in timed.schema.fields if f.name not in ("key", "ts")}
    processor = InTimeOrder(waiting, state, StructType.fromDDL(out).names, fold, tick, wake)
    return timed.select("key", *waiting, "ts").groupBy("key").transformWithStateInPandas(processor, f"key string, {out}", "Append", "EventTime")
