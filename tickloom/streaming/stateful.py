"""Per-symbol state machines: strategy steps, pivots, positions, replay progress.

Each keeps a few numbers per key in the state store, so a bar is handled once. Rows of a key must
arrive in time order across micro-batches; within one they are sorted here.
"""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tickloom.operators.hierarchy import select
from tickloom.plans.strategies import EmaBreakout, EmaRules

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STEP_SCHEMA = "symbol string, epoch long, bar_index long, action string, reason string, stop_loss double, target double"
PIVOT_SCHEMA = "symbol string, bar_index long, epoch long, type string, price double, confirm_index long"
HIERARCHY_STEP_SCHEMA = (
    "symbol string, epoch long, bar_index long, context string, origin_epoch long, anchor_epoch long, "
    "outer_from long, outer_to long, inner_from array<bigint>"
)
POSITION_SCHEMA = "session string, symbol string, strategy string, epoch long, price double, label string, pnl double"
PROGRESS_SCHEMA = "symbol string, after_epoch long, until_epoch long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _JsonState(StatefulProcessor):
    """A processor whose whole memory is one JSON value per key; ``advance`` maps sorted rows to rows."""

    order = "epoch"
    keys: tuple[str, ...] = ("symbol",)
    columns: tuple[str, ...] = ()

    def init(self, handle) -> None:
        self._value = handle.getValueState("memory", "json string")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        memory = json.loads(self._value.get()[0]) if self._value.exists() else None
        memory, out = self.advance(key, batch, memory)
        self._value.update((json.dumps(memory),))
        yield pd.DataFrame(out, columns=list(self.columns))

    def close(self) -> None:
        pass


class OrderedSteps(StatefulProcessor):
    """Steps over bars that arrive out of order: held in time buckets until the watermark has passed them, then advanced bucket by bucket.

    State per key is one map entry per bucket that still waits, the memory of the steps, and a timer per bucket; input is taken frame by frame and no more than a
    bucket is in memory. Rows in which all but key and time are null only move the watermark on. Rows later than the watermark are dropped by Spark, so a result is that of the
    rows in order as long as none is later than the delay.
    """

    def __init__(self, steps: _JsonState, bucket_seconds: int):
        self._steps, self._size = steps, bucket_seconds

    def init(self, handle) -> None:
        self._handle = handle
        self._memory = handle.getValueState("memory", "json string")
        self._held = handle.getMapState("held", "bucket long", "json string")

    def handleInputRows(self, key, rows, timerValues):
        time = self._steps.order
        for frame in rows:
            frame = frame.drop(columns=["ts_"])
            values = [c for c in frame.columns if c != time and c not in self._steps.keys]
            frame = frame.dropna(subset=values, how="all") if values else frame
            for bucket, own in frame.groupby(frame[time] // self._size):
                at = (int(bucket),)
                held = json.loads(self._held.getValue(at)[0]) if self._held.containsKey(at) else None
                if held is None:
                    self._handle.registerTimer((int(bucket) + 1) * self._size * 1000)
                    held = {c: [] for c in own.columns}
                for c in own.columns:
                    held[c].extend(own[c].tolist())
                self._held.updateValue(at, (json.dumps(held),))
        yield pd.DataFrame([], columns=list(self._steps.columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted(k[0] for k in self._held.keys() if (k[0] + 1) * self._size * 1000 <= passed)
        memory = json.loads(self._memory.get()[0]) if self._memory.exists() else None
        for bucket in due:
            batch = pd.DataFrame(json.loads(self._held.getValue((bucket,))[0])).sort_values(self._steps.order, kind="stable")
            memory, out = self._steps.advance(key, batch, memory)
            self._held.removeKey((bucket,))
            if out:
                yield pd.DataFrame(out, columns=list(self._steps.columns))
        if due:
            self._memory.update((json.dumps(memory),))

    def close(self) -> None:
        pass


class EmaSteps(_JsonState):
    """Alert-candle breakout, bar by bar: average, previous bar, alerts and position are the memory."""

    columns = ("symbol", "epoch", "bar_index", "action", "reason", "stop_loss", "target")

    def __init__(self, params: EmaBreakout = EmaBreakout()):
        self._params = asdict(params)

    def advance(self, key, batch, memory):
        params = EmaBreakout(**self._params)
        alpha = 2.0 / (params.ema_period + 1.0)
        memory = memory or {"n": 0, "ema": None, "prev": None, "rules": None}
        rules, out = EmaRules(params, memory["rules"]), []
        ema, prev, n = memory["ema"], memory["prev"], memory["n"]
        for bar in batch.itertuples(index=False):
            close, high, low = float(bar.close), float(bar.high), float(bar.low)
            before = ema
            ema = close if ema is None else alpha * close + (1.0 - alpha) * ema
            prev_high, prev_low = prev or (None, None)
            above = prev is not None and prev_low > before
            below = prev is not None and prev_high < before
            signal = rules.step(n, high, low, close, ema, prev_high, prev_low, above, below)
            if signal is not None:
                out.append((key[0], int(bar.epoch), n, *signal))
            prev, n = (high, low), n + 1
        return {"n": n, "ema": ema, "prev": prev, "rules": rules.memory}, out


class PivotSteps(_JsonState):
    """Alternating pivots as they are confirmed; memory is the last bars and the current extreme."""

    columns = ("symbol", "bar_index", "epoch", "type", "price", "confirm_index")

    def __init__(self, left: int = 5, right: int = 5):
        self._left, self._right = left, right

    def advance(self, key, batch, memory):
        memory = memory or {"n": 0, "bars": [], "last": None}
        bars, n, last, out = memory["bars"], memory["n"], memory["last"], []
        size = self._left + self._right + 1
        for bar in batch.itertuples(index=False):
            bars.append((int(bar.epoch), float(bar.high), float(bar.low)))
            bars, n = bars[-size:], n + 1
            if len(bars) < size:
                continue
            for kind, price in self._found(bars):
                pivot = {"at": n - 1 - self._right, "epoch": bars[self._left][0], "type": kind, "price": price}
                if last is None:
                    last = pivot
                elif last["type"] == kind:
                    beyond = price > last["price"] if kind == "high" else price < last["price"]
                    last = pivot if beyond else last
                else:
                    out.append((key[0], last["at"], last["epoch"], last["type"], last["price"], n - 1))
                    last = pivot
        return {"n": n, "bars": bars, "last": last}, out

    def _found(self, bars):
        middle = bars[self._left]
        others = bars[: self._left] + bars[self._left + 1 :]
        if all(b[1] < middle[1] for b in others):
            yield "high", middle[1]
        if all(b[2] > middle[2] for b in others):
            yield "low", middle[2]


class HierarchySteps(_JsonState):
    """Pivot hierarchy of every arriving bar; memory is the pivot state and the pivots still in reach.

    A close finds no level before the latest of the lowest lows (nor, upwards, before the latest of
    the highest highs), so pivots older than both can never matter again and are dropped.
    """

    columns = ("symbol", "epoch", "bar_index", "context", "origin_epoch", "anchor_epoch", "outer_from", "outer_to", "inner_from")

    def __init__(self, left: int = 5, right: int = 5):
        self._pivots = PivotSteps(left, right)

    def advance(self, key, batch, memory):
        memory = memory or {"pivots": None, "reach": []}
        state, reach, out = memory["pivots"], memory["reach"], []
        for i in range(len(batch)):
            bar = batch.iloc[i : i + 1]
            state, confirmed = self._pivots.advance(key, bar, state)
            reach.extend(confirmed_row[2:5] for confirmed_row in confirmed)
            if not reach:
                continue
            now = bar.iloc[0]
            context = "bullish" if state["last"]["type"] == "low" else "bearish"
            times, kinds, prices = (np.array([p[j] for p in reach], dtype=t) for j, t in ((0, "int64"), (1, object), (2, float)))
            anchor, far, near, inner = select(float(now["close"]), context, kinds, prices, times)
            at = lambda j: None if j is None else int(times[j])
            out.append(
                (key[0], int(now["epoch"]), state["n"] - 1, context, state["last"]["epoch"], at(anchor), at(far), at(near), [at(j) for j in inner])
            )
        return {"pivots": state, "reach": self._prune(reach)}, out

    def _prune(self, reach):
        newest_extreme = len(reach)
        for kind, sign in (("low", 1.0), ("high", -1.0)):
            found = [(sign * p[2], -i) for i, p in enumerate(reach) if p[1] == kind]
            if found:
                newest_extreme = min(newest_extreme, -min(found)[1])
        return [list(p) for p in reach[min(newest_extreme, len(reach) - 1) :]] if reach else []


class PositionSteps(_JsonState):
    """Open position per (session, symbol, strategy): entries open it, exits book exit - entry."""

    keys = ("session", "symbol", "strategy")
    columns = ("session", "symbol", "strategy", "epoch", "price", "label", "pnl")

    def advance(self, key, batch, memory):
        held, out = (memory or {"held": None})["held"], []
        for s in batch.itertuples(index=False):
            label, price, pnl = s.signal_label, float(s.signal_price), None
            if "Buy" in label and ("CE" in label or "PE" in label):
                held = price
            elif "Exit" in label and held is not None:
                pnl, held = price - held, None
                label = f"{label} (PnL: {pnl:+.2f})"
            out.append((*key, int(s.epoch), price, label, pnl))
        return {"held": held}, out


class ProgressSteps(_JsonState):
    """How far each symbol's stream time moved in this micro-batch."""

    columns = ("symbol", "after_epoch", "until_epoch")

    def advance(self, key, batch, memory):
        reached, now = (memory or {"epoch": -1})["epoch"], int(batch["epoch"].max())
        return {"epoch": max(now, reached)}, [(key[0], reached, now)] if now > reached else []


def run_steps(stream: DataFrame, keys: list[str], steps: _JsonState, schema: str, delay: str | None = None, bucket_seconds: int = 86400) -> DataFrame:
    """Apply a processor per key; needs the RocksDB state store (``use_rocksdb``).

    With a ``delay`` bars may come out of order by as much: they are held in buckets of ``bucket_seconds`` until the watermark passes (``OrderedSteps``), so results
    come that much later. Without one, rows of a key must come in time order.
    """
    if delay is None:
        return stream.groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=steps, outputStructType=schema, outputMode="append", timeMode="none"
        )
    timed = stream.withColumn("ts_", F.timestamp_seconds(steps.order)).withWatermark("ts_", delay)
    return timed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=OrderedSteps(steps, bucket_seconds), outputStructType=schema, outputMode="append", timeMode="eventTime"
    )


def strategy_steps(bars: DataFrame, params: EmaBreakout = EmaBreakout(), delay: str | None = None) -> DataFrame:
    return run_steps(bars, ["symbol"], EmaSteps(params), STEP_SCHEMA, delay)


def pivot_steps(bars: DataFrame, left: int = 5, right: int = 5, delay: str | None = None) -> DataFrame:
    return run_steps(bars, ["symbol"], PivotSteps(left, right), PIVOT_SCHEMA, delay)


def hierarchy_steps(bars: DataFrame, left: int = 5, right: int = 5, delay: str | None = None) -> DataFrame:
    return run_steps(bars, ["symbol"], HierarchySteps(left, right), HIERARCHY_STEP_SCHEMA, delay)


def position_steps(signals: DataFrame, delay: str | None = None) -> DataFrame:
    return run_steps(signals, ["session", "symbol", "strategy"], PositionSteps(), POSITION_SCHEMA, delay)


def due_trades(bars: DataFrame, trades: DataFrame, delay: str | None = None) -> DataFrame:
    """Each known trade once, in the micro-batch whose bars reach its time; with a ``delay``, when a timer releases them.

    A symbol's stream moves over disjoint ranges, so a trade falls into exactly one of them.
    """
    moved = run_steps(bars, ["symbol"], ProgressSteps(), PROGRESS_SCHEMA, delay)
    return moved.join(trades, "symbol").where(
        (F.col("epoch") > F.col("after_epoch")) & (F.col("epoch") <= F.col("until_epoch"))
    )
