"""The reorder buffer by itself: bars in any order within the delay give what bars in order give."""

import random

import pandas as pd
from models import pivots as plain_pivots, random_walk

from tickloom.streaming.stateful import OrderedSteps, PivotSteps


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Entries:
    def __init__(self):
        self.held = {}

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def keys(self):
        return iter(list(self.held))


class Handle:
    """State of one key, and its timers."""

    def __init__(self):
        self.timers, self.watermark, self.value, self.entries = [], 0, Value(), Entries()

    def getValueState(self, name, schema):
        return self.value

    def getMapState(self, name, key, schema):
        return self.entries

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def run(batches, steps, size):
    """Micro-batches of (frames, watermark after them); everything the steps give."""
    handle, out, most = Handle(), [], 0
    ordered = OrderedSteps(steps, size)
    ordered.init(handle)
    for frames, watermark in batches:
        for found in ordered.handleInputRows(("S0",), iter(frames), handle):
            out += found.itertuples(index=False, name=None)
        most = max(most, len(handle.entries.held))
        handle.watermark = watermark
        due, handle.timers = [t for t in handle.timers if t <= watermark], [t for t in handle.timers if t > watermark]
        for _ in due:
            for found in ordered.handleExpiredTimer(("S0",), handle, None):
                out += found.itertuples(index=False, name=None)
    return out, handle, most


def frame(rows):
    return pd.DataFrame(rows, columns=["symbol", "epoch", "open", "high", "low", "close", "volume"]).assign(ts_=None)


def test_any_order_within_the_delay():
    walk = random_walk(symbols=1, n=400, seed=3)
    confirmed, _ = plain_pivots(walk, 3, 3)
    want = [("S0", p["bar_index"], p["epoch"], p["type"], p["price"], p["confirm_index"]) for p in confirmed]
    rows, r = walk.to_dict("records"), random.Random(1)
    size, delay = 600, 6000
    # every bar comes up to the delay late
    arrivals = sorted(rows, key=lambda b: b["epoch"] + r.uniform(0, delay - size))
    batches = []
    for k in range(0, len(arrivals), 40):
        part = arrivals[k : k + 40]
        batches.append(([frame(part[:13]), frame(part[13:14]), frame(part[14:])], 1000 * (max(b["epoch"] for b in arrivals[: k + 40]) - delay)))
    beat = {"symbol": "S0", "epoch": rows[-1]["epoch"] + 10**6}
    batches.append(([frame([beat])], 1000 * (beat["epoch"] - delay)))
    out, handle, most = run(batches, PivotSteps(3, 3), size)
    assert out == want and len(want) > 30
    # nothing is left, and no more was held than the delay and a batch span
    assert not handle.entries.held and not handle.timers and most < len({b["epoch"] // size for b in rows}) / 2


def test_nothing_comes_before_the_watermark():
    walk = random_walk(symbols=1, n=60, seed=4)
    rows = walk.to_dict("records")
    out, handle, _ = run([([frame(rows)], 0)], PivotSteps(2, 2), 600)
    assert out == [] and handle.entries.held and not handle.value.exists()
