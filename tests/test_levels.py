"""Level search over trees of block extremes and hull tests of lines, next to plain scans."""

import numpy as np
import pandas as pd
import pytest
from models import hierarchy as plain_hierarchy, pivots as plain_pivots, random_walk
from pyspark.sql import functions as F

from tickloom.operators.bars import with_bar_index
from tickloom.operators.hierarchy import fan_status, fans, hierarchy
from tickloom.operators.hulls import _chain, crossed_blocks, hulls, in_blocks
from tickloom.operators.levels import level_tree, nearest_below
from tickloom.plans.studies import angle_events, angle_setups
from tickloom.session import settle

LEVELS = "symbol string, run long, near double, far struct<score:double,early:bigint,point:bigint>, point long"


def level_rows(symbol, prices):
    """Numbers in turn near and far levels, as pivots alternate."""
    return [(symbol, k, float(p) if k % 2 else None, None if k % 2 else (float(p), -k, k), k) for k, p in enumerate(prices)]


@pytest.mark.parametrize("fanout", [2, 5, 32])
def test_nearest_below(spark, fanout):
    r = np.random.default_rng(fanout)
    prices = {"walk": np.cumsum(r.normal(size=500)).round(1), "flat": np.full(70, 3.0), "fall": -np.arange(300.0), "one": np.array([1.0])}
    tables = level_tree(spark.createDataFrame([x for s, p in prices.items() for x in level_rows(s, p)], LEVELS), ["symbol"], fanout)
    asked = [(s, n, int(r.integers(0, len(p))), float(r.choice(p) + r.choice([0, 0.1, 3, 40]))) for s, p in prices.items() for n in range(150)]
    probes = spark.createDataFrame(asked, "symbol string, n long, last_run long, value double")
    found = {(x.symbol, x.n): (x.near.id if x.near else None, x.far.point if x.far else None) for x in nearest_below(probes, tables, ["symbol"], fanout).collect()}
    assert len(found) == len(asked)
    for s, n, last, value in asked:
        p = prices[s]
        near = next((k for k in range(last, -1, -1) if k % 2 and p[k] < value), None)
        after = [k for k in range((near or 0) + 1, last + 1) if not k % 2] if near is not None else []
        assert found[s, n] == (near, max(after, key=lambda k: (p[k], -k)) if after else None)


def zigzag(n, slope):
    """Bars of a V (falling, then rising) in short swings."""
    base = np.concatenate((1000 - slope * np.arange(n // 2), 1000 - slope * np.arange(n // 2, 0, -1)))
    close = (base + 3 * np.sin(np.arange(n) * 2.1)).round(2)
    return pd.DataFrame({"symbol": "v", "epoch": 60 * np.arange(n), "open": close, "high": close + 0.25, "low": close - 0.25, "close": close, "volume": 1.0})


def test_a_v_is_linear_in_its_pivots(spark):
    """After a fall that is made good the levels lie as far back as its mirror image; tables and paths stay linear all the same."""
    walk = zigzag(2600, 0.4)
    confirmed, seen = plain_pivots(walk, 1, 1)
    levels = [("v", k, p["price"] if p["type"] == "low" else None, None if p["type"] == "low" else (p["price"], -k, k), k) for k, p in enumerate(confirmed)]
    tables = level_tree(spark.createDataFrame(levels, LEVELS), ["symbol"], 32)
    assert len(confirmed) > 20 * 32 and sum(t.count() for t in tables) <= len(confirmed) / 32 * 1.1 + 2
    got = {r["bar_index"]: r for r in hierarchy(settle(with_bar_index(spark.createDataFrame(walk))), 1, 1).collect()}
    far_back = 0
    for i in range(0, len(walk), 13):
        visible = [p for p in confirmed if p["confirm_index"] <= i]
        if not visible:
            continue
        context = "bullish" if seen[i]["type"] == "low" else "bearish"
        anchor, far, near, _ = plain_hierarchy(float(walk["close"][i]), context, visible)
        time = lambda p: p["epoch"] if p else None
        assert [time(got[i][c]) for c in ("anchor", "outer_from", "outer_to")] == [time(anchor), time(far), time(near)]
        far_back += near is not None and i - near["bar_index"] > 1000
    assert far_back > 20


@pytest.mark.parametrize("fanout", [2, 7])
def test_hierarchy_over_deep_trees(spark, fanout):
    walk = random_walk(symbols=4, n=500, seed=5, base=100.0, step=1.5)
    walk[["open", "high", "low", "close"]] = walk[["open", "high", "low", "close"]].round(0)
    got = {(r["symbol"], r["bar_index"]): r for r in hierarchy(settle(with_bar_index(spark.createDataFrame(walk))), 2, 2, fanout).collect()}
    inner_seen, time = 0, lambda p: p["epoch"] if p else None
    for s, g in walk.groupby("symbol"):
        g = g.reset_index(drop=True)
        confirmed, seen = plain_pivots(g, 2, 2)
        for i in range(len(g)):
            visible = [p for p in confirmed if p["confirm_index"] <= i]
            assert bool(visible) == ((s, i) in got)
            if visible:
                r = got[s, i]
                anchor, far, near, inner = plain_hierarchy(float(g["close"][i]), r["context"], visible)
                assert [time(r[c]) for c in ("origin", "anchor", "outer_from", "outer_to")] == [time(seen[i]), time(anchor), time(far), time(near)]
                assert [p["epoch"] for p in r["inner"]] == [p["epoch"] for p in inner]
                inner_seen += bool(inner)
    assert inner_seen > 5


def test_hierarchy_of_no_bars(spark):
    none = spark.createDataFrame([], "symbol string, epoch long, open double, high double, low double, close double, volume double")
    assert hierarchy(with_bar_index(none)).count() == 0


def test_hull_holds_the_extremes_of_every_line():
    r = np.random.default_rng(2)
    for _ in range(50):
        points = [{"epoch": int(t), "close": float(c)} for t, c in zip(np.cumsum(r.integers(1, 9, 60)), r.normal(size=60).cumsum().round(1), strict=True)]
        lower, upper = _chain(points, 1.0), _chain(points, -1.0)
        for slope in r.normal(size=20):
            value = lambda p, m=slope: p["close"] - m * p["epoch"]
            assert min(map(value, lower)) == pytest.approx(min(map(value, points))) and max(map(value, upper)) == pytest.approx(max(map(value, points)))


def test_blocks_that_lines_cross(spark):
    """Bursts, gaps and missing closes: every block with a bar in a line's time is met once, whatever the spacing."""
    times = [*range(0, 1000, 3), *range(50_000, 50_500), *range(10**6, 10**6 + 300 * 600, 600)]
    rows = [("a", k, t, None if k % 50 == 0 else float(t % 7)) for k, t in enumerate(times)] + [("b", 0, 5, 1.0), ("c", 0, 7, None)]
    blocked = settle(in_blocks(spark.createDataFrame(rows, "symbol string, bar_index long, epoch long, close double"), 64))
    found = settle(hulls(blocked))
    assert {r.symbol for r in found.collect()} == {"a", "b"} and blocked.groupBy("symbol", "block").count().agg({"count": "max"}).first()[0] <= 64
    r = np.random.default_rng(0)
    spans = [("a", n, int(a), int(a + r.choice([0, 5, 3000, 10**6]))) for n, a in enumerate(r.integers(-100, 1_200_000, 200))] + [("b", 500, 5, 5), ("b", 501, 6, 9), ("c", 502, 0, 9), ("z", 503, 0, 9)]
    met = crossed_blocks(spark.createDataFrame(spans, "symbol string, n long, since long, until long"), found, F.col("since"), F.col("until"))
    got = sorted((x.n, x.block, x.whole) for x in met.collect())
    want = []
    for s, n, a, b in spans:
        by_block = {}
        for symbol, k, t, close in rows:
            if symbol == s and close is not None:
                by_block.setdefault(k // 64, []).append(t)
        # a block counts by the span of its bars
        want += [(n, k, a <= min(v) and max(v) <= b) for k, v in by_block.items() if min(v) <= b and max(v) >= a]
    assert got == sorted(want)


@pytest.mark.parametrize("rows", [4, 64, 4096])
def test_fan_status_does_not_depend_on_blocks(spark, rows):
    walk = random_walk(symbols=2, n=400, seed=21, step=2.0)
    bars = settle(with_bar_index(spark.createDataFrame(walk)))
    lines = settle(fans(hierarchy(bars, 1, 1)))
    found = {(r.symbol, r.fan_id): (r.completed_epoch, r.status) for r in fan_status(bars, lines, 30_000, rows).collect()}
    groups, want = {s: g for s, g in walk.groupby("symbol")}, {}
    by_fan = {}
    for r in lines.where("fraction IS NOT NULL").collect():
        by_fan.setdefault((r.symbol, r.fan_id), []).append(r)
    for (s, fan), parts in by_fan.items():
        one = parts[0]
        g = groups[s]
        live = g[(g["epoch"] >= max(one.drawn_epoch, one.start_time)) & (g["epoch"] <= one.end_time + 30_000)]
        done = None
        for t, close in zip(live["epoch"].tolist(), live["close"].tolist(), strict=True):
            at = [p.start_price + (t - p.start_time) / max(1, p.end_time - p.start_time) * (p.end_price - p.start_price) for p in parts]
            if all(close < x if one.rising else close > x for x in at):
                done = t
                break
        want[s, fan] = (one.drawn_epoch, "inactive") if not len(live) else (done, "covered" if done is not None else "open")
    assert found == want and {v[1] for v in want.values()} >= {"covered", "open"}


def test_opened_blocks_are_few(spark):
    """A line far from the closes opens none of their blocks, and touches do not depend on block sizes."""
    walk = random_walk(symbols=2, n=900, seed=4, step=1.0)
    bars = settle(with_bar_index(spark.createDataFrame(walk)))
    setups = settle(angle_setups(bars, 5))
    events = {n: sorted(str(tuple(r)) for r in angle_events(bars, setups, 0.1, rows=n).drop("details").collect()) for n in (8, 256, 10**6)}
    assert events[8] == events[256] == events[10**6] and len(events[8]) > 5
    far = setups.withColumn("lines", F.transform("lines", lambda x: x.withField("start_price", x["start_price"] + 1e6).withField("end_price", x["end_price"] + 1e6)))
    plan = angle_events(bars, far.withColumn("horizontal_target", F.lit(1e9)), 0.1, rows=8)
    assert plan.count() == 0
