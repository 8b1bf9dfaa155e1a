import numpy as np
import pandas as pd
import pytest
from models import greedy, hierarchy as plain_hierarchy, ledger as plain_ledger, ema_signals as plain_ema, pivots as plain_pivots, random_walk

from tickloom.operators.bars import with_bar_index
from tickloom.operators.hierarchy import hierarchy
from tickloom.operators.ledger import close_at_end, trade_metrics, trades
from tickloom.operators.pivots import confirmed_pivots, pivot_pairs, symmetric_pivots
from tickloom.plans.registry import generate
from tickloom.plans.strategies import EmaBreakout, breakout_signals, ema_breakouts, level_touches, spaced_entries, square_signals
from tickloom.plans.studies import angle_setups
from tickloom.session import settle


@pytest.fixture(scope="module")
def walk():
    return random_walk(symbols=3, n=400, seed=11)


@pytest.fixture(scope="module")
def bars(spark, walk):
    return settle(with_bar_index(spark.createDataFrame(walk)))


def groups(walk):
    return [(s, g.reset_index(drop=True)) for s, g in walk.groupby("symbol")]


def test_alternating_pivots(bars, walk, small_blocks):
    got = {tuple(r) for r in confirmed_pivots(bars, 3, 4).select("symbol", "bar_index", "type", "price", "confirm_index").collect()}
    want = {(s, p["bar_index"], p["type"], p["price"], p["confirm_index"]) for s, g in groups(walk) for p in plain_pivots(g, 3, 4)[0]}
    assert got == want and len(want) > 50


def test_hierarchy_over_many_blocks(spark, small_blocks):
    # whole prices: an inner sequence needs a close equal to its anchor, or the anchor is the outer level
    walk = random_walk(symbols=4, n=400, seed=3, base=100.0, step=1.5)
    walk[["open", "high", "low", "close"]] = walk[["open", "high", "low", "close"]].round(0)
    bars = settle(with_bar_index(spark.createDataFrame(walk)))
    got = {(r["symbol"], r["bar_index"]): r for r in hierarchy(bars, 2, 2).collect()}
    time = lambda p: p["epoch"] if p else None
    checked = 0
    for s, g in groups(walk):
        confirmed, seen = plain_pivots(g, 2, 2)
        for i in range(len(g)):
            visible = [p for p in confirmed if p["confirm_index"] <= i]
            if not visible:
                assert (s, i) not in got
                continue
            context = "bullish" if seen[i]["type"] == "low" else "bearish"
            anchor, far, near, inner = plain_hierarchy(float(g["close"][i]), context, visible)
            r = got[(s, i)]
            assert r["context"] == context
            assert [time(r[c]) for c in ("origin", "anchor", "outer_from", "outer_to")] == [time(seen[i]), time(anchor), time(far), time(near)]
            assert [p["epoch"] for p in r["inner"]] == [p["epoch"] for p in inner]
            checked += len(inner) > 0
    assert checked > 5


def test_channel_breakouts_alternate(bars, walk, small_blocks):
    got = {(r["symbol"], r["bar_index"]): r["signal"] for r in breakout_signals(bars, 3).collect()}
    want = {}
    for s, g in groups(walk):
        held = False
        for i in range(4, len(g)):
            top, bottom = g["high"][i - 3 : i].max(), g["low"][i - 3 : i].min()
            if not held and g["close"][i] > top:
                want[(s, i)], held = 1, True
            elif held and g["close"][i] < bottom:
                want[(s, i)], held = -1, False
    assert got == want and len(want) > 30


@pytest.mark.parametrize("gap", [1, 3, 6, 40])
def test_spaced_entries(spark, small_blocks, gap):
    rows = [("a", i) for i in range(0, 300) if i % 5 in (0, 1)] + [("b", i) for i in (2, 3, 17, 18, 90, 250, 255)]
    touches = spark.createDataFrame(rows, "symbol string, bar_index long")
    got = sorted(tuple(r) for r in spaced_entries(touches, gap).select("symbol", "bar_index").collect())
    want = sorted((s, t) for s in "ab" for t in greedy([i for k, i in rows if k == s], gap))
    assert got == want


def test_spaced_entries_over_a_thousand_blocks(spark):
    """Tables are composed over a tree of four a node; stretches without a touch lie between blocks."""
    rng = np.random.default_rng(6)
    at = {"a": sorted(rng.choice(7000, 2500, replace=False).tolist()), "b": [0, 6999], "c": [*range(0, 5000, 7), *range(6000, 6500)]}
    rows = [(s, t) for s, found in at.items() for t in found]
    touches = settle(spark.createDataFrame(rows, "symbol string, bar_index long").repartition(4))
    got = sorted(tuple(r) for r in spaced_entries(touches, 6, rows=7, fanout=4).collect())
    assert got == sorted((s, t) for s, found in at.items() for t in greedy(found, 6))
    assert spaced_entries(touches.where("symbol = 'z'"), 6).collect() == []


def test_square_strategy(bars, walk, small_blocks):
    got = {(r["symbol"], r["bar_index"]): r["signal"] for r in square_signals(bars, 0.004, 5).collect()}
    touches = {}
    for r in level_touches(bars, 0.004).select("symbol", "bar_index").collect():
        touches.setdefault(r[0], []).append(r[1])
    want = {}
    for s, g in groups(walk):
        for i in greedy(touches.get(s, []), 6):
            want[(s, i)] = 1
            if i + 5 < len(g):
                want[(s, i + 5)] = -1
    assert got == want and want


@pytest.mark.parametrize("validity", [1, 3])
def test_ema_rules_over_segments(bars, walk, small_blocks, validity):
    out = ema_breakouts(bars, {"p": EmaBreakout(alert_validity_bars=validity)})
    got = sorted(tuple(r) for r in out.select("symbol", "bar_index", "action").collect())
    want = sorted((s, i, a) for s, g in groups(walk) for i, a in plain_ema(g, validity=validity))
    assert got == want and len(want) > 30


LABELS = [
    "", "Buy 100 CE (16-Jan) | SL:90", "Buy 100 PE (16-Jan) | SL:90", "Exit Long (EMA Touch)", "Exit Short (EMA Touch)",
    "Exit (Time-based)", "Buy 3-Bar Breakout", "Sell (Stop Loss)", "Buy 100 CE (16-Jan) Exit Short", "Buy 100 PE (16-Jan) Exit Long",
]


@pytest.mark.parametrize("labels", [LABELS[:8], LABELS])
def test_ledger_with_any_labels(spark, small_blocks, labels):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [
        {
            "symbol": s, "epoch": 1000 + i * 60, "bar_index": i, "close": float(rng.integers(50, 150)), "signal": int(rng.choice([-1, 1])),
            "signal_price": float(rng.integers(1, 99)), "signal_label": str(rng.choice(labels)),
        }
        for s in "ab"
        for i in range(200)
    ]
    got = sorted((r["symbol"], r["epoch"], r["type"], r["price"], None if r["pnl"] is None else round(r["pnl"], 6)) for r in trades(spark.createDataFrame(rows)).collect())
    want = sorted((s, *t) for s in "ab" for t in plain_ledger([r for r in rows if r["symbol"] == s]))
    assert got == want


def test_metrics_of_no_sells_and_forced_close(spark):
    signals = spark.createDataFrame([("a", 60, 0, 10.0, 1, 10.0, "")], "symbol string, epoch long, bar_index long, close double, signal int, signal_price double, signal_label string")
    last = spark.createDataFrame([("a", 600, 9, 7.5)], "symbol string, epoch long, bar_index long, close double")
    ledger = trades(signals)
    m = trade_metrics(ledger).first()
    assert (m["total_trades"], m["completed_trades"], m["profit_factor"]) == (1, 0, 0.0)
    m = trade_metrics(close_at_end(ledger, last)).first()
    assert (m["losses"], m["total_pnl"], m["profit_factor"], m["win_rate"]) == (1, -2.5, 0.0, 0.0)


def test_setups(bars):
    pairs = pivot_pairs(settle(symmetric_pivots(bars, 5))).collect()
    assert pairs and all(p["first"]["epoch"] <= p["second"]["epoch"] for p in pairs)
    for s in angle_setups(bars, 5).collect():
        assert len(s["lines"]) == 5 and 0 <= s["angle_degrees"] <= 90
        assert s["full_coverage_target"] == s["first"]["price"]


def test_registry(bars):
    with pytest.raises(ValueError, match="available"):
        generate("nope", bars)
    with pytest.raises(ValueError, match="available"):
        generate("mechanical_3day", bars, span=1)
    assert generate("ichimoku_cloud", bars).where("signal <> 0").count() == 0
    assert pd.Series([r[0] for r in generate("mechanical_3day", bars, n=5).select("signal").collect()]).isin([1, -1]).all()


@pytest.mark.parametrize("mode", ["fixed", "trailing", "partial"])
def test_angle_rules_do_not_depend_on_blocks(bars, monkeypatch, mode):
    from tickloom.operators import blocks
    from tickloom.plans.angles import AngleTrading, angle_signals, angle_trades

    setups = settle(angle_setups(bars, 5))
    params = AngleTrading(tolerance=1.0, exit_mode=mode)
    found = {}
    for rows in (4096, 16):
        monkeypatch.setattr(blocks, "BLOCK_ROWS", rows)
        found[rows] = sorted(tuple(r) for r in angle_signals(bars, setups, params).collect())
    assert found[16] == found[4096] and len(found[16]) > 4
    actions = {r[3] for r in found[16]}
    assert actions <= {"enter_long", "enter_short", "exit_long", "exit_short"}
    closed = angle_trades(settle(angle_signals(bars, setups, params))).collect()
    assert closed and all(r["entry_price"] is not None for r in closed)


def test_fold_blocks_carries_state(spark):
    from tickloom.operators.folds import fold_blocks

    def step(memory, rows):
        total, out = (memory or {"t": 0})["t"], []
        for r in rows.itertuples(index=False):
            total += r.v
            out.append((r.symbol, int(r.bar_index), int(total)))
        return {"t": int(total)}, out

    df = settle(spark.range(100).selectExpr("'a' symbol", "id bar_index", "id v"))
    got = {r[1]: r[2] for r in fold_blocks(df, step, "symbol string, bar_index long, t long", rows=17).collect()}
    assert got == {i: i * (i + 1) // 2 for i in range(100)}
