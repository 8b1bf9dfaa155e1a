"""Streamed folds: frames stay small, memories fade or are composed, and few rounds are needed."""

import numpy as np
import pandas as pd
import pytest
from models import ema_signals as plain_ema
from pyspark.sql import functions as F

from tickloom.operators import folds
from tickloom.operators.bars import with_bar_index
from tickloom.operators.folds import Summary, fold_blocks
from tickloom.plans.strategies import EmaBreakout, ema_breakouts
from tickloom.session import settle

SCHEMA = "symbol string, bar_index long, top double, n long"


def running_highest():
    """Running maximum and count, and its summary; the count makes every block's start differ from a guess. Local, so workers need no test module."""

    def highest(memory, rows):
        top, n, out = (memory or {"top": None})["top"], (memory or {"n": 0})["n"], []
        for r in rows.itertuples(index=False):
            top, n = r.v if top is None else max(top, r.v), n + 1
            out.append((r.symbol, int(r.bar_index), float(top), int(n)))
        return {"top": top, "n": n}, out

    summary = Summary(
        leave=lambda rows: [float(rows["v"].max()), len(rows)],
        compose=lambda a, b: [max(a[0], b[0]), a[1] + b[1]],
        enter=lambda memory, s: {"top": max(s[0], memory["top"]), "n": s[1] + memory["n"]} if memory else {"top": s[0], "n": s[1]},
    )
    return highest, summary


@pytest.fixture
def writes(monkeypatch):
    """Counts the tables a fold writes: one job each."""
    seen = []
    monkeypatch.setattr(folds, "settle", lambda df: seen.append(1) or settle(df))
    return seen


def series(spark, values_by_symbol):
    rows = [(s, k, float(v)) for s, values in values_by_symbol.items() for k, v in enumerate(values)]
    return settle(spark.createDataFrame(rows, "symbol string, bar_index long, v double").repartition(5))


def test_a_summary_needs_few_jobs(spark, writes):
    """A running maximum over a falling series, where the first value reaches through all 40 blocks, and a key with gaps between blocks."""
    highest, summary = running_highest()
    values = {"a": -np.arange(800.0), "b": np.sin(np.arange(100) * 0.7).round(3)}
    df = series(spark, values).where("symbol = 'a' OR bar_index < 30 OR bar_index >= 80")
    found = {(r[0], r[1]): (r[2], r[3]) for r in fold_blocks(df, highest, SCHEMA, rows=20, summary=summary).collect()}
    # two tables and the greatest block number before the result
    assert len(writes) == 2
    want = {}
    for s, v in values.items():
        kept = [k for k in range(len(v)) if s == "a" or k < 30 or k >= 80]
        for n, k in enumerate(kept):
            want[s, k] = (max(v[j] for j in kept[: n + 1]), n + 1)
    assert found == want


def test_a_chain_without_summary_is_exact(spark):
    highest, _ = running_highest()
    df = series(spark, {"a": -np.arange(90.0)})
    found = {r[1]: (r[2], r[3]) for r in fold_blocks(df, highest, SCHEMA, rows=15).collect()}
    assert found == {k: (0.0, k + 1) for k in range(90)}


def test_warm_up_spares_rounds(spark, writes):
    """A memory of the last three values is guessed exactly."""

    def last_three(memory, rows):
        kept, out = (memory or {"kept": []})["kept"], []
        for r in rows.itertuples(index=False):
            kept = [*kept, r.v][-3:]
            out.append((r.symbol, int(r.bar_index), float(max(kept)), len(kept)))
        return {"kept": kept}, out

    values = np.random.default_rng(1).normal(size=300).round(3)
    found = {r[1]: r[2] for r in fold_blocks(series(spark, {"a": values}), last_three, SCHEMA, rows=20, warm=5).collect()}
    assert len(writes) == 2 and found == {k: max(values[max(0, k - 2) : k + 1]) for k in range(300)}


def test_frames_stay_small(spark):
    """A block of 60,000 rows comes in frames of one batch."""

    def step(memory, rows):
        n = (memory or {"n": 0})["n"] + len(rows)
        return {"n": n}, [(rows["symbol"].iloc[0], int(rows["bar_index"].iloc[-1]), float(len(rows)), n)]

    df = settle(spark.range(60_000).selectExpr("'a' AS symbol", "id AS bar_index", "double(id) AS v"))
    batch = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    found = fold_blocks(df, step, SCHEMA, rows=10**6).collect()
    assert max(r.top for r in found) <= batch < 60_000 and max(r.n for r in found) == 60_000 and sum(r.top for r in found) == 60_000


def test_no_rows(spark):
    highest, summary = running_highest()
    none = spark.createDataFrame([], "symbol string, bar_index long, v double")
    assert fold_blocks(none, highest, SCHEMA).collect() == [] and fold_blocks(none, highest, SCHEMA, summary=summary).collect() == []


@pytest.mark.parametrize("validity", [3, 50])
def test_alert_candles_in_a_trend(spark, validity):
    """A symbol that climbs for thousands of bars, without the calm stretches in which nothing can be open."""
    r = np.random.default_rng(7)
    n = 6000
    close = np.exp(np.cumsum(np.where(r.random(n) < 0.9, 0.002, -0.004))) * 100
    open_ = np.concatenate(([100], close[:-1]))
    walk = pd.DataFrame({"symbol": "t", "epoch": 60 * np.arange(n), "open": open_, "high": np.maximum(open_, close) * 1.0002, "low": np.minimum(open_, close) * 0.9998, "close": close, "volume": 1.0})
    walk[["open", "high", "low", "close"]] = walk[["open", "high", "low", "close"]].round(4)
    bars = settle(with_bar_index(spark.createDataFrame(walk)))
    grid = {"p": EmaBreakout(alert_validity_bars=validity), "q": EmaBreakout(alert_validity_bars=validity, risk_reward_ratio=20.0)}
    out = ema_breakouts(bars, grid, rows=256)
    got = {name: sorted((x.bar_index, x.action) for x in out.where(F.col("param_id") == name).collect()) for name in grid}
    assert got == {"p": plain_ema(walk, validity=validity), "q": plain_ema(walk, validity=validity, reward=20.0)} and len(got["q"]) > 20
