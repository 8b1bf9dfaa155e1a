import numpy as np
import pandas as pd
import pytest
from models import random_walk
from pyspark.sql import functions as F

from tickloom.operators.asof import backward, nearest
from tickloom.operators.bars import with_bar_index
from tickloom.operators.blocks import framed, index_rows, running
from tickloom.operators.indicators import close_streak, donchian, ema, momentum, rsi


@pytest.fixture(scope="module")
def walk():
    return random_walk()


@pytest.fixture(scope="module")
def bars(spark, walk):
    return with_bar_index(spark.createDataFrame(walk)).cache()


def sorted_pdf(df):
    return df.toPandas().sort_values(["symbol", "epoch"]).reset_index(drop=True)


def per_symbol(walk, fn):
    return pd.concat([fn(g.reset_index(drop=True)) for _, g in walk.groupby("symbol")], ignore_index=True)


def test_index_counts_across_chunks(spark, walk):
    out = sorted_pdf(index_rows(spark.createDataFrame(walk), chunk_seconds=600))
    assert out["bar_index"].tolist() == walk.groupby("symbol").cumcount().tolist()


def test_running_equals_whole_window(bars, walk, small_blocks):
    x = F.when(F.col("bar_index") % 7 == 3, F.col("close"))
    out = sorted_pdf(
        running(bars, {"s": ("sum", F.col("close")), "m": ("max", F.col("high")), "l": ("last", x), "n": ("next", x), "c": ("count", x)})
    )

    def model(g):
        v = g["close"].where(g.index % 7 == 3)
        return pd.DataFrame({"s": g["close"].cumsum(), "m": g["high"].cummax(), "l": v.ffill(), "n": v.bfill(), "c": v.notna().cumsum()})

    want = per_symbol(walk, model)
    for c in want:
        np.testing.assert_allclose(out[c].to_numpy(float), want[c].to_numpy(float))


def test_running_exclusive(bars, walk, small_blocks):
    out = sorted_pdf(running(bars, {"s": ("sum", F.col("close"))}, inclusive=False))
    want = per_symbol(walk, lambda g: (g["close"].cumsum() - g["close"]).to_frame("s"))
    np.testing.assert_allclose(out["s"], want["s"], atol=1e-6)


def test_frames_cross_block_edges(bars, walk, small_blocks):
    def add(df, w):
        return df.withColumns({"a": F.max("high").over(w.rowsBetween(1, 4)), "b": F.min("low").over(w.rowsBetween(-6, 0))})

    out = sorted_pdf(framed(bars, 6, 4, add))
    assert len(out) == len(walk)
    want = per_symbol(
        walk,
        lambda g: pd.DataFrame({"a": g["high"][::-1].rolling(4, min_periods=1).max()[::-1].shift(-1), "b": g["low"].rolling(7, min_periods=1).min()}),
    )
    np.testing.assert_allclose(out["a"].to_numpy(float), want["a"].to_numpy(float))
    np.testing.assert_allclose(out["b"], want["b"])


def test_channel(bars, walk, small_blocks):
    out = sorted_pdf(donchian(bars, 3))
    want = per_symbol(walk, lambda g: g["high"].rolling(3).max().shift(1).to_frame("hh"))
    np.testing.assert_allclose(out["hh"].to_numpy(float), want["hh"].to_numpy(float))


@pytest.mark.parametrize("span", [5, 9, 21, 200])
def test_ema_matches_ewm(bars, walk, small_blocks, span):
    out = sorted_pdf(ema(bars, {"e": span}))
    want = per_symbol(walk, lambda g: g["close"].ewm(span=span, adjust=False).mean().to_frame("e"))
    np.testing.assert_allclose(out["e"], want["e"], rtol=1e-13)


def test_rsi(bars, walk, small_blocks):
    def model(g):
        d = g["close"].diff()
        gain, loss = d.clip(lower=0).fillna(0).rolling(14).mean(), (-d.clip(upper=0)).fillna(0).rolling(14).mean()
        return (100 - 100 / (1 + gain / loss)).to_frame("rsi")

    out, want = sorted_pdf(rsi(bars)), per_symbol(walk, model)
    np.testing.assert_allclose(out["rsi"].to_numpy(float), want["rsi"].to_numpy(float), atol=1e-8)


def test_streak(bars, walk, small_blocks):
    out = sorted_pdf(close_streak(bars))
    for _, g in out.groupby("symbol"):
        close = g["close"].tolist()
        for i, (up, down) in enumerate(zip(g["up_streak"], g["down_streak"])):
            kept = close[max(0, i - 9) : i + 1]
            n = 0
            while n < len(kept) - 1 and kept[-1 - n] > kept[-2 - n]:
                n += 1
            m = 0
            while m < len(kept) - 1 and kept[-1 - m] < kept[-2 - m]:
                m += 1
            assert (up, down) == (n, m)


def test_momentum_is_empty_before_the_slow_span(bars, small_blocks):
    out = sorted_pdf(momentum(bars))
    early = out[out["bar_index"] < 21]
    assert early["overall_momentum"].isna().all() and (early["confidence"] == 0).all()
    assert set(out.loc[out["bar_index"] >= 21, "confidence"]) <= {0.5, 1.0}


def test_nearest_and_backward(spark):
    rng = np.random.default_rng(3)
    series = pd.DataFrame({"k": ["a"] * 80 + ["b"] * 40, "epoch": np.r_[np.sort(rng.choice(20000, 80, False)), np.sort(rng.choice(20000, 40, False))]})
    series["v"] = np.arange(120.0)
    probes = pd.DataFrame({"k": rng.choice(["a", "b", "none"], 300), "epoch": rng.integers(0, 20000, 300), "id": range(300)})
    left, right = spark.createDataFrame(probes), spark.createDataFrame(series)
    got = nearest(left, right, ["k"], ["v"], width=500).toPandas().set_index("id").sort_index()
    back = backward(left, right, ["k"], ["v"], width=500).toPandas().set_index("id").sort_index()
    for p in probes.itertuples():
        s = series[series["k"] == p.k]
        if s.empty:
            assert np.isnan(got.loc[p.id, "near_v"])
            continue
        best = min(s.itertuples(), key=lambda r: (abs(r.epoch - p.epoch), r.epoch))
        assert got.loc[p.id, "near_v"] == best.v
        earlier = s[s["epoch"] <= p.epoch]
        assert (np.isnan(back.loc[p.id, "asof_v"]) and earlier.empty) or back.loc[p.id, "asof_v"] == earlier["v"].iloc[-1]
