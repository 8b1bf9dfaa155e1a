"""Signals to trades, and measures over trades.

Position keeping looks sequential but is a two-state machine: a signal row either may open, may
close, or both (then it flips the state). The state before a row is the last forced state plus
the parity of flips since, which is a running aggregate, so no symbol is folded in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.labels import BUY, SELL, classify, effective_price, pnl_suffix
from tickloom.operators.blocks import running
from tickloom.session import settle

CAPITAL = 100000.0


def trades(signals: DataFrame, convention: str = "engine") -> DataFrame:
    """Trade ledger of sparse signal rows (``symbol, epoch, bar_index, close, signal, ...``).

    Label rules come first, then plain BUY/SELL alternation. ``convention='engine'`` books shorts
    as entry - exit; ``'premium'`` books exit - entry for both sides (bought options).
    """
    flags = classify(F.coalesce("signal_label", F.lit("")))
    buy, sell = F.col("signal") == BUY, F.col("signal") == SELL
    short = sell & flags["is_short_entry"]
    opens = (buy & flags["is_long_entry"]) | short | (buy & ~flags["is_exit"])
    closes = (
        (sell & flags["is_long_exit"]) | (buy & flags["is_short_exit"]) | (sell & ~flags["is_entry"])
    )
    rows = settle(
        signals.where(buy | sell).select(
            "symbol",
            "epoch",
            "bar_index",
            effective_price(F.col("signal_price"), F.col("close")).alias("price"),
            F.coalesce("signal_label", F.lit("")).alias("label"),
            opens.alias("_opens"),
            closes.alias("_closes"),
            F.when(short, "short").otherwise("long").alias("_side"),
            buy.alias("_buy"),
        )
    )
    rows = _with_state(rows)
    state = F.col("_state")
    acted = rows.where(
        (F.col("_opens") & (state == 0)) | (F.col("_closes") & (state == 1))
    )
    acted = settle(acted.select("symbol", "epoch", "bar_index", "price", "label", "_side", "_buy", (state == 0).alias("is_open")))
    entry = F.struct("epoch", "price", "label", "_side")
    paired = running(acted, {"_entry": ("last", F.when(F.col("is_open"), entry))})
    return _book(paired, convention)


def _with_state(rows: DataFrame) -> DataFrame:
    """``_state`` before each row: 0 flat, 1 open. ``rows`` is settled.

    Rows that may both open and close flip the state: it is that of the last row that forces one, and the flips since.
    """
    opens, closes = F.col("_opens"), F.col("_closes")
    forced = F.when(opens & ~closes, 1).when(closes & ~opens, 0)
    flips = F.when(opens & closes, 1).otherwise(0)
    rows = settle(running(rows, {"_flips": ("sum", flips)}))
    known = running(
        rows, {"_set": ("last", F.when(forced.isNotNull(), F.struct(forced.alias("open"), "_flips")))}, inclusive=False
    )
    since = F.col("_flips") - flips - F.coalesce(F.col("_set._flips"), F.lit(0))
    return known.withColumn("_state", F.pmod(F.coalesce(F.col("_set.open"), F.lit(0)) + since, F.lit(2))).drop("_set", "_flips")


def _book(paired: DataFrame, convention: str) -> DataFrame:
    side = F.col("_entry._side")
    pnl = _pnl(side, F.col("_entry.price"), F.col("price"), convention)
    fallback = F.when(F.col("_buy"), "Buy signal").otherwise("Sell signal")
    label = F.when(F.col("label") == "", fallback).otherwise(F.col("label"))
    opened = F.col("is_open")
    kind = F.when(opened == (side == "long"), "buy").otherwise("sell")
    return paired.select(
        "symbol",
        "epoch",
        "bar_index",
        kind.alias("type"),
        side.alias("side"),
        "is_open",
        "price",
        F.when(opened, label).otherwise(pnl_suffix(label, pnl)).alias("label"),
        F.col("price").alias("option_price"),
        F.col("_entry.epoch").alias("entry_epoch"),
        F.col("_entry.price").alias("entry_price"),
        F.when(~opened, pnl).alias("pnl"),
    )


def _pnl(side: Column, entry: Column, leave: Column, convention: str) -> Column:
    if convention not in ("engine", "premium"):
        raise ValueError(f"unknown convention {convention!r}; use engine or premium")
    gain = leave - entry
    return gain if convention == "premium" else F.when(side == "short", -gain).otherwise(gain)


def close_at_end(ledger: DataFrame, bars: DataFrame, convention: str = "engine") -> DataFrame:
    """Close a position still open at a symbol's last bar, at that bar's close."""
    latest = ledger.groupBy("symbol").agg(
        F.max_by(F.struct("is_open", "side", "epoch", "price"), "bar_index").alias("_last")
    )
    last_bar = bars.groupBy("symbol").agg(F.max_by(F.struct("epoch", "bar_index", "close"), "epoch").alias("_bar"))
    forced = latest.where("_last.is_open").join(last_bar, "symbol")
    pnl = _pnl(F.col("_last.side"), F.col("_last.price"), F.col("_bar.close"), convention)
    rows = forced.select(
        "symbol",
        F.col("_bar.epoch").alias("epoch"),
        F.col("_bar.bar_index").alias("bar_index"),
        F.when(F.col("_last.side") == "long", "sell").otherwise("buy").alias("type"),
        F.col("_last.side").alias("side"),
        F.lit(False).alias("is_open"),
        F.col("_bar.close").alias("price"),
        pnl_suffix(F.lit("End of backtest period"), pnl).alias("label"),
        F.col("_bar.close").alias("option_price"),
        F.col("_last.epoch").alias("entry_epoch"),
        F.col("_last.price").alias("entry_price"),
        pnl.alias("pnl"),
    )
    return ledger.unionByName(rows)


def _closed(mode: str) -> Column:
    """Rows that count as completed: only sells, as the engine does, or every closing row."""
    if mode not in ("reference", "all_closed"):
        raise ValueError(f"unknown mode {mode!r}; use reference or all_closed")
    closed = F.col("pnl").isNotNull()
    return closed & (F.col("type") == "sell") if mode == "reference" else closed


def trade_metrics(
    ledger: DataFrame, keys: tuple[str, ...] = ("symbol",), capital: float = CAPITAL, mode: str = "reference"
) -> DataFrame:
    """Ten measures per key; a zero result counts as a loss, no losses give profit factor 0."""
    pnl = F.when(_closed(mode), F.col("pnl"))
    out = ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count(pnl).alias("completed_trades"),
        F.count_if(pnl > 0).alias("wins"),
        F.count_if(pnl <= 0).alias("losses"),
        F.coalesce(F.sum(pnl), F.lit(0.0)).alias("_pnl"),
        F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("_won"),
        F.coalesce(F.sum(F.when(pnl <= 0, pnl)), F.lit(0.0)).alias("_lost"),
    )
    ratio = lambda top, under: F.when(under > 0, top / under).otherwise(0.0)
    return out.select(
        *keys,
        "total_trades",
        "completed_trades",
        "wins",
        "losses",
        F.round("_pnl", 2).alias("total_pnl"),
        F.round(ratio(F.col("wins") * 100, F.col("completed_trades")), 1).alias("win_rate"),
        F.round(ratio(F.col("_won"), F.col("wins")), 2).alias("avg_win"),
        F.round(ratio(F.col("_lost"), F.col("losses")), 2).alias("avg_loss"),
        F.round(ratio(F.col("_won"), F.abs("_lost")), 2).alias("profit_factor"),
        F.round(F.col("_pnl") / capital * 100, 2).alias("return_pct"),
    )


def equity_curve(ledger: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Capital after each closed trade."""
    closed = ledger.where(F.col("pnl").isNotNull())
    out = running(closed, {"_gain": ("sum", F.col("pnl"))})
    return out.withColumn("equity", F.lit(capital) + F.col("_gain")).drop("_gain")


def risk_metrics(ledger: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Largest drop of the equity curve from its peak, and mean/deviation of trade results."""
    curve = settle(equity_curve(ledger, capital))
    peaked = running(curve, {"_peak": ("max", F.col("equity"))})
    drop = F.greatest("_peak", F.lit(capital)) - F.col("equity")
    return peaked.groupBy("symbol").agg(
        F.max(drop).alias("max_drawdown"),
        F.when(F.stddev_samp("pnl") > 0, F.avg("pnl") / F.stddev_samp("pnl")).alias("sharpe"),
    )


def compare_runs(metrics: dict[str, DataFrame], measure: str = "total_pnl") -> DataFrame:
    """One row per symbol, one column of ``measure`` per run."""
    union = None
    for run, df in metrics.items():
        part = df.select("symbol", F.lit(run).alias("run_id"), measure)
        union = part if union is None else union.unionByName(part)
    return union.groupBy("symbol").pivot("run_id", list(metrics)).agg(F.first(measure))


def marks(ledger: DataFrame, start: int, end: int) -> DataFrame:
    """Chart marks of the trades inside an inclusive time range."""
    buy = F.col("type") == "buy"
    return ledger.where(F.col("epoch").between(start, end)).select(
        "symbol",
        F.concat_ws("_", "epoch", "type").alias("id"),
        F.col("epoch").alias("time"),
        F.when(buy, "green").otherwise("red").alias("color"),
        F.concat_ws(" ", F.upper("type"), "label").alias("text"),
        F.when(buy, "B").otherwise("S").alias("mark_label"),
        F.lit(14).alias("min_size"),
    )


# fixed values: marker distance from the candle, and per marker already there, as parts of the price
MARKER_BASE, MARKER_STACK = 0.0015, 0.001


def marker_offsets(snapped: DataFrame, bucket_seconds: int = 300) -> DataFrame:
    """Rank of same-type markers inside a time bucket, and a price beyond the candle that keeps them apart.

    ``snapped`` has ``candle_high`` and ``candle_low`` (see ``asof.snap_trades``).
    """
    out = running(
        snapped.withColumn("bucket", (F.floor(F.col("epoch") / bucket_seconds) * bucket_seconds).cast("long")),
        {"marker_rank": ("count", F.lit(1))},
        keys=("symbol", "bucket", "type"),
        order=("epoch", "price"),
        block=F.col("epoch"),
        inclusive=False,
    )
    away = F.col("price") * MARKER_BASE + F.col("price") * MARKER_STACK * F.col("marker_rank")
    below, above = F.col("candle_low") - away, F.col("candle_high") + away
    return out.withColumn("marker_price", F.when(F.col("type") == "buy", below).otherwise(above))


def distinct_trades(ledger: DataFrame) -> DataFrame:
    """One trade per symbol, time, type and price."""
    return ledger.dropDuplicates(["symbol", "epoch", "type", "price"])
