"""Parameter sweeps: every parameter set in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.bars import resample_all, with_bar_index
from tickloom.operators.ledger import close_at_end, trade_metrics, trades
from tickloom.plans.angles import AngleTrading, angle_sweep
from tickloom.plans.strategies import EmaBreakout, ema_signals
from tickloom.plans.studies import angle_setups
from tickloom.session import settle


def sweep(bars: DataFrame, grid: dict[str, EmaBreakout], mode: str = "all_closed") -> DataFrame:
    """Trade metrics per symbol and parameter set.

    The bars are shaped once per distinct (span, validity); the parameter sets share those bars and
    only the sparse signals carry a ``param_id``. A run is a symbol of its own from there on.
    """
    run = lambda: F.to_json(F.struct("symbol", "param_id"))
    signals = ema_signals(bars, grid).withColumn("symbol", run())
    ids = F.array(*[F.lit(n) for n in grid])
    last = bars.groupBy("symbol").agg(F.max_by(F.struct("epoch", "bar_index", "close"), "epoch").alias("b"))
    last = last.select("symbol", "b.*").withColumn("param_id", F.explode(ids)).withColumn("symbol", run()).drop("param_id")
    ledger = close_at_end(trades(signals), last)
    return trade_metrics(ledger, mode=mode).select(
        F.get_json_object("symbol", "$.symbol").alias("symbol"),
        F.get_json_object("symbol", "$.param_id").alias("param_id"),
        *[c for c in ledger_columns()],
    )


def timeframe_sweep(ticks: DataFrame, resolutions: tuple[int, ...], grid: dict[str, AngleTrading], lookback: int = 10, order: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """``angle_sweep`` over several timeframes: exits, wins and result per symbol, ``seconds`` and parameter set.

    The ticks are read once (``resample_all``); from there on a symbol at a resolution is a series of its own, and all timeframes share one plan.
    """
    series = F.concat_ws("@", "symbol", "seconds")
    bars = resample_all(ticks, resolutions, order).withColumn("symbol", series).drop("seconds")
    bars = settle(with_bar_index(settle(bars)))
    found = angle_sweep(bars, settle(angle_setups(bars, lookback)), grid)
    seconds = F.substring_index("symbol", "@", -1)
    return found.withColumns({"seconds": seconds.cast("int"), "symbol": F.expr("substring(symbol, 1, length(symbol) - length(substring_index(symbol, '@', -1)) - 1)")})


def ledger_columns() -> list[str]:
    return [
        "total_trades", "completed_trades", "wins", "losses", "total_pnl", "win_rate", "avg_win", "avg_loss",
        "profit_factor", "return_pct",
    ]
