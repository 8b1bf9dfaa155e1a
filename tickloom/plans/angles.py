"""Trading rules on angle lines: confirmed breaches enter, targets, stops and reversals exit."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.geometry import touches
from tickloom.operators.blocks import framed
from tickloom.operators.folds import fold_blocks
from tickloom.operators.hierarchy import join_active
from tickloom.operators.indicators import candle_patterns, close_streak
from tickloom.plans.studies import angle_divisions
from tickloom.session import settle

PATTERN_FLAGS = ("doji", "hammer", "long_upper_wick", "long_lower_wick", "bullish_engulfing", "bearish_engulfing")
SIGNAL_SCHEMA = "symbol string, bar_index long, epoch long, action string, price double, weight double, reason string"


@dataclass(frozen=True)
class AngleTrading:
    """``exit_mode``: fixed (all at the target), trailing (stop follows breached lines) or partial (half, then trail)."""

    confirmations: int = 2
    tolerance: float = 0.1
    exit_mode: str = "partial"
    use_wicks: bool = False
    reversals: bool = True

    def __post_init__(self):
        if self.exit_mode not in ("fixed", "trailing", "partial"):
            raise ValueError(f"unknown exit_mode {self.exit_mode!r}; use fixed, trailing or partial")


def angle_levels(bars: DataFrame, setups: DataFrame, params: AngleTrading, width: int = 30 * 86400) -> DataFrame:
    """Bars with the next line above and below, the line breached on confirmed closes, and reversal signs."""
    n = params.confirmations
    shaped = candle_patterns(close_streak(bars))

    def add(df, w):
        recent = w.rowsBetween(-(n - 1), 0)
        pattern = F.greatest(*[F.col(c).cast("int") for c in PATTERN_FLAGS])
        return df.withColumns(
            {
                "_low": F.min("low").over(recent),
                "_high": F.max("high").over(recent),
                "_pattern": F.max(pattern).over(w.rowsBetween(-n, 0)) == 1,
            }
        )

    shaped = settle(framed(shaped, n, 0, add))
    last = bars.groupBy("symbol").agg(F.max("epoch").alias("_last"))
    lines = angle_divisions(setups).select("symbol", "angle_name", "start_time", "start_price", "end_time", "end_price")
    on = join_active(shaped.select("symbol", "epoch", "high", "low", "close"), lines.join(last, "symbol"), F.col("_last"), width)
    close, line = F.col("close"), F.col("line_price")
    reached = touches(close, line, params.tolerance)
    if params.use_wicks:
        reached = reached | ((F.col("low") <= line) & (line <= F.col("high")))
    gap = F.abs(close - line)
    levels = on.groupBy("symbol", "epoch").agg(
        F.min(F.when(line > close, line)).alias("next_up"),
        F.max(F.when(line < close, line)).alias("next_down"),
        F.min_by(line, F.when(reached & (close > line), gap)).alias("broke_up"),
        F.min_by(line, F.when(reached & (close < line), gap)).alias("broke_down"),
        F.bool_or(reached).alias("at_line"),
    )
    out = shaped.join(levels, ["symbol", "epoch"], "left")
    turned = F.coalesce(F.col("at_line"), F.lit(False)) & F.col("_pattern")
    up, down = F.col("up_streak") >= n, F.col("down_streak") >= n
    return out.select(
        "symbol", "bar_index", "epoch", "close", "next_up", "next_down",
        F.when(up, F.col("broke_up")).alias("broke_up"), F.when(down, F.col("broke_down")).alias("broke_down"),
        F.col("_low").alias("recent_low"), F.col("_high").alias("recent_high"),
        F.when(turned & up, "long").when(turned & down, "short").alias("reversal"),
    )


def _walk(grid: dict[str, AngleTrading]):
    known = lambda v: v is not None and v == v

    def step(memory, bars: pd.DataFrame):
        held, out = {**dict.fromkeys(grid), **(memory or {})}, []
        for b in bars.itertuples(index=False):
            for name, params in grid.items():
                emit = lambda action, weight, why, name=name: out.append(
                    (b.symbol, int(b.bar_index), int(b.epoch), action, float(b.close), weight, why, name)
                )
                held[name] = _manage(held[name], b, params, known, emit) if held[name] else _enter(b, known, emit)
        return held, out

    return step


def _enter(b, known, emit):
    """The position that a breach at this bar opens, if any."""
    up = known(b.broke_up)
    if not up and not known(b.broke_down):
        return None
    side = "long" if up else "short"
    goal = b.next_up if up else b.next_down
    emit(f"enter_{side}", 1.0, "breach")
    return {"side": side, "paid": float(b.close), "stop": float(b.recent_low if up else b.recent_high), "goal": float(goal) if known(goal) else None, "left": 1.0}


def _manage(held, b, params, known, emit):
    """One bar of an open position: the position afterwards, or None when it is closed."""
    sign = 1.0 if held["side"] == "long" else -1.0
    leave = f"exit_{held['side']}"
    if sign * b.close <= sign * held["stop"]:
        emit(leave, held["left"], "stop")
        return None
    if params.reversals and isinstance(b.reversal, str) and b.reversal != held["side"]:
        emit(leave, held["left"], "reversal")
        return None
    if held["goal"] is not None and sign * b.close >= sign * held["goal"]:
        if params.exit_mode == "fixed":
            emit(leave, held["left"], "target")
            return None
        if params.exit_mode == "partial" and held["left"] == 1.0:
            emit(leave, 0.5, "target")
            held = {**held, "left": 0.5, "stop": held["paid"]}
        goal = b.next_up if sign > 0 else b.next_down
        held = {**held, "goal": float(goal) if known(goal) else None}
    broken = b.broke_up if sign > 0 else b.broke_down
    if params.exit_mode != "fixed" and known(broken) and sign * broken > sign * held["stop"]:
        held = {**held, "stop": float(broken)}
    return held


def angle_walks(bars: DataFrame, setups: DataFrame, grid: dict[str, AngleTrading]) -> DataFrame:
    """Entries and (partial) exits per symbol and ``param_id``; one position at a time each.

    Parameter sets that read the same levels share them and one walk over the bars.
    """
    shapes: dict[tuple, dict[str, AngleTrading]] = {}
    for name, p in grid.items():
        shapes.setdefault((p.confirmations, p.tolerance, p.use_wicks), {})[name] = p
    union = None
    for sets in shapes.values():
        levels = settle(angle_levels(bars, setups, next(iter(sets.values()))))
        part = fold_blocks(levels, _walk(sets), f"{SIGNAL_SCHEMA}, param_id string")
        union = part if union is None else union.unionByName(part)
    return union


def angle_signals(bars: DataFrame, setups: DataFrame, params: AngleTrading = AngleTrading()) -> DataFrame:
    """Entries and (partial) exits per symbol; one position at a time."""
    return angle_walks(bars, setups, {"": params}).drop("param_id")


def angle_trades(signals: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Result of each exit against its entry, weighted by the part that was closed."""
    from tickloom.operators.blocks import running

    paid = F.when(F.col("action").startswith("enter"), F.col("price"))
    out = running(signals, {"entry_price": ("last", paid)}, keys=keys)
    sign = F.when(F.col("action") == "exit_long", 1).otherwise(-1)
    exits = out.where(F.col("action").startswith("exit"))
    return exits.withColumn("pnl", sign * (F.col("price") - F.col("entry_price")) * F.col("weight"))


def angle_sweep(bars: DataFrame, setups: DataFrame, grid: dict[str, AngleTrading]) -> DataFrame:
    """Exits, wins and result per symbol and parameter set (confirmations, close or wick, exit mode)."""
    closed = angle_trades(settle(angle_walks(bars, setups, grid)), ("symbol", "param_id"))
    totals = closed.groupBy("symbol", "param_id").agg(
        F.count(F.lit(1)).alias("exits"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("total_pnl")
    )
    named = [F.struct(F.lit(name).alias("param_id"), *[F.lit(str(v)).alias(k) for k, v in asdict(p).items()]) for name, p in grid.items()]
    return totals.withColumn("_p", F.get(F.filter(F.array(*named), lambda p: p["param_id"] == F.col("param_id")), F.lit(0))).select(
        "symbol", "exits", "wins", "total_pnl", "_p.*"
    )
