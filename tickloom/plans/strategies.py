"""Strategies: indexed bars in, sparse signal rows out.

A signal row is the bar plus ``signal`` (1 buy, -1 sell), ``signal_price`` and ``signal_label``;
``with_holds`` gives back the dense table with HOLD rows.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.dates import expiry_text, next_thursday
from tickloom.functions.labels import BUY, HOLD, SELL, entry_label
from tickloom.operators.blocks import block_rows, framed, running
from tickloom.operators.folds import fold_blocks
from tickloom.operators.indicators import donchian, ema
from tickloom.session import settle

BAR = ("symbol", "epoch", "bar_index", "open", "high", "low", "close", "volume")
SIGNAL = (*BAR, "signal", "signal_price", "signal_label")


def _signal_rows(df: DataFrame, signal: Column, label: Column, *extra: str) -> DataFrame:
    return df.select(
        *BAR,
        signal.cast("int").alias("signal"),
        F.col("close").alias("signal_price"),
        label.alias("signal_label"),
        *extra,
    )


def with_holds(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Every bar with its signal; bars without one hold at their close."""
    marks = signals.select("symbol", "epoch", "signal", "signal_price", "signal_label")
    return bars.join(marks, ["symbol", "epoch"], "left").select(
        *BAR,
        F.coalesce("signal", F.lit(HOLD)).alias("signal"),
        F.coalesce("signal_price", "close").alias("signal_price"),
        F.coalesce("signal_label", F.lit("")).alias("signal_label"),
    )


def hold_only(bars: DataFrame) -> DataFrame:
    """Placeholder strategies: every bar holds."""
    return bars.select(
        *BAR, F.lit(HOLD).alias("signal"), F.col("close").alias("signal_price"), F.lit("").alias("signal_label")
    )


def breakout_signals(bars: DataFrame, n: int = 3) -> DataFrame:
    """Channel breakout: first close above the channel, then first close below it, and so on."""
    ready = F.col("bar_index") > n
    side = F.when(ready & (F.col("close") > F.col("hh")), BUY).when(ready & (F.col("close") < F.col("ll")), SELL)
    candidates = settle(donchian(bars, n).withColumn("_side", side).where(F.col("_side").isNotNull()))
    seen = running(candidates, {"_before": ("last", F.col("_side"))}, inclusive=False)
    kept = seen.where(F.col("_side") != F.coalesce("_before", F.lit(SELL)))
    label = F.when(F.col("_side") == BUY, f"Buy {n}-Bar Breakout").otherwise("Sell (Stop Loss)")
    return _signal_rows(kept, F.col("_side"), label)


# fixed values: quarter steps on the square-root wheel
WHEEL_STEPS = (0.25, 0.50, 0.75, 1.00)


def square_levels(bars: DataFrame, steps: tuple[float, ...] = WHEEL_STEPS, anchor: str = "dataset") -> DataFrame:
    """Levels ``(sqrt(first open) + step)^2`` per symbol (or per symbol and day), as an array."""
    keys = {"dataset": ["symbol"], "day": ["symbol", "day"]}[anchor]
    first = (
        bars.withColumn("day", F.floor(F.col("epoch") / 86400)).groupBy(*keys).agg(F.min_by("open", "epoch").alias("o"))
    )
    return first.select(*keys, F.array(*[F.pow(F.sqrt("o") + s, F.lit(2.0)) for s in steps]).alias("levels"))


def level_touches(
    bars: DataFrame, tolerance: float = 0.001, steps: tuple[float, ...] = WHEEL_STEPS, anchor: str = "dataset"
) -> DataFrame:
    """Bars after the first whose low lies within ``tolerance`` of a level; ``level`` is the first such."""
    levels = square_levels(bars, steps, anchor)
    keys = [c for c in levels.columns if c != "levels"]
    near = F.filter("levels", lambda lv: F.abs(F.col("low") - lv) < lv * tolerance)
    return (
        bars.withColumn("day", F.floor(F.col("epoch") / 86400))
        .join(levels, keys)
        .withColumn("level", F.get(near, F.lit(0)))
        .where(F.col("level").isNotNull() & (F.col("bar_index") >= 1))
        .drop("levels", "day")
    )


def spaced_entries(touches: DataFrame, gap: int, rows: int | None = None, fanout: int = 32) -> DataFrame:
    """Greedy choice: the first touch, then the first touch at least ``gap`` bars later, and so on.

    Each block of touches is a function from "first index allowed" to "next index allowed", and the
    value coming in can only be one of ``gap`` offsets. The blocks' functions are tabulated in
    parallel and composed over a tree, ``fanout`` tables a node; from the root down every block
    learns what it starts from, and the blocks then choose on their own.
    """
    rows = max(block_rows(rows), gap)
    blocks = settle(
        touches.groupBy("symbol", F.floor(F.col("bar_index") / rows).cast("long").alias("node"))
        .agg(F.sort_array(F.collect_list("bar_index")).alias("_at"))
        .withColumn("start", F.col("node") * rows)
    )

    def last_allowed(first: Column) -> Column:
        return F.aggregate("_at", first, lambda free, t: F.when(t >= free, t + gap).otherwise(free))

    out = F.transform(F.sequence(F.lit(0), F.lit(gap)), lambda o: last_allowed(F.col("start") + o))
    tables, nodes = blocks.select("symbol", "node", "start", out.alias("out")), []
    through = lambda free, kid: F.get(kid["out"], (F.greatest(free, kid["start"]) - kid["start"]).cast("int"))
    top = blocks.agg(F.max("node")).first()[0]
    while top is not None:
        kids = tables.groupBy("symbol", F.expr(f"node div {fanout}").alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "start", "out"))).alias("kids"))
        nodes.append(settle(kids))
        first, rest = F.get("kids", F.lit(0)), F.slice("kids", F.lit(2), F.size("kids"))
        composed = F.aggregate(rest, first["out"], lambda acc, kid: F.transform(acc, lambda free: through(free, kid)))
        tables = nodes[-1].select("symbol", "node", first["start"].alias("start"), composed.alias("out"))
        top = top // fanout or None
    entered = blocks.select("symbol", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("free")).distinct()
    for kids in reversed(nodes):
        seed = F.struct(F.col("free").alias("free"), F.array().cast("array<struct<node:bigint,free:bigint>>").alias("ins"))
        step = lambda acc, kid: F.struct(
            through(acc["free"], kid).alias("free"), F.concat(acc["ins"], F.array(F.struct(kid["node"].alias("node"), F.greatest(acc["free"], kid["start"]).alias("free")))).alias("ins")
        )
        entered = kids.join(entered, ["symbol", "node"]).select("symbol", F.inline(F.aggregate("kids", seed, step, lambda acc: acc["ins"])))
    chosen_seed = F.struct(F.col("free").alias("free"), F.array().cast("array<bigint>").alias("kept"))

    def choose(acc, t):
        return F.when(
            t >= acc["free"],
            F.struct((t + gap).alias("free"), F.concat(acc["kept"], F.array(t)).alias("kept")),
        ).otherwise(acc)

    kept = F.aggregate("_at", chosen_seed, choose, lambda acc: acc["kept"])
    return blocks.join(entered, ["symbol", "node"]).select("symbol", F.explode(kept).alias("bar_index"))


def square_signals(bars: DataFrame, tolerance: float = 0.001, hold: int = 5, anchor: str = "dataset") -> DataFrame:
    """Buy at a level touch, sell ``hold`` bars later, one position at a time."""
    touches = settle(level_touches(bars, tolerance, anchor=anchor))
    entries = settle(spaced_entries(touches, hold + 1))
    buys = touches.join(entries, ["symbol", "bar_index"])
    label = F.concat(F.lit("Sq9 Support @"), F.bround("level", 1).cast("decimal(38,1)").cast("string"))
    sells = bars.join(entries.select("symbol", (F.col("bar_index") + hold).alias("bar_index")), ["symbol", "bar_index"])
    return _signal_rows(buys, F.lit(BUY), label).unionByName(_signal_rows(sells, F.lit(SELL), F.lit("Exit (Time-based)")))


def first_touch(bars: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Older variant: one buy at a symbol's first touch of the three lower levels."""
    touches = level_touches(bars, tolerance, WHEEL_STEPS[:3])
    first = touches.groupBy("symbol").agg(F.min_by(F.struct(*[c for c in touches.columns if c != "symbol"]), "bar_index").alias("_r"))
    rows = first.select("symbol", "_r.*")
    label = F.concat(F.lit("Sq9 Support "), F.bround("level", 1).cast("decimal(38,1)").cast("string"))
    return _signal_rows(rows, F.lit(BUY), label)


@dataclass(frozen=True)
class EmaBreakout:
    """Parameters of the alert-candle breakout."""

    ema_period: int = 5
    risk_reward_ratio: float = 3.0
    trade_direction: str = "both"
    alert_validity_bars: int = 3
    strike_step: int = 50

    def __post_init__(self):
        if self.trade_direction not in ("both", "long_only", "short_only"):
            raise ValueError(f"unknown trade_direction {self.trade_direction!r}")


FOLD_SCHEMA = "symbol string, bar_index long, param_id string, action string, reason string, stop_loss double, target double"
#: Bars before a block over which open positions and alerts are guessed, besides twice the validity of an alert.
WARM_BARS = 64


class EmaRules:
    """Breakout rules of one symbol and parameter set, one bar at a time; starts flat, without alerts.

    ``memory`` is all there is to resume from: the open position and the armed alerts.
    """

    SIDES = {"both": ("short", "long"), "short_only": ("short",), "long_only": ("long",)}

    def __init__(self, params: EmaBreakout, memory: dict | None = None):
        self.params = params
        self.sides = self.SIDES[params.trade_direction]
        self.memory = memory or {"side": None, "stop": None, "goal": None, "short": None, "long": None}

    def step(self, at, high, low, close, average, prev_high, prev_low, above, below):
        """``(action, reason, stop_loss, target)`` when the bar signals, else None.

        ``above``/``below`` tell that the previous bar lay wholly above/below its average.
        """
        m = self.memory
        if at <= self.params.ema_period:
            return None
        if m["side"] is not None:
            return self._leave(high, low, close, average)
        for side, fresh in (("short", above), ("long", below)):
            if fresh and side in self.sides:
                m[side] = (prev_high, prev_low, at + self.params.alert_validity_bars)
        for side in self.sides:
            alert = m[side]
            if alert is None or at > alert[2]:
                continue
            if (close < alert[1]) if side == "short" else (close > alert[0]):
                stop = alert[0] if side == "short" else alert[1]
                goal = close - (stop - close) * self.params.risk_reward_ratio
                m.update(side=side, stop=stop, goal=goal, short=None, long=None)
                return f"enter_{side}", f"{stop:.0f}", stop, goal
        return None

    def fresh(self, at: int) -> dict:
        """The memory after bar ``at``, without alerts that can't fire any more."""
        for side in ("short", "long"):
            if self.memory[side] is not None and self.memory[side][2] <= at:
                self.memory[side] = None
        return self.memory

    def _leave(self, high, low, close, average):
        m = self.memory
        side, stop, goal = m["side"], m["stop"], m["goal"]
        up = side == "long"
        # told for a long; a short is the mirror image
        sign = 1.0 if up else -1.0
        if sign * close <= sign * stop:
            why = f"SL Hit @ {stop:.1f}"
        elif sign * close >= sign * goal:
            why = f"Target @ {goal:.1f}"
        elif (low <= average) if up else (high >= average):
            why = "EMA Touch"
        else:
            return None
        m.update(side=None, stop=None, goal=None)
        return f"exit_{side}", why, stop, goal


def _ema_bars(bars: DataFrame, period: int) -> DataFrame:
    """Bars with what the rules read: their average, the bar before, and whether that lay wholly above or below its own average."""

    def add(df, w):
        return df.withColumns(
            {
                "prev_high": F.lag("high").over(w),
                "prev_low": F.lag("low").over(w),
                "above": F.coalesce(F.lag("low").over(w) > F.lag("ema").over(w), F.lit(False)),
                "below": F.coalesce(F.lag("high").over(w) < F.lag("ema").over(w), F.lit(False)),
            }
        )

    shaped = framed(ema(bars, {"ema": period}), 1, 0, add)
    return settle(shaped.select("symbol", "bar_index", "high", "low", "close", "ema", "prev_high", "prev_low", "above", "below"))


def ema_breakouts(bars: DataFrame, grid: dict[str, EmaBreakout], rows: int | None = None) -> DataFrame:
    """Entries and exits of every parameter set in ``grid`` (``param_id -> EmaBreakout``).

    The sets of one average share its bars and one walk (``fold_blocks``): the memory of a symbol is the open position and the alerts of each set.
    """
    actions = None
    periods: dict[int, dict[str, dict]] = {}
    for name, p in grid.items():
        periods.setdefault(p.ema_period, {})[name] = asdict(p)
    for period, wanted in periods.items():
        warm = WARM_BARS + 2 * max(p["alert_validity_bars"] for p in wanted.values())
        part = fold_blocks(_ema_bars(bars, period), _ema_walk(wanted), FOLD_SCHEMA, rows=rows, warm=warm)
        actions = part if actions is None else actions.unionByName(part)
    return actions


def _ema_walk(wanted: dict[str, dict]):
    columns = ("bar_index", "high", "low", "close", "ema", "prev_high", "prev_low", "above", "below")

    def step(memory, frame: pd.DataFrame):
        rules = {name: EmaRules(EmaBreakout(**p), (memory or {}).get(name)) for name, p in wanted.items()}
        symbol, out = frame["symbol"].iloc[0], []
        for row in zip(*[frame[c].tolist() for c in columns]):
            for name, rule in rules.items():
                signal = rule.step(*row)
                if signal is not None:
                    out.append((symbol, row[0], name, *signal))
        return {name: rule.fresh(row[0]) for name, rule in rules.items()}, out

    return step


def ema_signals(bars: DataFrame, grid: dict[str, EmaBreakout] | None = None) -> DataFrame:
    """Alert-candle breakout signals with contract labels; ``param_id`` names the parameter set."""
    grid = grid or {"default": EmaBreakout()}
    actions = ema_breakouts(bars, grid)
    steps = F.create_map(*[F.lit(v) for n, p in grid.items() for v in (n, p.strike_step)])
    step = F.element_at(steps, F.col("param_id"))
    rows = bars.join(actions, ["symbol", "bar_index"])
    enters = F.col("action").startswith("enter")
    long_side = F.col("action").endswith("long")
    option_type = F.when(long_side, "CE").otherwise("PE")
    strike = (F.bround(F.col("close") / step) * step).cast("long")
    expiry = next_thursday(F.col("epoch"))
    bought = entry_label(strike.cast("string"), option_type, expiry_text(expiry), F.col("reason"))
    left = F.concat(F.lit("Exit "), F.when(long_side, "Long").otherwise("Short"), F.lit(" ("), F.col("reason"), F.lit(")"))
    signal = F.when(enters == long_side, BUY).otherwise(SELL)
    rows = rows.withColumns(
        {
            "strike": F.when(enters, strike),
            "option_type": F.when(enters, option_type),
            "expiry": F.when(enters, expiry),
        }
    )
    label = F.when(enters, bought).otherwise(left)
    return _signal_rows(rows, signal, label, "param_id", "stop_loss", "target", "strike", "option_type", "expiry")
