"""Studies over bars: angle set-ups of pivot pairs, touches and breaches of their lines, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.geometry import NAMES, breaches, fan_lines, price_at, theta, touches
from tickloom.operators.hulls import HULL_ROWS, crossed_blocks, hulls, in_blocks, reachable
from tickloom.operators.blocks import framed
from tickloom.operators.indicators import candle_patterns, close_streak, ema, momentum
from tickloom.operators.pivots import pivot_pairs, symmetric_pivots
from tickloom.session import settle

TOLERANCE_PERCENT = 0.1
CONFIRMING_CLOSES = 2


def indicator_points(bars: DataFrame, step: int, span: int = 5) -> DataFrame:
    """EMA polyline of each symbol up to and including bar ``step``."""
    return ema(bars.where(F.col("bar_index") <= step), {"ema": span}).select(
        "symbol", F.col("epoch").alias("time"), F.col("ema").alias("price")
    )


def angle_setups(bars: DataFrame, lookback: int = 10, scale: float = 1.0) -> DataFrame:
    """Inner and outer pivot pair per symbol with angle, lines and targets.

    The horizontal target is the half-angle line at the second pivot's time; full coverage is the
    first pivot's price.
    """
    pairs = pivot_pairs(settle(symmetric_pivots(bars, lookback)))
    span = F.greatest(F.lit(1), F.abs(F.col("second.bar_index") - F.col("first.bar_index")))
    lines = fan_lines(F.col("first"), F.col("second"), scale)
    half = F.get(F.filter("lines", lambda ln: ln["fraction"] == 0.5), F.lit(0))["end_price"]
    return (
        pairs.withColumn("lines", lines)
        .withColumn("angle_degrees", F.abs(F.degrees(theta(F.col("second.price") - F.col("first.price"), span, scale))))
        .withColumn("horizontal_target", half)
        .withColumn("full_coverage_target", F.col("first.price"))
    )


def angle_divisions(setups: DataFrame) -> DataFrame:
    """One row per set-up and line: name, angle and its end point."""
    names = F.create_map(*[F.lit(v) for f, n in NAMES.items() for v in (f, n)])
    flat = setups.select("symbol", "pair_type", "scenario", "angle_degrees", "first", "second", F.inline("lines"))
    part = F.coalesce(F.col("fraction"), F.lit(1.0))
    return flat.withColumns({"angle_name": F.element_at(names, part), "line_degrees": F.col("angle_degrees") * part})


def angle_events(
    bars: DataFrame,
    setups: DataFrame,
    tolerance: float = TOLERANCE_PERCENT,
    confirmations: int = CONFIRMING_CLOSES,
    rows: int = HULL_ROWS,
) -> DataFrame:
    """Touches of angle lines, confirmed breaches inside the touch band, touches of horizontal targets.

    A line opens the bars of a block only if the hulls of its closes reach the touch band.
    """
    last = bars.groupBy("symbol").agg(F.max("epoch").alias("_last"))
    lines = angle_divisions(setups).select(
        "symbol", "pair_type", "scenario", "angle_name", "start_time", "start_price", "end_time", "end_price"
    )
    blocked = settle(in_blocks(close_streak(bars), rows))
    met = crossed_blocks(lines.join(last, "symbol"), settle(hulls(blocked)), F.col("start_time"), F.col("_last"))
    opened = met.where(reachable(F.col("lower"), F.col("upper"), tolerance / 100)).drop("lower", "upper")
    line = price_at(F.col("epoch"), F.col("start_time"), F.col("start_price"), F.col("end_time"), F.col("end_price"))
    near = opened.join(blocked, ["symbol", "block"]).where("epoch >= start_time").withColumn("line_price", line).where(
        touches(F.col("close"), F.col("line_price"), tolerance)
    )
    above = F.col("close") > F.col("line_price")
    closes = F.when(above, F.col("up_streak")).otherwise(F.col("down_streak"))
    broke = breaches(F.col("close"), F.col("line_price"), F.col("scenario")) & (closes >= confirmations)
    event = lambda kind, direction, key, value: F.struct(
        F.lit(kind).alias("event_type"), direction.alias("direction"), F.create_map(F.lit(key), value.cast("string")).alias("details")
    )
    touch = event("angle_touch", F.lit(None).cast("string"), "tolerance_percent", F.lit(tolerance))
    breach = event("angle_breach", F.when(above, "up").otherwise("down"), "close_count", closes)
    angles = near.select(
        "symbol", "epoch", "pair_type", "angle_name", F.col("close").alias("price"),
        F.inline(F.array_compact(F.array(touch, F.when(broke, breach)))),
    )
    targets = setups.select("symbol", "pair_type", "horizontal_target")
    flat = bars.join(targets, "symbol").where(touches(F.col("close"), F.col("horizontal_target"), tolerance))
    horizontal = flat.select(
        "symbol", "epoch", "pair_type", F.lit(None).cast("string").alias("angle_name"), F.col("close").alias("price"),
        F.lit("horizontal_touch").alias("event_type"), F.lit(None).cast("string").alias("direction"),
        F.create_map().cast("map<string,string>").alias("details"),
    )
    return angles.unionByName(horizontal)


def indicator_snapshots(bars: DataFrame) -> DataFrame:
    """Momentum state of every bar, as the event log stores it."""
    return momentum(bars).select(
        "symbol", "epoch", "ema_9", "ema_21", "ema_signal", "rsi", "rsi_signal", "overall_momentum", "confidence"
    )


# fixed values: candle patterns in the order in which they are logged
PATTERNS = (
    "doji", "hammer", "long_upper_wick", "long_lower_wick", "bullish_engulfing", "bearish_engulfing",
    "volume_spike", "bullish_divergence", "bearish_divergence",
)


def market_events(bars: DataFrame, lookback: int = 10) -> DataFrame:
    """Events that need no angle: candle patterns, changes of the overall momentum, and pivots at the bar they lie on."""
    none = F.lit(None).cast("string")
    event = lambda df, price, kind, details: df.select(
        "symbol", "epoch", none.alias("pair_type"), none.alias("angle_name"), F.col(price).alias("price"),
        F.lit(kind).alias("event_type"), none.alias("direction"), details.alias("details"),
    )
    shown = F.array_compact(F.array(*[F.when(F.col(p), F.lit(p)) for p in PATTERNS]))
    patterns = candle_patterns(bars).withColumn("pattern", F.explode(shown))

    def add(df, w):
        return df.withColumn("_before", F.lag("overall_momentum").over(w))

    changes = framed(momentum(bars), 1, 0, add).where("overall_momentum <> _before")
    pivots = symmetric_pivots(bars, lookback)
    pairs = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    return (
        event(patterns, "close", "candle_pattern", pairs(pattern_name=F.col("pattern")))
        .unionByName(event(changes, "close", "momentum_change", pairs(before=F.col("_before"), after=F.col("overall_momentum"))))
        .unionByName(event(pivots, "price", "pivot_formed", pairs(pivot_type=F.col("type"))))
    )


def event_log(bars: DataFrame, setups: DataFrame, tolerance: float = TOLERANCE_PERCENT, confirmations: int = CONFIRMING_CLOSES, lookback: int = 10) -> DataFrame:
    """All events of a study, each with the indicator ``snapshot`` of its bar. ``bars`` should be settled."""
    events = angle_events(bars, setups, tolerance, confirmations).unionByName(market_events(bars, lookback))
    shots = indicator_snapshots(bars)
    packed = F.struct(*[c for c in shots.columns if c not in ("symbol", "epoch")])
    return events.join(shots.select("symbol", "epoch", packed.alias("snapshot")), ["symbol", "epoch"], "left")


def session_statistics(events: DataFrame) -> DataFrame:
    """One row per symbol: ``event_count`` and maps of counts ``events_by_type, events_by_angle, breach_directions`` (up and down, zeros too)."""
    stats = event_stats(events)
    entries = lambda dim: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dimension") == dim, F.struct("key", "n")))))
    totals = stats.groupBy("symbol").agg(
        F.max(F.when(F.col("dimension") == "total", F.col("n"))).alias("event_count"),
        entries("type").alias("events_by_type"), entries("angle").alias("events_by_angle"), entries("direction").alias("_seen"),
    )
    count = lambda key: F.coalesce(F.try_element_at("_seen", F.lit(key)), F.lit(0))
    return totals.withColumn("breach_directions", F.create_map(F.lit("up"), count("up"), F.lit("down"), count("down"))).drop("_seen")


def event_stats(events: DataFrame) -> DataFrame:
    """Counts per symbol: total, by type, by angle and by breach direction."""
    slot = lambda dim, key: F.struct(F.lit(dim).alias("dimension"), key.alias("key"))
    breach = (F.col("event_type") == "angle_breach") & F.col("direction").isNotNull()
    slots = F.array(
        slot("total", F.lit("all")),
        slot("type", F.col("event_type")),
        F.when(F.col("angle_name").isNotNull(), slot("angle", F.col("angle_name"))),
        F.when(breach, slot("direction", F.col("direction"))),
    )
    return (
        events.select("symbol", F.inline(F.array_compact(slots)))
        .groupBy("symbol", "dimension", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def study_batch(bars: DataFrame, lookback: int = 10, tolerance: float = TOLERANCE_PERCENT) -> DataFrame:
    """One row per symbol: bars, set-ups and event totals of a whole study run."""
    setups = settle(angle_setups(bars, lookback))
    kinds = ("angle_touch", "angle_breach", "horizontal_touch")
    events = angle_events(bars, setups, tolerance).groupBy("symbol").agg(
        *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("total_events")
    )
    totals = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("total_bars"))
    counts = setups.groupBy("symbol").agg(F.count(F.lit(1)).alias("setups"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return totals.join(counts, "symbol", "left").join(events, "symbol", "left").select(
        "symbol", "total_bars", *[zero(c) for c in ("setups", *kinds, "total_events")]
    )


def study_geometry(bars: DataFrame, setups: DataFrame) -> DataFrame:
    """Pivots, angle lines and horizontal targets of all set-ups as one flat table."""
    last = bars.groupBy("symbol").agg(F.max("epoch").alias("_last"))
    both = setups.join(last, "symbol")
    names = F.create_map(*[F.lit(v) for f, n in NAMES.items() for v in (f, n)])
    item = lambda kind, name, t1, p1, t2, p2: F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), t1.alias("time"), p1.alias("price"), t2.alias("end_time"), p2.alias("end_price")
    )
    pivots = [
        item("pivot", F.lit(label), F.col(f"{side}.epoch"), F.col(f"{side}.price"), F.lit(None).cast("long"), F.lit(None).cast("double"))
        for side, label in (("first", "First"), ("second", "Second"))
    ]
    line = lambda ln: item(
        "angle_line", F.element_at(names, F.coalesce(ln["fraction"], F.lit(1.0))), ln["start_time"], ln["start_price"], ln["end_time"], ln["end_price"]
    )
    target = item(
        "horizontal_target", F.lit("target"), F.col("second.epoch"), F.col("horizontal_target"), F.col("_last"), F.col("horizontal_target")
    )
    everything = F.concat(F.array(*pivots), F.transform("lines", line), F.array(target))
    return both.select("symbol", "pair_type", F.inline(everything))
