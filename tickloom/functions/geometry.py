"""Angle fans and line arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the four drawn divisions, and the older set with 1/8
FRACTIONS = (7 / 8, 3 / 4, 1 / 2, 1 / 4)
FRACTIONS_WITH_EIGHTH = (7 / 8, 3 / 4, 1 / 2, 1 / 4, 1 / 8)

NAMES = {1.0: "θ", 7 / 8: "7/8θ", 3 / 4: "3/4θ", 1 / 2: "1/2θ", 1 / 4: "1/4θ", 1 / 8: "1/8θ"}


def bounded(value: Column, limit: float | None = None) -> Column:
    """The price as it is; with ``limit`` (a chart's 1e9) a finite one within ±limit, null, NaN and infinities as 0."""
    if limit is None:
        return value
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, 0.0).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), value)))


def theta(price_change: Column, bars: Column, scale: float = 1.0) -> Column:
    """Angle of a move in price points per bar, in radians."""
    return F.atan(price_change / bars / (scale or 1.0))


def fan_lines(from_pivot: Column, to_pivot: Column, scale: float = 1.0, fractions=FRACTIONS) -> Column:
    """Array of line structs from the earlier pivot: the full angle, then each fraction of it.

    Pivots are structs with ``epoch, price, bar_index``; ``fraction`` is null for the full line.
    """
    forward = from_pivot["epoch"] <= to_pivot["epoch"]
    pick = lambda field, first: F.when(
        forward, (from_pivot if first else to_pivot)[field]
    ).otherwise((to_pivot if first else from_pivot)[field])
    start, stop = pick("price", True), pick("price", False)
    bars = F.greatest(F.lit(1), F.abs(pick("bar_index", False) - pick("bar_index", True)))
    angle = theta(stop - start, bars, scale)

    def line(fraction, end_price):
        return F.struct(
            F.lit(fraction).cast("double").alias("fraction"),
            pick("epoch", True).alias("start_time"),
            bounded(start).alias("start_price"),
            pick("epoch", False).alias("end_time"),
            bounded(end_price).alias("end_price"),
        )

    return F.array(
        line(None, stop), *[line(f, start + F.tan(angle * f) * scale * bars) for f in fractions]
    )


def linear_fan(from_pivot: Column, to_pivot: Column, extension: Column | int = 0, fractions=FRACTIONS_WITH_EIGHTH) -> Column:
    """Older fan: fractions of the slope per second, optionally drawn ``extension`` seconds further."""
    dt = F.greatest(F.lit(1), to_pivot["epoch"] - from_pivot["epoch"])
    slope = (to_pivot["price"] - from_pivot["price"]) / dt
    reach = dt + extension
    return F.array(
        *[
            F.struct(
                F.lit(f).cast("double").alias("fraction"),
                from_pivot["epoch"].alias("start_time"),
                from_pivot["price"].alias("start_price"),
                (from_pivot["epoch"] + reach).alias("end_time"),
                (from_pivot["price"] + slope * f * reach).alias("end_price"),
            )
            for f in (1.0, *fractions)
        ]
    )


def price_at(time: Column, start_time: Column, start_price: Column, end_time: Column, end_price: Column) -> Column:
    """Price of a line at ``time`` by linear interpolation."""
    part = (time - start_time) / F.greatest(F.lit(1), end_time - start_time)
    return start_price + part * (end_price - start_price)


def touches(price: Column, level: Column, tolerance_percent: float) -> Column:
    return F.abs(price - level) <= F.abs(level * tolerance_percent / 100)


def breaches(price: Column, level: Column, scenario: Column) -> Column:
    """Scenario 1 (rising) breaks upwards, scenario 2 (falling) downwards."""
    return F.when(scenario == 1, price > level).otherwise(price < level)
