"""Nearest and as-of joins without comparing every pair.

Distinct probe positions are merged with the series and scanned in buckets; each position learns the
series row before and after it. The probes then join their positions by equality, so however many
probes share a key, no task sees more than a bucket of distinct positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import running

DAY = 86400


def _neighbours(
    probes: DataFrame, series: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], width: float, both: bool
) -> DataFrame:
    """Distinct probe positions with structs ``_prev`` and ``_next`` of the series rows around them."""
    keys = list(keys)
    row = F.struct(F.col(at), *values)
    marks = probes.select(*keys, at).where(F.col(at).isNotNull()).distinct().withColumn("_kind", F.lit(1))
    points = series.select(*keys, at, F.lit(0).alias("_kind"), row.alias("_row"))
    merged = marks.unionByName(points, allowMissingColumns=True)
    columns = {"_prev": ("last", F.col("_row"))}
    if both:
        columns["_next"] = ("next", F.col("_row"))
    block = F.floor(F.col(at) / F.lit(width)).cast("long")
    out = running(merged, columns, keys=keys, order=(at, "_kind"), block=block)
    return out.where(F.col("_kind") == 1).drop("_kind", "_row")


def nearest(
    probes: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    at: str = "epoch",
    limit: float | None = None,
    width: float = 7 * DAY,
    prefix: str = "near_",
) -> DataFrame:
    """Each probe with the closest series row on axis ``at``; the earlier one on ties.

    Adds ``{prefix}{at}``, ``{prefix}{value}`` and ``gap``; null beyond ``limit`` or without a series.
    """
    around = _neighbours(probes, series, keys, at, values, width, True)
    back, ahead = F.col(at) - F.col(f"_prev.{at}"), F.col(f"_next.{at}") - F.col(at)
    use_back = F.col("_prev").isNotNull() & (F.col("_next").isNull() | (back <= ahead))
    pick = F.when(use_back, F.col("_prev")).otherwise(F.col("_next"))
    gap = F.when(use_back, back).otherwise(ahead)
    around = around.withColumn("_pick", pick).withColumn("gap", gap).drop("_prev", "_next")
    if limit is not None:
        near = F.col("gap") <= limit
        around = around.withColumns({"_pick": F.when(near, F.col("_pick")), "gap": F.when(near, F.col("gap"))})
    out = probes.join(around, [*keys, at], "left")
    return out.withColumns({f"{prefix}{v}": F.col(f"_pick.{v}") for v in (at, *values)}).drop("_pick")


def price_source(gap: Column) -> Column:
    """How a price was found: on time, near, from the day, or not at all."""
    return (
        F.when(gap.isNull(), "failed").when(gap == 0, "exact").when(gap <= 3600, "nearest_bar").otherwise("day_close")
    )


def backward(
    probes: DataFrame, series: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "epoch", width: float = 7 * DAY
) -> DataFrame:
    """Each probe with the latest series row at or before it."""
    around = _neighbours(probes, series, keys, at, values, width, False)
    out = probes.join(around, [*keys, at], "left")
    return out.withColumns({f"asof_{v}": F.col(f"_prev.{v}") for v in (at, *values)}).drop("_prev")


def exact(probes: DataFrame, series: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "epoch") -> DataFrame:
    """Equality lookup on key and time; missing prices stay null."""
    return probes.join(series.select(*keys, at, *values), [*keys, at], "left")


def snap_trades(trades: DataFrame, bars: DataFrame, limit: int = 60) -> DataFrame:
    """Trades with the nearest bar's time, and that bar's high/low when less than ``limit`` seconds away."""
    out = nearest(trades, bars, ["symbol"], ["high", "low"])
    close = F.col("gap") < limit
    return out.withColumns(
        {
            "snap_epoch": F.coalesce("near_epoch", "epoch"),
            "candle_high": F.when(close, F.col("near_high")).otherwise(F.col("price")),
            "candle_low": F.when(close, F.col("near_low")).otherwise(F.col("price")),
        }
    ).drop("near_epoch", "near_high", "near_low", "gap")


def map_timeframe(bars: DataFrame, higher: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower-timeframe bars with the values of the latest higher-timeframe bar begun by then."""
    return backward(bars, higher, ["symbol"], columns)


def unseen(trades: DataFrame, emitted: DataFrame, now: Column, keys: Sequence[str] = ("symbol", "epoch", "type", "price")) -> DataFrame:
    """Trades due by ``now`` that were not emitted before."""
    return trades.where(F.col("epoch") <= now).join(emitted.select(*keys), list(keys), "left_anti")
