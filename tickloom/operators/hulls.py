"""Convex hulls of closes per time block, so that a line is tested against a block before its bars are opened.

Whether some close of a block lies below (above) a line is decided on the lower (upper) hull alone, a few points however many bars the block
holds. Rules on lines meet one row per block they cross and then only the bars of blocks they can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.geometry import price_at

#: Bars of a block.
HULL_ROWS = 256
#: Share of the prices within which a hull point counts as possibly on the other side, because interpolated prices are rounded.
SLACK = 1e-9

POINTS = "array<struct<epoch:bigint,close:double>>"


def _chain(points: list[dict], sign: float) -> list[dict]:
    """The lower hull of points in time order for a sign of 1, the upper one for -1."""
    out: list[dict] = []
    for p in points:
        while len(out) > 1:
            a, b = out[-2], out[-1]
            turn = (b["epoch"] - a["epoch"]) * (p["close"] - a["close"]) - (b["close"] - a["close"]) * (p["epoch"] - a["epoch"])
            if sign * turn > 0:
                break
            out.pop()
        out.append(p)
    return out


def _hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("epoch", pa.int64()), ("close", pa.float64())]))
    for batch in batches:
        points = batch.column("points").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("symbol", "block")),
                pa.array([p[0]["epoch"] for p in points], pa.int64()),
                pa.array([p[-1]["epoch"] for p in points], pa.int64()),
                *(pa.array([_chain(p, sign) for p in points], kind) for sign in (1.0, -1.0)),
            ],
            ["symbol", "block", "first", "last", "lower", "upper"],
        )


def in_blocks(bars: DataFrame, rows: int = HULL_ROWS) -> DataFrame:
    """Bars with a close, and the block of each: ``rows`` bars by ``bar_index``."""
    return bars.where(F.col("close").isNotNull() & ~F.isnan("close")).withColumn("block", F.expr(f"bar_index div {rows}"))


def hulls(blocked: DataFrame) -> DataFrame:
    """``symbol, block, first, last, lower, upper`` of bars with a ``block``; only one block's closes are gathered."""
    points = blocked.groupBy("symbol", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "close"))).alias("points"))
    return points.mapInArrow(_hulls, f"symbol string, block long, first long, last long, lower {POINTS}, upper {POINTS}")


def crossed_blocks(lines: DataFrame, blocks: DataFrame, since: Column, until: Column) -> DataFrame:
    """Lines with the blocks (and their hulls) that hold a bar between the two times, both included; ``whole`` tells whether no bar of it lies outside.

    Blocks and lines meet by equality on time buckets as wide as a symbol's blocks are on average; a pair counts in its first common bucket.
    """
    width = blocks.groupBy("symbol").agg(F.floor((F.max("last") - F.min("first") + 1) / F.count(F.lit(1)) + 1).cast("long").alias("_width"))
    buckets = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div _width"), F.expr(f"{b} div _width")))
    spread = lines.withColumns({"_since": since, "_until": until}).where("_since <= _until").join(width, "symbol")
    # no block lies outside a symbol's time
    ends = blocks.groupBy("symbol").agg(F.min("first").alias("_begin"), F.max("last").alias("_end"))
    spread = spread.join(ends, "symbol").withColumns({"_from": F.greatest("_since", "_begin"), "_to": F.least("_until", "_end")}).where("_from <= _to")
    spread = spread.withColumn("_bucket", buckets("_from", "_to")).drop("_width", "_begin", "_end", "_to")
    held = blocks.join(width, "symbol").withColumn("_bucket", buckets("first", "last"))
    met = spread.join(held, ["symbol", "_bucket"]).where("first <= _until AND last >= _since AND _bucket = greatest(_from div _width, first div _width)")
    return met.withColumn("whole", F.expr("first >= _since AND last <= _until")).drop("_since", "_until", "_from", "_bucket", "_width", "first", "last")


def some_below(hull: Column, factor: float = 1.0, slack: float = 0.0) -> Column:
    """Whether a point of the lower hull lies below ``factor`` times the line; ``slack`` lets it lie that share above."""
    return F.exists(hull, lambda p: p["close"] - slack * F.abs(p["close"]) < factor * _line(p) + slack * F.abs(_line(p)))


def some_above(hull: Column, factor: float = 1.0, slack: float = 0.0) -> Column:
    return F.exists(hull, lambda p: p["close"] + slack * F.abs(p["close"]) > factor * _line(p) - slack * F.abs(_line(p)))


def _line(point: Column) -> Column:
    return price_at(point["epoch"], F.col("start_time"), F.col("start_price"), F.col("end_time"), F.col("end_price"))


def reachable(lower: Column, upper: Column, share: float) -> Column:
    """Whether a close between the hulls can lie within ``share`` of the line's price: not when all lie above, or all below, both edges of that band."""
    edges = (1.0 - share, 1.0 + share)
    above = ~some_below(lower, edges[0], SLACK) & ~some_below(lower, edges[1], SLACK)
    below = ~some_above(upper, edges[0], SLACK) & ~some_above(upper, edges[1], SLACK)
    return ~above & ~below
