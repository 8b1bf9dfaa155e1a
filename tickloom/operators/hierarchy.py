"""Pivot hierarchy per bar: outer container, inner sequence and anchor.

For a bar the rules look back to the nearest confirmed level beyond the close, however far that is, and to the extreme since. Both come from one
search over trees of block extremes (``levels``), once with lows under a falling market and once, prices negated, with highs over a rising one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.geometry import FRACTIONS, fan_lines, price_at
from tickloom.operators.blocks import framed, running
from tickloom.operators.hulls import HULL_ROWS, SLACK, crossed_blocks, hulls, in_blocks, some_above, some_below
from tickloom.operators.levels import FANOUT, level_tree, levels_between, nearest_below
from tickloom.operators.pivots import alternate_pivots, last_pivots, raw_pivots, with_runs
from tickloom.session import settle


def select(close: float, context: str, kinds, prices, times):
    """Indices ``(anchor, outer far, outer near, inner list)`` into the visible pivots of one bar.

    Written for a falling market; a rising one is the same picture with prices negated.
    """
    sign, near_kind = (1.0, "low") if context == "bearish" else (-1.0, "high")
    score, here = sign * prices, sign * close
    near = np.flatnonzero(kinds == near_kind)
    anchor = near[-1] if len(near) and here >= score[near[-1]] else None
    below = near[score[near] < here]
    if not len(below):
        return anchor, None, None, []
    outer_near = below[-1]
    far = np.flatnonzero(kinds != near_kind)
    far = far[far > outer_near]
    if not len(far):
        return anchor, None, None, []
    outer_far = far[np.argmax(score[far])]
    if anchor is None:
        return anchor, outer_far, outer_near, []
    open_far = far[(times[far] > times[outer_near]) & (times[far] != times[outer_far]) & (score[far] > here)]
    if not len(open_far):
        return anchor, outer_far, outer_near, []
    best_before = np.concatenate(([-np.inf], np.maximum.accumulate(score[open_far])[:-1]))
    return anchor, outer_far, outer_near, list(open_far[score[open_far] > best_before])


def hierarchy(bars: DataFrame, left: int = 5, right: int = 5, fanout: int = FANOUT) -> DataFrame:
    """One row per bar that has a confirmed pivot behind it.

    Columns are ``symbol, epoch, bar_index, close, context`` and the points (``epoch, price, bar_index``) ``origin, anchor, outer_from, outer_to`` and
    the array ``inner``. ``bars`` should be settled, they are read more than once.
    """
    runs = settle(with_runs(settle(raw_pivots(bars, left, right))))
    confirmed = settle(alternate_pivots(runs).where(F.col("confirm_index").isNotNull()))
    point, high = F.struct("epoch", "price", "bar_index"), F.col("type") == "high"

    news = confirmed.groupBy("symbol", F.col("confirm_index").alias("_at")).agg(
        F.max_by(point, F.when(high, F.col("run"))).alias("_high"), F.max_by(point, F.when(~high, F.col("run"))).alias("_low"), F.max("run").alias("_run")
    ).withColumnRenamed("_at", "bar_index")
    revealed = last_pivots(runs).withColumnRenamed("at_index", "bar_index")
    seen = running(
        bars.select("symbol", "epoch", "bar_index", "close").join(news, ["symbol", "bar_index"], "left").join(revealed, ["symbol", "bar_index"], "left"),
        {"last_run": ("last", F.col("_run")), "_lows": ("last", F.col("_low")), "_highs": ("last", F.col("_high")), "_last": ("last", F.col("last_pivot"))},
    )
    bearish = F.col("context") == "bearish"
    sign = F.when(bearish, 1.0).otherwise(-1.0)
    probes = seen.where(F.col("last_run").isNotNull()).withColumn("context", F.when(F.col("_last.type") == "low", "bullish").otherwise("bearish"))
    near_point = F.when(bearish, F.col("_lows")).otherwise(F.col("_highs"))
    probes = probes.withColumn("value", sign * F.col("close")).select(
        "symbol", "epoch", "bar_index", "close", "context", "last_run", "value",
        F.struct("_last.epoch", "_last.price", "_last.bar_index").alias("origin"),
        F.when(F.col("value") >= sign * near_point["price"], near_point).alias("anchor"),
    )

    sides = confirmed.withColumn("context", F.explode(F.array(F.lit("bearish"), F.lit("bullish"))))
    near = high != bearish
    score = sign * F.col("price")
    levels = sides.select(
        "symbol", "context", "run", F.when(near, score).alias("near"),
        F.when(~near, F.struct(score.alias("score"), (-F.col("run")).alias("early"), point.alias("point"))).alias("far"), point.alias("point"),
    )
    keys = ["symbol", "context"]
    tables = level_tree(levels, keys, fanout)
    found = nearest_below(probes, tables, keys, fanout)
    # an inner sequence needs a level under the close before the anchor, which the close then equals
    rare = found.where((F.col("value") == sign * F.col("anchor.price")) & F.col("far").isNotNull())
    rare = settle(rare.withColumn("first_run", F.col("near.id") + 1))
    inside = lambda k: (k["far"]["score"] > F.col("value")) & (k["point"]["epoch"] > F.col("near.point.epoch")) & (k["point"]["epoch"] != F.col("far.point.epoch"))
    inner = levels_between(rare, tables, keys, ["symbol", "bar_index"], inside, fanout).select("symbol", "bar_index", F.transform("levels", lambda k: k["point"]).alias("_inner"))
    outer = F.col("far").isNotNull()
    return found.join(inner, ["symbol", "bar_index"], "left").select(
        "symbol", "epoch", "bar_index", "close", "context", "origin", "anchor",
        F.col("far.point").alias("outer_from"), F.when(outer, F.col("near.point")).alias("outer_to"),
        F.coalesce("_inner", F.array().cast("array<struct<epoch:bigint,price:double,bar_index:bigint>>")).alias("inner"),
    )


def active_pair(tree: DataFrame) -> DataFrame:
    """Outer container only."""
    return tree.where(F.col("outer_from").isNotNull()).select(
        "symbol", "epoch", "bar_index", "context", "outer_from", "outer_to"
    )


def drawn_pairs(tree: DataFrame, max_inner: int = 3) -> DataFrame:
    """Per bar, the outer pair and the first ``max_inner`` inner pairs with their stable ids."""
    pair = lambda kind, a, b: F.struct(
        F.lit(kind).alias("pair_type"),
        a.alias("from"),
        b.alias("to"),
        F.concat_ws("_", a["epoch"], b["epoch"], F.lit(kind)).alias("pair_id"),
    )
    outer = F.when(F.col("outer_from").isNotNull(), F.array(pair("outer", F.col("outer_from"), F.col("outer_to"))))
    inner = F.transform(F.slice("inner", 1, max_inner), lambda p: pair("inner", p, F.col("anchor")))
    pairs = F.concat(F.coalesce(outer, F.array()), inner)
    return tree.select("symbol", "epoch", "bar_index", "context", pairs.alias("pairs"))


def fans(tree: DataFrame, scale: float = 1.0, max_inner: int = 3, fractions=FRACTIONS) -> DataFrame:
    """Every distinct fan drawn over time: one row per line, with the bar that first drew it."""
    pairs = drawn_pairs(tree, max_inner).select("symbol", "epoch", "bar_index", F.inline("pairs"))
    first = pairs.groupBy("symbol", "pair_id", "pair_type", "from", "to").agg(
        F.min("bar_index").alias("drawn_index"), F.min("epoch").alias("drawn_epoch")
    )
    rising = F.col("to.price") > F.col("from.price")
    return first.select(
        "symbol",
        F.col("pair_id").alias("fan_id"),
        "pair_type",
        "drawn_index",
        "drawn_epoch",
        rising.alias("rising"),
        F.inline(fan_lines(F.col("from"), F.col("to"), scale, fractions)),
    )


def join_active(bars: DataFrame, lines: DataFrame, until, width: int) -> DataFrame:
    """Bars with the lines whose ``[start_time, until]`` holds them, joined per time bucket.

    The bucket makes it an equi-join spread over many keys instead of one cross product per symbol.
    """
    spread = lines.withColumn("_until", until).withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(F.col("start_time") / width), F.floor(F.col("_until") / width))),
    )
    return (
        bars.withColumn("_bucket", F.floor(F.col("epoch") / width))
        .join(spread, ["symbol", "_bucket"])
        .where(F.col("epoch").between(F.col("start_time"), F.col("_until")))
        .withColumn(
            "line_price",
            price_at(F.col("epoch"), F.col("start_time"), F.col("start_price"), F.col("end_time"), F.col("end_price")),
        )
        .drop("_bucket", "_until")
    )


def fan_status(bars: DataFrame, lines: DataFrame, extension_seconds: int = 0, rows: int = HULL_ROWS) -> DataFrame:
    """Per fan, the first bar from its drawing on at which every active fraction line is crossed.

    A fan whose lines have all ended is complete at the bar that draws it: always so with
    ``extension_seconds=0``, because lines end at the later pivot.

    Lines of a fan share start and end, so all are crossed where the outermost is. It meets the hull of every block it crosses; opened are the blocks at the ends
    of its time and those up to the first in which a close is surely beyond it.
    """
    drawn = lines.where(F.col("fraction").isNotNull()).groupBy("symbol", "fan_id", "pair_type", "rising", "drawn_epoch", "start_time", "start_price", "end_time")
    fan = settle(drawn.agg(F.when(F.col("rising"), F.min("end_price")).otherwise(F.max("end_price")).alias("end_price")))
    blocked = settle(in_blocks(bars.select("symbol", "epoch", "bar_index", "close"), rows))
    since, until = F.greatest("drawn_epoch", "start_time"), F.col("end_time") + extension_seconds
    beyond = lambda slack: F.when(F.col("rising"), some_below(F.col("lower"), slack=slack)).otherwise(some_above(F.col("upper"), slack=slack))
    met = crossed_blocks(fan, settle(hulls(blocked)), since, until)
    met = settle(met.withColumns({"sure": F.col("whole") & beyond(0.0), "maybe": ~F.col("whole") | beyond(SLACK)}).drop("lower", "upper"))
    first = met.groupBy("symbol", "fan_id").agg(F.min(F.when(F.col("sure"), F.col("block"))).alias("_first"), F.bool_or("whole").alias("_whole"))
    opened = met.where("maybe").join(first, ["symbol", "fan_id"]).where("NOT whole OR _first IS NULL OR block <= _first")
    live = opened.join(blocked, ["symbol", "block"]).where(F.col("epoch").between(since, until))
    line = price_at(F.col("epoch"), F.col("start_time"), F.col("start_price"), F.col("end_time"), F.col("end_price"))
    crossed = F.when(F.col("rising"), F.col("close") < line).otherwise(F.col("close") > line)
    done = live.groupBy("symbol", "fan_id").agg(F.min(F.when(crossed, F.col("epoch"))).alias("_crossed"), F.count(F.lit(1)).alias("_bars"))
    status = fan.join(first, ["symbol", "fan_id"], "left").join(done, ["symbol", "fan_id"], "left")
    idle = ~F.coalesce("_whole", F.lit(False)) & (F.coalesce("_bars", F.lit(0)) == 0)
    return status.select(
        "symbol",
        "fan_id",
        "pair_type",
        "drawn_epoch",
        F.when(idle, F.col("drawn_epoch")).otherwise(F.col("_crossed")).alias("completed_epoch"),
        F.when(idle, "inactive").when(F.col("_crossed").isNotNull(), "covered").otherwise("open").alias("status"),
    )


def fan_changes(tree: DataFrame, max_inner: int = 3) -> DataFrame:
    """Per bar, the fan ids to add and to remove, and whether the hierarchy counts as changed.

    ``tree`` has a row for every bar from the first confirmed pivot on, so the previous row is the
    previous bar.
    """
    ids = drawn_pairs(tree, max_inner).select(
        "symbol", "epoch", "bar_index", F.transform("pairs", lambda p: p["pair_id"]).alias("ids")
    )
    shape = F.struct(
        "context",
        F.col("outer_from.epoch").alias("a"),
        F.col("outer_to.epoch").alias("b"),
        F.transform("inner", lambda p: p["epoch"]).alias("c"),
    )
    rows = tree.select("symbol", "bar_index", shape.alias("_shape")).join(ids, ["symbol", "bar_index"])

    def add(df, w):
        before = F.coalesce(F.lag("ids").over(w), F.array().cast("array<string>"))
        return df.withColumns(
            {
                "added": F.array_except("ids", before),
                "removed": F.array_except(before, F.col("ids")),
                "changed": ~F.col("_shape").eqNullSafe(F.lag("_shape").over(w)),
            }
        )

    return framed(rows, 1, 0, add).drop("_shape")


def pivot_markers(tree: DataFrame, max_inner: int = 3) -> DataFrame:
    """Markers of a bar's hierarchy, one per pivot time: origin, outer pair, anchor, inner starts."""
    near = F.when(F.col("context") == "bearish", "low").otherwise("high")
    far = F.when(F.col("context") == "bearish", "high").otherwise("low")
    mark = lambda p, kind, rank: F.when(
        p.isNotNull(), F.struct(p["epoch"].alias("time"), F.lit(rank).alias("rank"), kind.alias("type"), p["price"].alias("price"))
    )
    found = F.array_compact(
        F.array(
            mark(F.col("origin"), far, 0),
            mark(F.col("outer_from"), far, 1),
            mark(F.col("outer_to"), near, 2),
            mark(F.col("anchor"), near, 3),
        )
    )
    inner = F.transform(F.slice("inner", 1, max_inner), lambda p: F.struct(p["epoch"].alias("time"), F.lit(4).alias("rank"), far.alias("type"), p["price"].alias("price")))
    rows = tree.select("symbol", "epoch", "bar_index", F.inline(F.concat(found, inner)))
    return (
        rows.groupBy("symbol", "epoch", "bar_index", "time")
        .agg(F.min_by(F.struct("type", "price"), "rank").alias("_m"))
        .select("symbol", "epoch", "bar_index", "time", "_m.*", F.concat_ws("_", F.lit("pm"), "time", "_m.type").alias("id"))
    )


def time_squares(lines: DataFrame, steps: int = 3) -> DataFrame:
    """Times at the end of a fan's main line plus 1..steps times its duration."""
    main = lines.where(F.col("fraction").isNull())
    return main.select(
        "symbol",
        "fan_id",
        F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k"),
        "start_time",
        "end_time",
    ).withColumn("time", F.col("end_time") + F.col("k") * (F.col("end_time") - F.col("start_time")))


def confluence(lines: DataFrame, last_fans: int = 5) -> DataFrame:
    """Crossings of fraction lines of two different fans among each symbol's ``last_fans`` newest fans, with ``time`` and ``price``.

    The rank limit leaves at most ``last_fans`` fans per symbol, so the self-join is bounded. Times are solved from the first line's start, since epochs are large against the slopes.
    """
    newest = Window.partitionBy("symbol").orderBy(F.col("drawn_index").desc(), F.col("fan_id").desc())
    fan = lines.where(F.col("fraction").isNotNull()).groupBy("symbol", "fan_id", "drawn_index").agg(
        F.sort_array(F.collect_list(F.struct("fraction", "start_time", "start_price", "end_time", "end_price"))).alias("l")
    )
    fan = fan.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last_fans)
    flat = fan.select("symbol", "fan_id", F.inline("l"))
    slope = (F.col("end_price") - F.col("start_price")) / F.greatest(F.lit(1), F.col("end_time") - F.col("start_time"))
    flat = flat.withColumns({"m": slope, "p": F.col("start_price"), "t": F.col("start_time")})
    side = lambda s: flat.select("symbol", *[F.col(n).alias(f"{s}_{n}") for n in ("fan_id", "fraction", "m", "p", "t")])
    met = side("a").join(side("b"), "symbol").where((F.col("a_fan_id") < F.col("b_fan_id")) & (F.col("a_m") != F.col("b_m")))
    after = (F.col("b_p") - F.col("a_p") + F.col("b_m") * (F.col("a_t") - F.col("b_t"))) / (F.col("a_m") - F.col("b_m"))
    return met.withColumns({"time": F.col("a_t") + after, "price": F.col("a_p") + F.col("a_m") * after})


def confluence_zones(crossings: DataFrame, seconds: int, percent: float) -> DataFrame:
    """Crossings with the zone they form: ``zone`` (from 1 per symbol), its ``strength`` in fan pairs, and whether it is ``confluent`` (two pairs or more).

    A sweep in time order opens a new stretch after a gap of more than ``seconds``; a sweep over the prices of a stretch opens a new zone after a gap of more than ``percent`` of
    the price below. Zones count by time, then price. A symbol's crossings are bounded by its newest fans.
    """
    swept = Window.partitionBy("symbol").orderBy("time", "price", "a_fan_id", "b_fan_id", "a_fraction", "b_fraction")
    late = F.coalesce(F.col("time") - F.lag("time").over(swept) > seconds, F.lit(True))
    rows = crossings.withColumn("_late", late.cast("int")).withColumn("_stretch", F.sum("_late").over(swept.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy("symbol").orderBy("_stretch", "price", "time", "a_fan_id", "b_fan_id", "a_fraction", "b_fraction")
    same = F.lag("_stretch").over(across) == F.col("_stretch")
    apart = ~F.coalesce(same & (F.col("price") - F.lag("price").over(across) <= F.abs(F.lag("price").over(across)) * percent / 100), F.lit(False))
    rows = rows.withColumn("_apart", apart.cast("int")).withColumn("zone", F.sum("_apart").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    pairs = rows.groupBy("symbol", "zone").agg(F.count_distinct("a_fan_id", "b_fan_id").alias("strength"))
    return rows.drop("_late", "_stretch", "_apart").join(pairs, ["symbol", "zone"]).withColumn("confluent", F.col("strength") > 1)
