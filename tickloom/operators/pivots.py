"""Swing pivots, alternating pivots and pivot pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import block_rows, framed, running
from tickloom.session import settle

PIVOT = ("symbol", "bar_index", "epoch", "type", "price")


def raw_pivots(bars: DataFrame, left: int = 5, right: int = 5) -> DataFrame:
    """Bars strictly beyond all ``left`` bars before and ``right`` bars after them.

    ``seq`` orders a high before a low of the same bar; ``visible_index`` is the bar that reveals it.
    """

    def add(df, w):
        back, ahead = w.rowsBetween(-left, -1), w.rowsBetween(1, right)
        full = (F.col("bar_index") >= left) & (F.count("high").over(ahead) == right)
        top = full & (F.col("high") > F.max("high").over(back)) & (F.col("high") > F.max("high").over(ahead))
        bottom = full & (F.col("low") < F.min("low").over(back)) & (F.col("low") < F.min("low").over(ahead))
        pivot = lambda kind, price, seq: F.struct(
            F.lit(kind).alias("type"), F.col(price).alias("price"), F.lit(seq).alias("seq")
        )
        return df.withColumn(
            "_pivots", F.array_compact(F.array(F.when(top, pivot("high", "high", 0)), F.when(bottom, pivot("low", "low", 1))))
        )

    found = framed(bars, left, right, add).where(F.size("_pivots") > 0)
    return found.select(
        "symbol", "bar_index", "epoch", F.inline("_pivots"), (F.col("bar_index") + right).alias("visible_index")
    )


def symmetric_pivots(bars: DataFrame, lookback: int = 10) -> DataFrame:
    return raw_pivots(bars, lookback, lookback)


def with_runs(raw: DataFrame) -> DataFrame:
    """Number the runs of same-type pivots; ``raw`` should be settled, it is read several times."""
    order = ("bar_index", "seq")
    typed = running(raw, {"_before": ("last", F.col("type"))}, order=order, inclusive=False)
    flips = F.when(F.col("_before") != F.col("type"), 1).otherwise(0)
    return running(typed, {"run": ("sum", flips)}, order=order).drop("_before")


def _score(kind: Column, price: Column) -> Column:
    return F.when(kind == "high", price).otherwise(-price)


def alternate_pivots(runs: DataFrame) -> DataFrame:
    """The most extreme pivot of each run (first on ties), confirmed when the next run starts."""
    best = F.struct(_score(F.col("type"), F.col("price")).alias("score"), (-F.col("bar_index")).alias("early"))
    per_run = runs.groupBy("symbol", "run").agg(
        F.max_by(F.struct("bar_index", "epoch", "type", "price"), best).alias("_p"),
        F.min("visible_index").alias("_starts"),
    )
    nexts = per_run.select("symbol", (F.col("run") - 1).alias("run"), F.col("_starts").alias("confirm_index"))
    return per_run.join(nexts, ["symbol", "run"], "left").select("symbol", "run", "_p.*", "confirm_index")


def confirmed_pivots(bars: DataFrame, left: int = 5, right: int = 5) -> DataFrame:
    """Alternating pivots that a later opposite pivot has confirmed."""
    runs = with_runs(settle(raw_pivots(bars, left, right)))
    return alternate_pivots(settle(runs)).where(F.col("confirm_index").isNotNull())


def last_pivots(runs: DataFrame) -> DataFrame:
    """The pivot each raw pivot leaves as the current extreme of its run, by the bar that reveals it."""
    score = _score(F.col("type"), F.col("price"))
    best = F.struct(
        score.alias("score"), (-F.col("bar_index")).alias("early"), F.col("bar_index"), F.col("epoch"), F.col("type"), F.col("price")
    )
    grown = running(runs, {"_best": ("max", best)}, keys=("symbol", "run"), order=("bar_index", "seq"))
    return grown.groupBy("symbol", F.col("visible_index").alias("at_index")).agg(
        F.max_by(F.struct("_best.bar_index", "_best.epoch", "_best.type", "_best.price"), "seq").alias("last_pivot")
    )


def with_last_pivot(bars: DataFrame, runs: DataFrame) -> DataFrame:
    """Bars with ``last_pivot``: the latest revealed pivot of either type, null before the first."""
    revealed = last_pivots(runs).withColumnRenamed("at_index", "bar_index").withColumnRenamed("last_pivot", "_seen")
    marked = bars.join(revealed, ["symbol", "bar_index"], "left")
    return running(marked, {"last_pivot": ("last", F.col("_seen"))}).drop("_seen")


def recent_pivots(raw: DataFrame, before: Column, n: int = 4) -> DataFrame:
    """The last ``n`` pivots of each symbol before bar ``before``.

    Ranks are taken per block first, so at most ``n`` rows of a block reach the final ranking.
    """
    seen = raw.where(F.col("bar_index") < before).withColumn("_block", F.floor(F.col("bar_index") / block_rows()))
    newest = [F.col("bar_index").desc(), F.col("seq").desc()]
    local = F.row_number().over(Window.partitionBy("symbol", "_block").orderBy(*newest))
    final = F.row_number().over(Window.partitionBy("symbol").orderBy(*newest))
    return (
        seen.withColumn("_rank", local)
        .where(F.col("_rank") <= n)
        .withColumn("rank", final)
        .where(F.col("rank") <= n)
        .drop("_rank", "_block")
    )


def _pair(kind: str, high: Column, low: Column) -> Column:
    rising_first = low["epoch"] < high["epoch"]
    return F.struct(
        F.lit(kind).alias("pair_type"),
        F.when(rising_first, low).otherwise(high).alias("first"),
        F.when(rising_first, high).otherwise(low).alias("second"),
        F.when(rising_first, 2).otherwise(1).alias("scenario"),
    )


def pivot_pairs(raw: DataFrame) -> DataFrame:
    """Inner pair (latest high and low) and outer pair (extremes without those two), one pass each.

    The outer pair needs two highs and two lows and is dropped when it equals the inner pair.
    """
    pivot = F.struct("bar_index", "epoch", "type", "price")
    high, low = F.col("type") == "high", F.col("type") == "low"
    latest = raw.groupBy("symbol").agg(
        F.max_by(pivot, F.when(high, F.col("bar_index"))).alias("_rh"),
        F.max_by(pivot, F.when(low, F.col("bar_index"))).alias("_rl"),
    )
    latest = latest.where(F.col("_rh").isNotNull() & F.col("_rl").isNotNull())
    rest = raw.join(latest, "symbol").where(
        F.when(high, F.col("bar_index") != F.col("_rh.bar_index")).otherwise(F.col("bar_index") != F.col("_rl.bar_index"))
    )
    extreme = F.struct(_score(F.col("type"), F.col("price")).alias("score"), (-F.col("bar_index")).alias("early"))
    outer = rest.groupBy("symbol").agg(
        F.max_by(pivot, F.when(high, extreme)).alias("_oh"), F.max_by(pivot, F.when(low, extreme)).alias("_ol")
    )
    both = latest.join(outer, "symbol", "left")
    has_outer = F.col("_oh").isNotNull() & F.col("_ol").isNotNull()
    pairs = both.select(
        "symbol",
        _pair("inner", F.col("_rh"), F.col("_rl")).alias("_inner"),
        F.when(has_outer, _pair("outer", F.col("_oh"), F.col("_ol"))).alias("_outer"),
    )
    differs = (F.col("_outer.first") != F.col("_inner.first")) | (F.col("_outer.second") != F.col("_inner.second"))
    kept = F.array_compact(F.array("_inner", F.when(differs, F.col("_outer"))))
    return pairs.select("symbol", F.inline(kept))


def staircase(pivots: DataFrame) -> DataFrame:
    """Pivots more extreme than every earlier one of their type."""
    score = _score(F.col("type"), F.col("price"))
    seen = running(pivots, {"_top": ("max", score)}, keys=("symbol", "type"), inclusive=False)
    return seen.where(F.col("_top").isNull() | (score > F.col("_top"))).drop("_top")


def visible_at(bars: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Bars as of the pivots confirmed so far: latest confirmed high and low, and how many of each."""
    pivot = F.struct("epoch", "price", "bar_index")
    high = F.col("type") == "high"
    events = confirmed.groupBy("symbol", F.col("confirm_index").alias("_at")).agg(
        F.max_by(pivot, F.when(high, F.col("bar_index"))).alias("_high"),
        F.max_by(pivot, F.when(~high, F.col("bar_index"))).alias("_low"),
        F.count(F.lit(1)).alias("_n"),
    ).withColumnRenamed("_at", "bar_index")
    return running(
        bars.join(events, ["symbol", "bar_index"], "left"),
        {
            "last_high": ("last", F.col("_high")),
            "last_low": ("last", F.col("_low")),
            "pivots_seen": ("sum", F.coalesce("_n", F.lit(0))),
        },
    ).drop("_high", "_low", "_n")
