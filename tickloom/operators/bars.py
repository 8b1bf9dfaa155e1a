"""Bars from ticks, clean-up of bar tables and simple bar projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import index_rows
from tickloom.session import settle

OHLCV = ("open", "high", "low", "close", "volume")


def resample(ticks: DataFrame, seconds: int, order: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Ticks (``symbol, epoch, price, volume``) to OHLCV bars of ``seconds``; gaps stay gaps.

    One hash aggregate with map-side combine, so a hot symbol costs one partial row per bar and task.
    ``order`` names the columns that decide first and last price.
    """
    # a plain column keeps this a hash aggregate; a struct key would need a sort of all ticks
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    bucket = (F.floor(F.col("epoch") / F.lit(seconds)) * seconds).cast("long")
    return (
        ticks.withColumn("_bucket", bucket)
        .groupBy("symbol", F.col("_bucket").alias("bucket"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bucket", "epoch")
    )


def rebar(bars: DataFrame, seconds: int) -> DataFrame:
    """Coarser bars from finer bars."""
    bucket = (F.floor(F.col("epoch") / F.lit(seconds)) * seconds).cast("long")
    return (
        bars.withColumn("_bucket", bucket)
        .groupBy("symbol", "_bucket")
        .agg(
            F.min_by("open", "epoch").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "epoch").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("_bucket", "epoch")
    )


def resample_all(ticks: DataFrame, resolutions: tuple[int, ...], order: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Bars of several resolutions from one pass over the ticks: ``symbol, seconds, epoch`` and OHLCV.

    The finest bars are made from the ticks and written once; all others are rolled up from them together, since first, last, highest, lowest and sum of parts
    merge. Every resolution must be a multiple of the finest.
    """
    finest = min(resolutions)
    if any(r % finest for r in resolutions):
        raise ValueError("every resolution must be a multiple of the finest")
    fine = settle(resample(ticks, finest, order))
    each = fine.withColumn("seconds", F.explode(F.array(*[F.lit(r) for r in resolutions])))
    return (
        each.groupBy("symbol", "seconds", F.expr("epoch - pmod(epoch, seconds)").alias("bucket"))
        .agg(
            F.min_by("open", "epoch").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "epoch").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bucket", "epoch")
    )


def dedupe_bars(bars: DataFrame, tiebreak: tuple[str, ...], keys: tuple[str, ...] = ("symbol", "epoch")) -> DataFrame:
    """Keep one row per key: the first by ``tiebreak``. An aggregate, so copies combine map-side."""
    rest = [c for c in bars.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*tiebreak)).alias("_row")
    return bars.groupBy(*keys).agg(packed).select(*keys, "_row.*")


def with_bar_index(bars: DataFrame) -> DataFrame:
    """Add ``bar_index``, counted from 0 per symbol in time order."""
    return index_rows(bars)


def to_candles(bars: DataFrame) -> DataFrame:
    """The consumer's candle shape: ``time`` instead of ``epoch``; volume optional, 0 when absent."""
    volume = F.coalesce(F.col("volume"), F.lit(0.0)) if "volume" in bars.columns else F.lit(0.0)
    return bars.select(
        "symbol", F.col("epoch").alias("time"), "open", "high", "low", "close", volume.alias("volume")
    )


def bars_to_arrays(bars: DataFrame, chunk_seconds: int = 30 * 86400) -> DataFrame:
    """One row of parallel arrays per symbol and time chunk, nulls as 0, with a status.

    The arrays are cut by ``chunk_seconds`` so that no row grows with a symbol's history; readers
    concatenate chunks in order.
    """
    packed = F.sort_array(F.collect_list(F.struct("epoch", *OHLCV)))
    zero = lambda name: F.transform("rows", lambda r: F.coalesce(r[name], F.lit(0.0)))
    return (
        bars.withColumn("chunk", F.floor(F.col("epoch") / chunk_seconds).cast("long"))
        .groupBy("symbol", "chunk")
        .agg(packed.alias("rows"))
        .select(
            "symbol",
            "chunk",
            F.when(F.size("rows") > 0, "ok").otherwise("no_data").alias("s"),
            F.transform("rows", lambda r: r["epoch"]).alias("t"),
            zero("open").alias("o"),
            zero("high").alias("h"),
            zero("low").alias("l"),
            zero("close").alias("c"),
            zero("volume").alias("v"),
        )
    )


def coverage(bars: DataFrame) -> DataFrame:
    """First and last time and number of bars per symbol."""
    return bars.groupBy("symbol").agg(
        F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.count(F.lit(1)).alias("bars")
    )


def merge_pages(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Union two pages of bars; a bar in both is kept once, from ``older``."""
    tagged = older.withColumn("_page", F.lit(0)).unionByName(newer.withColumn("_page", F.lit(1)))
    return dedupe_bars(tagged, ("_page",)).drop("_page")


def recent_first(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of each symbol (rank limit keeps at most n rows per map task and symbol)."""
    w = Window.partitionBy("symbol").orderBy(F.col("epoch").desc())
    return bars.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
