"""The driver tables seen as ticks, bars, signals and instruments, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import blocks
from tickloom.operators.bars import resample, with_bar_index
from tickloom.session import settle, prepare

HOUR, DAY = 3600, 86400

# order and line number do not always tell two sales of a day apart
SALES_ORDER = ("epoch", "orderkey", "linenumber", "price", "volume")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as ticks: one symbol per event type."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"),
        ts.alias("ts"),
        F.unix_seconds(ts).alias("epoch"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("volume"),
    )


#: Seconds of the bars that ``hourly`` gives; dense twins of queries set it to a minute while they are built.
_seconds = ContextVar("seconds", default=HOUR)


@contextmanager
def dense_bars(block_rows: int = 48) -> Iterator[None]:
    """Bars of a minute instead of an hour, and blocks so small that a symbol has many, for the queries built inside."""
    token, rows = _seconds.set(60), blocks.BLOCK_ROWS
    blocks.BLOCK_ROWS = block_rows
    try:
        yield
    finally:
        _seconds.reset(token)
        blocks.BLOCK_ROWS = rows


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return resample(ticks(spark, sf), _seconds.get(), ("ts",))


def hourly_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars, written once, numbered, and written again: the input of every indexed operator."""
    return settle(with_bar_index(settle(hourly(spark, sf))))


def sales_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as ticks: one symbol per supplier, unit price, quantity as volume."""
    ts = F.col("l_shipdate").cast("timestamp")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.unix_seconds(ts).alias("epoch"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("linenumber"),
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return resample(sales_ticks(spark, sf), DAY, SALES_ORDER)


TICKS_SQL = """ticks AS (
  SELECT event_type AS symbol, ts, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, value AS price, 1.0::DOUBLE AS volume
  FROM events)"""

HOURLY_SQL = (
    TICKS_SQL
    + """, bars AS (
  SELECT symbol, CAST(floor(epoch / 3600.0) * 3600 AS BIGINT) AS epoch, arg_min(price, ts) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume
  FROM ticks GROUP BY 1, 2)"""
)

HOUR_SQL, MINUTE_SQL = "floor(epoch / 3600.0) * 3600", "floor(epoch / 60.0) * 60"

INDEXED_SQL = (
    HOURLY_SQL
    + """, ib AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY epoch) - 1 AS bar_index FROM bars)"""
)

SALES_SQL = """sales AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS epoch,
         l_extendedprice / l_quantity AS price, l_quantity AS volume, l_orderkey AS orderkey, l_linenumber AS linenumber
  FROM lineitem)"""

DAILY_SQL = (
    SALES_SQL
    + """, bars AS (
  SELECT symbol, CAST(floor(epoch / 86400.0) * 86400 AS BIGINT) AS epoch,
         arg_min(price, (epoch, orderkey, linenumber, price, volume)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, (epoch, orderkey, linenumber, price, volume)) AS close, sum(volume) AS volume
  FROM sales GROUP BY 1, 2)"""
)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Round doubles before comparing with another engine's summation order."""
    return df.withColumns({n: F.round(F.col(n), places) for n in names})
