"""Symbol text rules: routing, metadata, pair aliases, resolution tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDIA, NEW_YORK = "Asia/Kolkata", "America/New_York"

# fixed values: minutes an exchange offers per bar, and what other resolutions fall back to
OFFERED_MINUTES = (1, 5, 15, 30, 60, 240, 1440, 10080, 21600)
NAMED_MINUTES = {"D": 1440, "1D": 1440, "W": 10080, "1W": 10080, "M": 21600, "1M": 21600}
UNIT_SECONDS = {"S": 1, "M": 60, "H": 3600, "D": 86400, "W": 604800}


def indian(symbol: Column) -> Column:
    return symbol.contains(".NS") | symbol.contains(".BO") | symbol.startswith("^NSE")


def exchange_zone(symbol: Column) -> Column:
    return F.when(indian(symbol), INDIA).otherwise(NEW_YORK)


def localize(local: Column, zone: Column) -> Column:
    """Epoch seconds of a zone-less local time."""
    return F.unix_timestamp(F.to_utc_timestamp(local, zone))


def symbol_info(symbol: Column) -> dict[str, Column]:
    """Zone, session, type and exchange text of a symbol."""
    home = indian(symbol)
    kind = F.when(symbol.startswith("^") | symbol.contains("INDEX") | symbol.contains("NIFTY"), "index").otherwise("stock")
    exchange = F.when(symbol.contains(".BO"), "BSE").when(home, "NSE").otherwise("US")
    return {
        "timezone": exchange_zone(symbol),
        "session": F.when(home, "0915-1530").otherwise("0930-1600"),
        "type": kind,
        "exchange": exchange,
        "pricescale": F.lit(100),
        "minmov": F.lit(1),
    }


def route_source(symbol: Column) -> dict[str, Column]:
    """Which source serves a symbol, and the symbol without its route suffix."""
    clean = F.replace(symbol, F.lit(":YF"), F.lit(""))
    yahoo = symbol.endswith(":YF") | clean.startswith("^") | clean.endswith(".NS") | clean.endswith(".BO")
    return {"source": F.when(yahoo, "yahoo").otherwise("broker"), "clean_symbol": F.when(yahoo, clean).otherwise(symbol)}


def pair_alias(pair: Column) -> Column:
    """Exchange pair names to common ones: XBT is BTC, XDG is DOGE."""
    return F.replace(F.replace(pair, F.lit("XBT"), F.lit("BTC")), F.lit("XDG"), F.lit("DOGE"))


def pair_unalias(pair: Column) -> Column:
    return F.replace(F.replace(pair, F.lit("BTC"), F.lit("XBT")), F.lit("DOGE"), F.lit("XDG"))


def offered_minutes(resolution: Column) -> Column:
    """Bar minutes of a resolution; unsupported numbers give 60, other text 1440."""
    number = F.regexp_extract(resolution, r"^\s*(\d+)", 1).try_cast("int")
    named = None
    for name, minutes in NAMED_MINUTES.items():
        named = F.when(resolution == name, minutes) if named is None else named.when(resolution == name, minutes)
    return named.when(number.isin(*OFFERED_MINUTES), number).when(number.isNotNull(), 60).otherwise(1440)


def resolution_seconds(resolution: Column) -> Column:
    """Seconds of ``30S``, ``5M`` (minutes), ``4H``, ``D``, ``2W`` or plain minutes."""
    unit = F.substring(resolution, -1, 1)
    number = F.regexp_extract(resolution, r"^(\d+)", 1).try_cast("int")
    out = F.when(resolution.isin("D", "1D"), 86400)
    for name, seconds in UNIT_SECONDS.items():
        out = out.when(unit == name, number * seconds)
    return out.otherwise(number * 60)


def period_seconds(resolution: Column, bars: Column) -> Column:
    """Length of ``bars`` bars: days, weeks, 31-day months or minutes."""
    days = (
        F.when(resolution.isin("D", "1D"), bars)
        .when(resolution.isin("M", "1M"), bars * 31)
        .when(resolution.isin("W", "1W"), bars * 7)
        .otherwise(bars * resolution.try_cast("int") / 1440)
    )
    return days * 86400


MILLIS_FROM = 2_000_000_000


def to_seconds(time: Column) -> Column:
    """Epoch in seconds or milliseconds to seconds."""
    return F.when(time < MILLIS_FROM, time).otherwise(F.floor(time / 1000))


def to_millis(time: Column) -> Column:
    return F.when(time > MILLIS_FROM, time).otherwise(time * 1000)


def align_daily(epoch: Column) -> Column:
    """UTC midnight of the bar's day."""
    return (F.floor(epoch / 86400) * 86400).cast("long")
