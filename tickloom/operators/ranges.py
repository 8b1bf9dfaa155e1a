"""Time-range filters over bars, and requests normalised into ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the request rules
DAILY_BUFFER = 43200
NO_DATA_BEFORE = 1262304000  # 2010-01-01
LONG_RESOLUTIONS = ("1D", "D", "W", "1W", "M", "1M")
BARS_PER_DAY = {"60": 6, "15": 25, "5": 75}
INTERVAL_NAMES = {
    "1": "1m", "2": "2m", "5": "5m", "15": "15m", "30": "30m", "60": "1h", "1H": "1h",
    "D": "1d", "1D": "1d", "W": "1wk", "1W": "1wk", "M": "1mo", "1M": "1mo",
}
INTERVAL_DAYS = {
    "1m": 7, "2m": 60, "5m": 60, "15m": 60, "30m": 60, "60m": 700, "60": 700, "1h": 700,
    "1d": 10000, "1wk": 10000, "1mo": 10000,
}
LONGEST_LOOKBACK_DAYS = 3650
UNLIMITED_DAYS = 36500
EARLIEST_EPOCH = 946684800  # 2000-01-01
YEAR_SECONDS = 31536000

#: How far back an intraday resolution reaches, as its interval does.
HISTORY_DAYS = {r: INTERVAL_DAYS[n] for r, n in INTERVAL_NAMES.items() if r not in LONG_RESOLUTIONS} | {"90": INTERVAL_DAYS["60m"]}


def range_start(start: Column, resolution: Column) -> Column:
    """Daily and longer bars may be stamped at exchange midnight: look 12 hours further back."""
    return F.when(resolution.isin(*LONG_RESOLUTIONS), start - DAILY_BUFFER).otherwise(start)


def bars_between(bars: DataFrame, start: int, end: int, resolution: str = "60") -> DataFrame:
    """Inclusive range; plain comparisons with literals, so the scan prunes by statistics."""
    first = start - DAILY_BUFFER if resolution in LONG_RESOLUTIONS else start
    return bars.where((F.col("epoch") >= first) & (F.col("epoch") <= end))


def bars_between_relaxed(bars: DataFrame, start: int, end: int, resolution: str = "60") -> DataFrame:
    """The range; for symbols that end before ``start`` all their bars up to ``end`` instead."""
    first = start - DAILY_BUFFER if resolution in LONG_RESOLUTIONS else start
    inside = (F.col("epoch") >= first) & (F.col("epoch") <= end)
    facts = bars.groupBy("symbol").agg(F.max("epoch").alias("_last"), F.count_if(inside).alias("_hits"))
    ended = (F.col("_hits") == 0) & (F.lit(start) > F.col("_last"))
    return bars.join(facts, "symbol").where(inside | (ended & (F.col("epoch") <= end))).drop("_last", "_hits")


def range_status(requests: DataFrame, bars: DataFrame, width: int = 30 * 86400) -> DataFrame:
    """Requests (``symbol, start, end``) with bar counts and ``ok``/``no_data``.

    Counts come from the number of bars at or before each end of the range (a running count), not
    from joining every bar of the range.
    """
    from tickloom.operators.asof import backward
    from tickloom.operators.blocks import running

    block = F.floor(F.col("epoch") / width)
    counted = running(bars.select("symbol", "epoch"), {"n": ("count", F.lit(1))}, order=("epoch",), block=block)
    # both ends stay columns of their request, so equal requests stay rows of their own
    upto = backward(requests.withColumn("epoch", F.col("end")), counted, ["symbol"], ["n"]).withColumn("_upto", F.coalesce("asof_n", F.lit(0)))
    upto = upto.select(*requests.columns, "_upto")
    before = backward(upto.withColumn("epoch", F.col("start") - 1), counted, ["symbol"], ["n"])
    out = before.withColumn("bars", F.col("_upto") - F.coalesce("asof_n", F.lit(0))).select(*requests.columns, "bars")
    status = F.when((F.col("bars") == 0) & (F.col("end") < NO_DATA_BEFORE), "no_data").otherwise("ok")
    return out.withColumn("status", status)


def local_day_bounds(day_from: Column, day_to: Column, zone: str) -> tuple[Column, Column]:
    """Epochs of the first and last second of a local calendar range."""
    start = F.unix_timestamp(F.to_utc_timestamp(day_from.cast("timestamp"), zone))
    stop = F.unix_timestamp(F.to_utc_timestamp(F.date_add(day_to.cast("date"), 1).cast("timestamp"), zone)) - 1
    return start, stop


def filter_local_days(rows: DataFrame, day_from: str, day_to: str, zone: str = "Asia/Kolkata") -> DataFrame:
    """Bars or trades inside a local calendar range, end day included to 23:59:59."""
    start, stop = local_day_bounds(F.lit(day_from), F.lit(day_to), zone)
    return rows.where(F.col("epoch").between(start, stop))


def _to_friday(day: Column) -> Column:
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def normalize_range(requests: DataFrame, today: Column, start: str = "start_day", end: str = "end_day") -> DataFrame:
    """Weekend edges move to Friday, future ends to today, recent single days become three days."""
    last = _to_friday(F.col(end))
    last = F.when(last > today, _to_friday(today)).otherwise(last)
    first = _to_friday(F.col(start))
    out = requests.withColumns({end: last, start: first})
    single = (F.col(start) == F.col(end)) & (F.datediff(today, F.col(end)) <= 3)
    return out.withColumn(start, F.when(single, F.date_sub(start, 2)).otherwise(F.col(start)))


def expand_lookback(requests: DataFrame, start: str = "start_day") -> DataFrame:
    """Move a start back by its ``lookback_bars`` in days, times four plus 30, at most LONGEST_LOOKBACK_DAYS."""
    bars, res = F.col("lookback_bars"), F.col("resolution")
    days = F.when(res.isin("1D", "D"), bars)
    for name, n in BARS_PER_DAY.items():
        days = days.when(res == name, F.greatest(F.lit(1), F.floor(bars / n)))
    days = days.otherwise(F.greatest(F.lit(1), F.floor(bars / 375)))
    back = F.when(bars > 0, F.least(days * 4 + 30, F.lit(LONGEST_LOOKBACK_DAYS))).otherwise(0).cast("int")
    return requests.withColumns({"lookback_days": back, start: F.date_sub(start, back)})


def chunk_ranges(requests: DataFrame, days: int = 80, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Split timestamp ranges into pieces of ``days``; the next starts a day later.

    A piece that ends at midnight is extended to 15:30 of that day.
    """
    step = F.expr(f"interval {days + 1} days")
    out = requests.withColumn("chunk_start", F.explode(F.sequence(F.col(start), F.col(end), step)))
    stop = F.least(F.col("chunk_start") + F.expr(f"interval {days} days"), F.col(end))
    midnight = (F.hour(stop) == 0) & (F.minute(stop) == 0)
    return out.withColumn("chunk_end", F.when(midnight, stop + F.expr("interval 930 minutes")).otherwise(stop))


def clamp_history(requests: DataFrame, today: Column, start: str = "start_day", end: str = "end_day") -> DataFrame:
    """Cap requests to what an interval offers; old one-minute requests become hourly."""
    from tickloom.operators.contracts import lookup

    name = lookup(INTERVAL_NAMES, F.col("resolution"), "1d")
    cap = lookup(INTERVAL_DAYS, name, 60)
    first = F.when(F.datediff(F.col(end), F.col(start)) > cap, F.date_sub(F.col(end), cap)).otherwise(F.col(start))
    out = requests.withColumn(start, first)
    age = F.datediff(today, F.col(start))
    res = F.col("resolution")
    limit = lookup(HISTORY_DAYS, res, UNLIMITED_DAYS)
    coarser = (age > limit) & (res == "1")
    limit = F.when(coarser, HISTORY_DAYS["60"]).otherwise(limit)
    out = out.withColumns({"_age": age, "_limit": limit, "_coarser": coarser})
    clamped = F.when(F.col("_age") > F.col("_limit"), F.date_sub(today, (F.col("_limit") - 1).cast("int"))).otherwise(F.col(start))
    return out.withColumns(
        {
            start: clamped,
            "resolution": F.when(F.col("_coarser"), "60").otherwise(F.col("resolution")),
        }
    ).withColumn("interval", lookup(INTERVAL_NAMES, F.col("resolution"), "1d")).drop("_age", "_limit", "_coarser")


def visible_bars(bars: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """Bars of a range that a replay at bar ``step`` may show."""
    return bars.where(F.col("epoch").between(start, end) & (F.col("bar_index") <= step))


def filter_events(
    events: DataFrame, start: int, end: int, types: list[str] | None = None, angles: list[str] | None = None
) -> DataFrame:
    """Pivots or events inside an inclusive time range, optionally of given types or angles."""
    kind = "event_type" if "event_type" in events.columns else "type"
    out = events.where(F.col("epoch").between(start, end))
    if types is not None:
        out = out.where(F.col(kind).isin(types))
    if angles is not None:
        out = out.where(F.col("angle_name").isin(angles))
    return out


def validate_epochs(rows: DataFrame, batch: str, anchor: Column | None = None) -> DataFrame:
    """Keep batches whose last time is after 2000-01-01 and within 365 days of ``anchor``."""
    last = rows.groupBy(batch).agg(F.max("epoch").alias("_last"))
    good = F.col("_last") > EARLIEST_EPOCH
    if anchor is not None:
        good = good & (F.abs(F.col("_last") - anchor) <= YEAR_SECONDS)
    return rows.join(last.where(good), batch, "left_semi")
