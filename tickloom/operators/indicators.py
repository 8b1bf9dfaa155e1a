"""Window indicators. All frames are bounded ROWS frames evaluated in blocks (see ``blocks``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import KEYS, block_rows, framed

EXPONENT_ROOM = 500.0  # ln of the largest scale factor kept in a running weighted sum
SMALLEST_EXPONENT = 745.2  # a factor below exp(-745.2) is zero as a double


def donchian(bars: DataFrame, n: int = 3) -> DataFrame:
    """Highest high and lowest low of the previous ``n`` bars; null until ``n`` bars exist."""

    def add(df, w):
        prior = w.rowsBetween(-n, -1)
        full = F.col("bar_index") >= n
        return df.withColumns(
            {"hh": F.when(full, F.max("high").over(prior)), "ll": F.when(full, F.min("low").over(prior))}
        )

    return framed(bars, n, 0, add)


def _decayed(values: Column, factor: float) -> Column:
    """Sum of an array in which every value counts ``factor`` times less than the one behind it."""
    return F.aggregate(values, F.lit(0.0), lambda total, x: total * F.lit(factor) + x)


def ema(bars: DataFrame, spans: dict[str, int], column: str = "close", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Exponential averages ``{output name: span}``, ``alpha = 2/(span+1)``, seeded with the first value; ``bars`` is settled.

    Within a block the average is a running sum of ``x_j q^-j``, short enough that ``q^-j`` stays finite for every span. Each block then takes
    in the average at the end of the one before it: that is the sum of all earlier blocks' own ends, each ``q^rows`` times smaller
    than the next, taken as far back as a double can tell it from zero. Nothing else is left out, and spans may be mixed.
    """
    keep = {name: 1.0 - 2.0 / (span + 1.0) for name, span in spans.items() if span > 1}
    rows = min([block_rows(), *(max(1, int(EXPONENT_ROOM / -math.log(q))) for q in keep.values())])
    block = F.floor(F.col("bar_index") / F.lit(rows)).cast("long")
    local = Window.partitionBy(*keys, "_block").orderBy("bar_index").rowsBetween(Window.unboundedPreceding, 0)
    out = bars.withColumns({"_block": block, "_at": F.col("bar_index") % F.lit(rows)})
    for name, q in keep.items():
        weight = F.when(F.col("bar_index") == 0, F.lit(1.0)).otherwise(F.lit(1.0 - q))
        total = F.sum(weight * F.col(column) * F.pow(F.lit(q), -F.col("_at"))).over(local)
        out = out.withColumn(f"_own_{name}", total * F.pow(F.lit(q), F.col("_at")))
    if keep:
        chain = Window.partitionBy(*keys).orderBy("_block")
        ends = out.groupBy(*keys, "_block").agg(*(F.max_by(f"_own_{name}", "_at").alias(f"_end_{name}") for name in keep))
        carries = []
        for name, q in keep.items():
            back = max(1, math.ceil(SMALLEST_EXPONENT / (-math.log(q) * rows)))
            earlier = F.collect_list(f"_end_{name}").over(chain.rowsBetween(-back, -1))
            carries.append(_decayed(earlier, q**rows).alias(f"_in_{name}"))
        out = out.join(ends.select(*keys, "_block", *carries), [*keys, "_block"])
    for name, span in spans.items():
        value = F.col(column) if span <= 1 else F.col(f"_in_{name}") * F.pow(F.lit(keep[name]), F.col("_at") + 1) + F.col(f"_own_{name}")
        out = out.withColumn(name, value)
    return out.select(*bars.columns, *spans)


def previous(bars: DataFrame, columns: tuple[str, ...] = ("close",)) -> DataFrame:
    """Previous bar's values (``prev_*``) and the change of ``close``."""

    def add(df, w):
        df = df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})
        return df.withColumn("change", F.col("close") - F.lag("close").over(w))

    return framed(bars, 1, 0, add)


def _rsi_columns(df: DataFrame, w, n: int, strict: bool) -> DataFrame:
    delta = F.col("close") - F.lag("close").over(w)
    df = df.withColumn("_delta", delta)
    frame = w.rowsBetween(-(n - 1), 0)
    gain = F.avg(F.when(F.col("_delta") > 0, F.col("_delta")).otherwise(0.0)).over(frame)
    loss = F.avg(F.when(F.col("_delta") < 0, -F.col("_delta")).otherwise(0.0)).over(frame)
    df = df.withColumns({"_gain": gain, "_loss": loss})
    rs = F.when(F.col("_loss") != 0, F.col("_gain") / F.col("_loss")).otherwise(0.0)
    value = F.when(rs != 0, 100 - 100 / (1 + rs)).otherwise(50.0)
    if strict:
        value = (
            F.when((F.col("_loss") == 0) & (F.col("_gain") > 0), 100.0)
            .when((F.col("_gain") == 0) & (F.col("_loss") > 0), 0.0)
            .otherwise(value)
        )
    return df.withColumn("rsi", F.when(F.col("bar_index") >= n - 1, value)).drop("_delta", "_gain", "_loss")


def rsi(bars: DataFrame, n: int = 14, strict: bool = False) -> DataFrame:
    """RSI on simple means of gains and losses; a zero ratio gives 50 unless ``strict``."""
    return framed(bars, n, 0, lambda df, w: _rsi_columns(df, w, n, strict))


def close_streak(bars: DataFrame, kept: int = 10) -> DataFrame:
    """``up_streak``/``down_streak``: consecutive rising/falling closes within the last ``kept`` closes."""
    cap = kept - 1

    def add(df, w):
        df = df.withColumn("_sign", F.signum(F.col("close") - F.lag("close").over(w)))
        turned = ~F.col("_sign").eqNullSafe(F.lag("_sign").over(w))
        df = df.withColumn("_turn", F.when(turned, F.col("bar_index")))
        since = F.max("_turn").over(w.rowsBetween(-(cap - 1), 0))
        length = F.coalesce(F.col("bar_index") - since + 1, F.lit(cap))
        return df.withColumns(
            {
                "up_streak": F.when(F.col("_sign") > 0, length).otherwise(0).cast("int"),
                "down_streak": F.when(F.col("_sign") < 0, length).otherwise(0).cast("int"),
            }
        ).drop("_sign", "_turn")

    return framed(bars, kept + 1, 0, add)


def _verdict(left: Column, right: Column) -> Column:
    return F.when(left > right, "bullish").when(left < right, "bearish").otherwise("neutral")


def momentum(bars: DataFrame, fast: int = 9, slow: int = 21, n: int = 14) -> DataFrame:
    """EMA and RSI verdicts; empty before bar ``slow``, agreement gives confidence 1, else 0.5."""
    out = rsi(ema(bars, {"ema_9": fast, "ema_21": slow}), n)
    ready = F.col("bar_index") >= slow
    out = out.withColumns({c: F.when(ready, F.col(c)) for c in ("ema_9", "ema_21", "rsi")})
    out = out.withColumns(
        {
            "ema_signal": F.when(ready, _verdict(F.col("ema_9"), F.col("ema_21"))),
            "rsi_signal": F.when(ready, _verdict(F.col("rsi"), F.lit(50.0))),
        }
    )
    agree = (F.col("ema_signal") == F.col("rsi_signal")) & (F.col("ema_signal") != "neutral")
    return out.withColumns(
        {
            "overall_momentum": F.when(ready, F.when(agree, F.col("ema_signal")).otherwise("neutral")),
            "confidence": F.when(ready, F.when(agree, 1.0).otherwise(0.5)).otherwise(0.0),
        }
    )


def alert_candles(bars: DataFrame, span: int = 5) -> DataFrame:
    """EMA plus ``short_alert``/``long_alert``: the previous bar lies wholly above/below its EMA."""
    out = ema(bars, {"ema": span})

    def add(df, w):
        return df.withColumns(
            {
                "short_alert": F.coalesce(F.lag("low").over(w) > F.lag("ema").over(w), F.lit(False)),
                "long_alert": F.coalesce(F.lag("high").over(w) < F.lag("ema").over(w), F.lit(False)),
            }
        )

    return framed(out, 1, 0, add)


def session_vwap(bars: DataFrame, day_seconds: int = 86400) -> DataFrame:
    """Volume-weighted average of the typical price since the session's start, and close vs VWAP.

    A session holds at most ``day_seconds / resolution`` bars, so its window is bounded.
    """
    w = (
        Window.partitionBy("symbol", "session").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    )
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = bars.withColumn("session", F.floor(F.col("epoch") / day_seconds).cast("long"))
    spent, size = F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)
    out = out.withColumn("vwap", F.when(size > 0, spent / size))
    return out.withColumn("vwap_signal", _verdict(F.col("close"), F.col("vwap")))


def candle_patterns(
    bars: DataFrame,
    doji_ratio: float = 0.1,
    wick_ratio: float = 2.0,
    spike: float = 2.0,
    volume_bars: int = 20,
    divergence_bars: int = 5,
    n: int = 14,
) -> DataFrame:
    """Doji, hammer, engulfing, long wicks, volume spike and RSI divergence flags."""
    body = F.abs(F.col("close") - F.col("open"))
    reach = F.col("high") - F.col("low")
    upper = F.col("high") - F.greatest("open", "close")
    lower = F.least("open", "close") - F.col("low")

    def add(df, w):
        df = _rsi_columns(df, w, n, False)
        po, pc = F.lag("open").over(w), F.lag("close").over(w)
        usual = F.avg("volume").over(w.rowsBetween(-volume_bars, -1))
        enough = F.col("bar_index") >= volume_bars
        was, was_rsi = F.lag("close", divergence_bars).over(w), F.lag("rsi", divergence_bars).over(w)
        no = F.lit(False)
        return df.withColumns(
            {
                "doji": (reach > 0) & (body <= doji_ratio * reach),
                "hammer": (body > 0) & (lower >= wick_ratio * body) & (upper <= body),
                "long_upper_wick": (body > 0) & (upper >= wick_ratio * body),
                "long_lower_wick": (body > 0) & (lower >= wick_ratio * body),
                "bullish_engulfing": F.coalesce(
                    (pc < po) & (F.col("close") > F.col("open")) & (F.col("open") <= pc) & (F.col("close") >= po), no
                ),
                "bearish_engulfing": F.coalesce(
                    (pc > po) & (F.col("close") < F.col("open")) & (F.col("open") >= pc) & (F.col("close") <= po), no
                ),
                "volume_spike": F.coalesce(enough & (F.col("volume") > spike * usual), no),
                "bullish_divergence": F.coalesce((F.col("close") < was) & (F.col("rsi") > was_rsi), no),
                "bearish_divergence": F.coalesce((F.col("close") > was) & (F.col("rsi") < was_rsi), no),
            }
        )

    return framed(bars, max(volume_bars, divergence_bars + n, n) + 1, 0, add)
