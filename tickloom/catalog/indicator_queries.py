"""Bars, indicators and window queries over the hourly event bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import inputs
from tickloom.catalog.inputs import DAILY_SQL, HOURLY_SQL, INDEXED_SQL, TICKS_SQL, rounded
from tickloom.catalog.registry import query, with_sql
from tickloom.operators import bars as B
from tickloom.operators import indicators as I
from tickloom.operators.bars import with_bar_index
from tickloom.session import settle


def ema_sql(column: str, span: int, name: str) -> str:
    """EMA as a list fold: exact, for the SQL twin only."""
    a = f"(2.0 / ({span} + 1.0))"
    return (
        f"list_reduce(list({column}) OVER (PARTITION BY symbol ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND "
        f"CURRENT ROW), lambda acc, x : {a} * x + (1.0 - {a}) * acc) AS {name}"
    )


RSI_SQL = """d AS (SELECT *, close - lag(close) OVER w AS delta FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY epoch)),
gl AS (SELECT *, avg(CASE WHEN delta > 0 THEN delta ELSE 0.0 END) OVER f AS gain,
              avg(CASE WHEN delta < 0 THEN -delta ELSE 0.0 END) OVER f AS loss
       FROM d WINDOW f AS (PARTITION BY symbol ORDER BY epoch ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
rs AS (SELECT *, CASE WHEN bar_index >= 13 THEN
         CASE WHEN loss <> 0 AND gain <> 0 THEN 100 - 100 / (1 + gain / loss) ELSE 50.0 END END AS rsi FROM gl)"""

EMA5_SQL = f"em AS (SELECT *, {ema_sql('close', 5, 'ema')} FROM ib)"


@query(
    "a1_resample_hourly",
    with_sql(HOURLY_SQL, "SELECT symbol, epoch, open, high, low, close, volume FROM bars"),
)
def a1_resample_hourly(spark, sf):
    return inputs.hourly(spark, sf).select("symbol", "epoch", "open", "high", "low", "close", "volume")


RESOLUTIONS = (3600, 3 * 3600, 86400)


@query(
    "a1_all_resolutions",
    with_sql(
        TICKS_SQL,
        " UNION ALL ".join(
            f"""(SELECT symbol, {r} AS seconds, CAST(floor(epoch / {r}.0) * {r} AS BIGINT) AS epoch, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, ts) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 3)"""
            for r in RESOLUTIONS
        ),
    ),
)
def a1_all_resolutions(spark, sf):
    return B.resample_all(inputs.ticks(spark, sf), RESOLUTIONS, ("ts",)).select("symbol", "seconds", "epoch", "open", "high", "low", "close", "volume")


@query(
    "a1_resample_daily",
    with_sql(
        DAILY_SQL,
        "SELECT symbol, epoch, open, high, low, close, volume FROM bars",
    ),
)
def a1_resample_daily(spark, sf):
    return inputs.daily(spark, sf).select("symbol", "epoch", "open", "high", "low", "close", "volume")


@query("w18_bar_index", with_sql(INDEXED_SQL, "SELECT symbol, epoch, bar_index FROM ib"))
def w18_bar_index(spark, sf):
    return inputs.hourly_indexed(spark, sf).select("symbol", "epoch", "bar_index")


@query(
    "w1_donchian",
    with_sql(
        INDEXED_SQL,
        """SELECT symbol, epoch, CASE WHEN bar_index >= 3 THEN max(high) OVER w END AS hh,
       CASE WHEN bar_index >= 3 THEN min(low) OVER w END AS ll
FROM ib WINDOW w AS (PARTITION BY symbol ORDER BY epoch ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
    ),
)
def w1_donchian(spark, sf):
    return I.donchian(inputs.hourly_indexed(spark, sf), 3).select("symbol", "epoch", "hh", "ll")


@query(
    "w2_ema",
    with_sql(
        INDEXED_SQL,
        f"""SELECT symbol, epoch, round(e5, 6) AS ema_5, round(e9, 6) AS ema_9, round(e21, 6) AS ema_21
FROM (SELECT symbol, epoch, {ema_sql('close', 5, 'e5')}, {ema_sql('close', 9, 'e9')}, {ema_sql('close', 21, 'e21')}
      FROM ib)""",
    ),
)
def w2_ema(spark, sf):
    out = I.ema(inputs.hourly_indexed(spark, sf), {"ema_5": 5, "ema_9": 9, "ema_21": 21})
    return rounded(out.select("symbol", "epoch", "ema_5", "ema_9", "ema_21"), "ema_5", "ema_9", "ema_21")


MIXED_SPANS = (1, 5, 50, 200)


@query(
    "w2_ema_mixed",
    "WITH t AS (SELECT event_id, value, list(value) OVER (ORDER BY event_id ROWS BETWEEN 4200 PRECEDING AND CURRENT ROW) AS v FROM events)\nSELECT event_id"
    + "".join(f", round(list_reduce(v, lambda acc, x : (2.0 / ({n} + 1.0)) * x + (1.0 - 2.0 / ({n} + 1.0)) * acc), 6) AS ema_{n}" for n in MIXED_SPANS)
    + " FROM t",
)
def w2_ema_mixed(spark, sf):
    """Every event as a bar of one series, which crosses many blocks; spans of which the shortest sets the block."""
    events = inputs.table(spark, sf, "events").select(F.lit("all").alias("symbol"), "event_id", F.col("event_id").alias("epoch"), F.col("value").alias("close"))
    bars = settle(with_bar_index(settle(events)))
    names = [f"ema_{n}" for n in MIXED_SPANS]
    out = I.ema(bars, dict(zip(names, MIXED_SPANS, strict=True)))
    return rounded(out.select("event_id", *names), *names)


@query(
    "w3_rsi",
    with_sql(INDEXED_SQL + ", " + RSI_SQL.format(src="ib"), "SELECT symbol, epoch, round(rsi, 6) AS rsi FROM rs"),
)
def w3_rsi(spark, sf):
    return rounded(I.rsi(inputs.hourly_indexed(spark, sf)).select("symbol", "epoch", "rsi"), "rsi")


@query(
    "w4_previous_bar",
    with_sql(
        INDEXED_SQL,
        """SELECT symbol, epoch, lag(high) OVER w AS prev_high, lag(low) OVER w AS prev_low,
       lag(close) OVER w AS prev_close, round(close - lag(close) OVER w, 6) AS change
FROM ib WINDOW w AS (PARTITION BY symbol ORDER BY epoch)""",
    ),
)
def w4_previous_bar(spark, sf):
    out = I.previous(inputs.hourly_indexed(spark, sf), ("high", "low", "close"))
    return rounded(out.select("symbol", "epoch", "prev_high", "prev_low", "prev_close", "change"), "change")


STREAK_SQL = """sg AS (SELECT *, sign(close - lag(close) OVER w) AS s FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY epoch)),
sn AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER w THEN 1 ELSE 0 END AS turned FROM sg WINDOW w AS (PARTITION BY symbol ORDER BY epoch)),
si AS (SELECT *, sum(turned) OVER (PARTITION BY symbol ORDER BY epoch) AS isl FROM sn),
st AS (SELECT *, CAST(CASE WHEN s > 0 THEN least(row_number() OVER i, 9) ELSE 0 END AS INTEGER) AS up_streak,
              CAST(CASE WHEN s < 0 THEN least(row_number() OVER i, 9) ELSE 0 END AS INTEGER) AS down_streak
       FROM si WINDOW i AS (PARTITION BY symbol, isl ORDER BY epoch))"""


@query(
    "w7_close_streak",
    with_sql(INDEXED_SQL + ", " + STREAK_SQL.format(src="ib"), "SELECT symbol, epoch, up_streak, down_streak FROM st"),
)
def w7_close_streak(spark, sf):
    return I.close_streak(inputs.hourly_indexed(spark, sf)).select("symbol", "epoch", "up_streak", "down_streak")


MOMENTUM_SQL = (
    RSI_SQL
    + f""", me AS (SELECT *, {ema_sql('close', 9, 'ema_9')}, {ema_sql('close', 21, 'ema_21')} FROM rs),
mv AS (SELECT *, CASE WHEN ema_9 > ema_21 THEN 'bullish' WHEN ema_9 < ema_21 THEN 'bearish' ELSE 'neutral' END AS es,
              CASE WHEN rsi > 50 THEN 'bullish' WHEN rsi < 50 THEN 'bearish' ELSE 'neutral' END AS rsig FROM me),
mo AS (SELECT * EXCLUDE (ema_9, ema_21, rsi, es, rsig),
              CASE WHEN bar_index >= 21 THEN ema_9 END AS ema_9, CASE WHEN bar_index >= 21 THEN ema_21 END AS ema_21,
              CASE WHEN bar_index >= 21 THEN rsi END AS rsi, CASE WHEN bar_index >= 21 THEN es END AS ema_signal,
              CASE WHEN bar_index >= 21 THEN rsig END AS rsi_signal,
              CASE WHEN bar_index >= 21 THEN CASE WHEN es = rsig THEN es ELSE 'neutral' END END AS overall_momentum,
              CASE WHEN bar_index < 21 THEN 0.0 WHEN es = rsig AND es <> 'neutral' THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence
       FROM mv)"""
)


@query(
    "w8_momentum",
    with_sql(
        INDEXED_SQL + ", " + MOMENTUM_SQL.format(src="ib"),
        "SELECT symbol, epoch, round(ema_9, 6) AS ema_9, round(ema_21, 6) AS ema_21, round(rsi, 6) AS rsi, ema_signal, "
        "rsi_signal, overall_momentum, confidence FROM mo",
    ),
)
def w8_momentum(spark, sf):
    out = I.momentum(inputs.hourly_indexed(spark, sf)).select(
        "symbol", "epoch", "ema_9", "ema_21", "rsi", "ema_signal", "rsi_signal", "overall_momentum", "confidence"
    )
    return rounded(out, "ema_9", "ema_21", "rsi")


@query(
    "w10_alert_candles",
    with_sql(
        INDEXED_SQL + ", " + EMA5_SQL,
        """SELECT symbol, epoch, round(ema, 6) AS ema, coalesce(lag(low) OVER w > lag(ema) OVER w, false) AS short_alert,
       coalesce(lag(high) OVER w < lag(ema) OVER w, false) AS long_alert
FROM em WINDOW w AS (PARTITION BY symbol ORDER BY epoch)""",
    ),
)
def w10_alert_candles(spark, sf):
    out = I.alert_candles(inputs.hourly_indexed(spark, sf), 5)
    return rounded(out.select("symbol", "epoch", "ema", "short_alert", "long_alert"), "ema")


@query(
    "w15_session_vwap",
    with_sql(
        HOURLY_SQL
        + """, vw AS (SELECT symbol, epoch, close,
         sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w AS vwap
       FROM bars WINDOW w AS (PARTITION BY symbol, floor(epoch / 86400.0) ORDER BY epoch))""",
        """SELECT symbol, epoch, round(vwap, 6) AS vwap,
       CASE WHEN round(close, 9) > round(vwap, 9) THEN 'bullish' WHEN round(close, 9) < round(vwap, 9) THEN 'bearish'
            ELSE 'neutral' END AS vwap_signal FROM vw""",
    ),
)
def w15_session_vwap(spark, sf):
    out = I.session_vwap(inputs.hourly(spark, sf))
    close, vwap = F.round("close", 9), F.round("vwap", 9)
    signal = F.when(close > vwap, "bullish").when(close < vwap, "bearish").otherwise("neutral")
    return rounded(out.select("symbol", "epoch", "vwap", signal.alias("vwap_signal")), "vwap")


@query(
    "w16_candle_patterns",
    with_sql(
        INDEXED_SQL + ", " + RSI_SQL.format(src="ib"),
        """SELECT symbol, epoch,
  (high - low > 0) AND abs(close - open) <= 0.1 * (high - low) AS doji,
  abs(close - open) > 0 AND least(open, close) - low >= 2.0 * abs(close - open) AND high - greatest(open, close) <= abs(close - open) AS hammer,
  abs(close - open) > 0 AND high - greatest(open, close) >= 2.0 * abs(close - open) AS long_upper_wick,
  abs(close - open) > 0 AND least(open, close) - low >= 2.0 * abs(close - open) AS long_lower_wick,
  coalesce(lag(close) OVER w < lag(open) OVER w AND close > open AND open <= lag(close) OVER w AND close >= lag(open) OVER w, false) AS bullish_engulfing,
  coalesce(lag(close) OVER w > lag(open) OVER w AND close < open AND open >= lag(close) OVER w AND close <= lag(open) OVER w, false) AS bearish_engulfing,
  coalesce(bar_index >= 20 AND volume > 2.0 * avg(volume) OVER v, false) AS volume_spike,
  coalesce(close < lag(close, 5) OVER w AND rsi > lag(rsi, 5) OVER w, false) AS bullish_divergence,
  coalesce(close > lag(close, 5) OVER w AND rsi < lag(rsi, 5) OVER w, false) AS bearish_divergence
FROM rs WINDOW w AS (PARTITION BY symbol ORDER BY epoch),
  v AS (PARTITION BY symbol ORDER BY epoch ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    ),
)
def w16_candle_patterns(spark, sf):
    flags = (
        "doji", "hammer", "long_upper_wick", "long_lower_wick", "bullish_engulfing", "bearish_engulfing",
        "volume_spike", "bullish_divergence", "bearish_divergence",
    )
    return I.candle_patterns(inputs.hourly_indexed(spark, sf)).select("symbol", "epoch", *flags)


@query(
    "a6_coverage",
    with_sql(
        DAILY_SQL,
        "SELECT symbol, min(epoch) AS first_epoch, max(epoch) AS last_epoch, count(*) AS bars FROM bars GROUP BY symbol",
    ),
)
def a6_coverage(spark, sf):
    return B.coverage(inputs.daily(spark, sf))


@query(
    "a2_dedupe_bars",
    with_sql(
        inputs.SALES_SQL,
        """SELECT symbol, epoch, price, volume, orderkey, linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, epoch ORDER BY orderkey, linenumber, price, volume) AS rn FROM sales)
WHERE rn = 1""",
    ),
)
def a2_dedupe_bars(spark, sf):
    return B.dedupe_bars(inputs.sales_ticks(spark, sf), ("orderkey", "linenumber", "price", "volume"))
