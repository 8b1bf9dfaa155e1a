"""Streaming operators run over the driver tables as files in time order, and their batch equals in SQL."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tickloom.catalog import inputs
from tickloom.catalog.inputs import HOURLY_SQL, TICKS_SQL
from tickloom.catalog.join_queries import OPTIONS_SQL, option_signals
from tickloom.catalog.registry import query, with_sql
from tickloom.catalog.strategy_queries import DEFAULT_RULES_SQL, LEDGER_SQL, breakout, breakout_ledger
from tickloom.catalog.structure_queries import ALTERNATE_SQL, HIERARCHY_SQL
from tickloom.plans.registry import run_study
from tickloom.session import scratch_path, settle
from tickloom.streaming import feeds, stateful

# the tables arrive in three slices: up to the first cut (and rows without a time), between the cuts, and from the second on
CUTS = (1704844800, 1705708800)


def replay(rows, name, build, write=feeds.write_updates, order=(0, 1, 2), read=None, state_partitions=16):
    """Let ``rows`` arrive in slices of time and run ``build(stream)`` after each; the written updates.

    ``read`` opens the folder of arrivals as a stream. The slices arrive in ``order``. Every slice is a new run that resumes from the checkpoint of the one before, so state is restored
    twice on the way. ``state_partitions`` is written into the checkpoint by the first run and holds for the life of the stream.
    """
    rows = settle(rows)
    spark = rows.sparkSession
    stateful.use_rocksdb(spark)
    source, out, checkpoint = (scratch_path(spark, f"{name}-{part}") for part in ("in", "out", "state"))
    first, last = CUTS
    at = F.col("epoch")
    with shuffle_partitions(spark, state_partitions):
        slices = (at.isNull() | (at < first), (at >= first) & (at < last), at >= last)
        for k in order:
            rows.where(slices[k]).write.mode("append").parquet(source)
            stream = read(spark, source) if read else spark.readStream.schema(rows.schema).parquet(source)
            write(build(stream), out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@contextmanager
def shuffle_partitions(spark, number):
    """Shuffle partitions, and so state partitions, while a stream starts and runs."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(number))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tick_bars(stream):
    return feeds.tick_bars(stream, 3600, "60 days")


LATE_DAYS = 12


@query(
    "r1_s8_tick_bars",
    with_sql(
        TICKS_SQL
        # the middle slice arrives first; then, hours of the oldest slice that end before the watermark are dropped, the others still make bars
        + f""", wm AS (SELECT max(epoch_us(ts)) // 1000 - {LATE_DAYS} * 86400000 AS wm FROM ticks WHERE epoch >= 1704844800 AND epoch < 1705708800),
kept AS (SELECT ticks.*, CAST(floor(epoch / 3600.0) * 3600 AS BIGINT) AS hour FROM ticks, wm WHERE epoch >= 1704844800 OR wm IS NULL OR (epoch // 3600 + 1) * 3600000 > wm)""",
        """SELECT symbol, hour AS epoch, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume
FROM kept GROUP BY 1, 2""",
    ),
)
def r1_s8_tick_bars(spark, sf):
    ticks = inputs.ticks(spark, sf)
    updates = replay(ticks, "r1", lambda stream: feeds.tick_bars(stream, 3600, f"{LATE_DAYS} days"), order=(1, 0, 2), read=feeds.read_ticks)
    return feeds.current_rows(updates, ["symbol", "epoch"])


@query(
    "r2_latest_bars",
    with_sql(
        HOURLY_SQL
        # the middle slice arrives first, then the older one, then the newest
        + """, sl AS (SELECT *, CASE WHEN epoch < 1704844800 THEN 1 WHEN epoch < 1705708800 THEN 0 ELSE 2 END AS batch FROM bars),
kn AS (SELECT *, (SELECT max(e.epoch) FROM sl e WHERE e.symbol = sl.symbol AND e.batch < sl.batch) AS known FROM sl),
rk AS (SELECT *, row_number() OVER w - 1 AS age, max(epoch) OVER (PARTITION BY symbol, batch) AS newest FROM kn WHERE known IS NULL OR epoch >= known WINDOW w AS (PARTITION BY symbol, batch ORDER BY epoch DESC))""",
        "SELECT symbol, epoch, close, age FROM rk WHERE age = 0 OR age = 1 AND (known IS NULL OR newest > known)",
    ),
)
def r2_latest_bars(spark, sf):
    return replay(inputs.ticks(spark, sf), "r2", tick_bars, feeds.write_latest, (1, 0, 2)).select("symbol", "epoch", "close", "age")


STEPS_SQL = DEFAULT_RULES_SQL + "SELECT symbol, epoch, bar_index, action, reason, round(out_stop, 6) AS stop_loss, round(out_goal, 6) AS target FROM ac"


@query("r3_strategy_steps", STEPS_SQL)
def r3_strategy_steps(spark, sf):
    out = replay(inputs.hourly(spark, sf), "r3", stateful.strategy_steps)
    return inputs.rounded(out.drop("batch_id"), "stop_loss", "target")


@query("r4_pivot_steps", with_sql(ALTERNATE_SQL, "SELECT symbol, bar_index, epoch, type, price, confirm_index FROM conf"))
def r4_pivot_steps(spark, sf):
    return replay(inputs.hourly(spark, sf), "r4", stateful.pivot_steps).drop("batch_id")


@query(
    "r4_hierarchy_steps",
    with_sql(
        HIERARCHY_SQL,
        """SELECT symbol, epoch, bar_index, context, o_epoch AS origin_epoch, anchor.epoch AS anchor_epoch,
       f0.epoch AS outer_from, n0.epoch AS outer_to, list_transform(inner_l, lambda p : p.epoch) AS inner_from FROM tree""",
    ),
)
def r4_hierarchy_steps(spark, sf):
    return replay(inputs.hourly(spark, sf), "r4h", lambda bars: run_study("angular_coverage", bars)).drop("batch_id")


def with_heartbeat(bars):
    """Bars and, far behind the last, a row with only symbol and time: it moves the watermark past all that is held."""
    beat = bars.groupBy("symbol").agg((F.max("epoch") + 400 * 86400).alias("epoch"))
    return bars.unionByName(beat, allowMissingColumns=True)


@query("r4_late_pivots", with_sql(ALTERNATE_SQL, "SELECT symbol, bar_index, epoch, type, price, confirm_index FROM conf"))
def r4_late_pivots(spark, sf):
    """The oldest slice comes after the middle one, and pivots are those of the bars in order."""
    bars = with_heartbeat(inputs.hourly(spark, sf))
    return replay(bars, "r4l", lambda stream: stateful.pivot_steps(stream, delay="20 days"), order=(1, 0, 2)).drop("batch_id")


@query(
    "r4_late_hierarchy",
    with_sql(
        HIERARCHY_SQL,
        """SELECT symbol, epoch, bar_index, context, o_epoch AS origin_epoch, anchor.epoch AS anchor_epoch,
       f0.epoch AS outer_from, n0.epoch AS outer_to, list_transform(inner_l, lambda p : p.epoch) AS inner_from FROM tree""",
    ),
)
def r4_late_hierarchy(spark, sf):
    bars = with_heartbeat(inputs.hourly(spark, sf))
    return replay(bars, "r4lh", lambda stream: run_study("angular_coverage", stream, delay="20 days"), order=(1, 0, 2)).drop("batch_id")


@query("r3_late_steps", STEPS_SQL)
def r3_late_steps(spark, sf):
    bars = with_heartbeat(inputs.hourly(spark, sf))
    out = replay(bars, "r3l", lambda stream: stateful.strategy_steps(stream, delay="20 days"), order=(1, 0, 2))
    return inputs.rounded(out.drop("batch_id"), "stop_loss", "target")


@query(
    "r5_position_steps",
    with_sql(
        OPTIONS_SQL + ", rp AS (SELECT sig.*, th.expiry, lag(signal_price) OVER (PARTITION BY sig.symbol ORDER BY sig.epoch) AS ep FROM sig JOIN th ON th.symbol = sig.symbol AND th.epoch = sig.epoch)",
        """SELECT symbol, epoch, signal_price AS price, round(CASE WHEN signal = -1 THEN signal_price - ep END, 6) AS pnl,
  CASE WHEN signal = 1 THEN 'Buy ' || CAST(round_even(close, 0) AS BIGINT) || ' CE (' || strftime(expiry, '%d-%b') || ') | SL:0'
       WHEN ep IS NULL THEN 'Exit Long' ELSE 'Exit Long (PnL: ' || printf('%+.2f', signal_price - ep) || ')' END AS label FROM rp""",
    ),
)
def r5_position_steps(spark, sf):
    signals = option_signals(breakout(spark, sf)).select(
        F.lit("replay").alias("session"), "symbol", F.lit("channel").alias("strategy"), "epoch", "signal_price", "signal_label"
    )
    out = replay(signals, "r5", stateful.position_steps)
    return inputs.rounded(out.select("symbol", "epoch", "price", "pnl", "label"), "pnl")


POSITIONS_SQL = with_sql(
    OPTIONS_SQL + ", rp AS (SELECT *, lag(signal_price) OVER (PARTITION BY symbol ORDER BY epoch) AS ep FROM sig)",
    "SELECT symbol, epoch, signal_price AS price, round(CASE WHEN signal = -1 THEN signal_price - ep END, 6) AS pnl FROM rp",
)


@query("r5_late_positions", POSITIONS_SQL)
def r5_late_positions(spark, sf):
    """Signals whose oldest slice comes after the middle one; positions are those of the signals in order."""
    signals = settle(
        option_signals(breakout(spark, sf)).select(
            F.lit("replay").alias("session"), "symbol", F.lit("channel").alias("strategy"), "epoch", "signal_price", "signal_label"
        )
    )
    beat = signals.groupBy("session", "symbol", "strategy").agg((F.max("epoch") + 400 * 86400).alias("epoch"))
    rows = signals.unionByName(beat, allowMissingColumns=True)
    out = replay(rows, "r5l", lambda stream: stateful.position_steps(stream, delay="20 days"), order=(1, 0, 2))
    return inputs.rounded(out.select("symbol", "epoch", "price", "pnl"), "pnl")


@query("r6_late_trades", with_sql(LEDGER_SQL, "SELECT symbol, epoch, type, price FROM closed"))
def r6_late_trades(spark, sf):
    """Trades that fall due over bars whose oldest slice comes late."""
    ledger = settle(breakout_ledger(spark, sf).select("symbol", "epoch", "type", "price"))
    bars = with_heartbeat(inputs.hourly(spark, sf).select("symbol", "epoch", "close"))
    out = replay(bars, "r6l", lambda stream: stateful.due_trades(stream, ledger, delay="20 days"), order=(1, 0, 2))
    return out.select("symbol", "epoch", "type", "price")


@query("r6_due_trades", with_sql(LEDGER_SQL, "SELECT symbol, epoch, type, price FROM closed"))
def r6_due_trades(spark, sf):
    ledger = settle(breakout_ledger(spark, sf).select("symbol", "epoch", "type", "price"))
    out = replay(inputs.hourly(spark, sf).select("symbol", "epoch"), "r6", lambda bars: stateful.due_trades(bars, ledger))
    return out.select("symbol", "epoch", "type", "price")


@query("r7_distinct_trades", with_sql(LEDGER_SQL, "SELECT DISTINCT symbol, epoch, type, price FROM closed"))
def r7_distinct_trades(spark, sf):
    trades = breakout_ledger(spark, sf).select("symbol", "epoch", F.timestamp_seconds("epoch").alias("ts"), "type", "price")
    twice = trades.unionByName(trades)
    # the first two slices arrive again in batches of their own
    out = replay(twice, "r7", feeds.distinct_trades, order=(0, 0, 1, 1, 2))
    return out.select("symbol", "epoch", "type", "price")


@query("r8_latest_quotes", with_sql(TICKS_SQL, "SELECT symbol, CAST(floor(epoch(max(ts))) AS BIGINT) AS epoch, arg_max(price, ts) AS price FROM ticks GROUP BY symbol"))
def r8_latest_quotes(spark, sf):
    out = replay(inputs.ticks(spark, sf), "r8", feeds.latest_quotes)
    return feeds.current_rows(out, ["symbol"]).select("symbol", F.unix_seconds("ts").alias("epoch"), "price")
