"""Strategies, trade ledgers and measures over the hourly event bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import inputs
from tickloom.catalog.indicator_queries import ema_sql
from tickloom.catalog.inputs import INDEXED_SQL, rounded
from tickloom.catalog.registry import query, with_sql
from tickloom.operators import ledger as L
from tickloom.plans import strategies as S
from tickloom.plans.registry import generate

def breakout_sql(n: int) -> str:
    return (
        INDEXED_SQL
        + f""", ch AS (SELECT *, max(high) OVER w AS hh, min(low) OVER w AS ll FROM ib
  WINDOW w AS (PARTITION BY symbol ORDER BY epoch ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)),
cand AS (SELECT *, CASE WHEN close > hh THEN 1 WHEN close < ll THEN -1 END AS side FROM ch
         WHERE bar_index > {n} AND (close > hh OR close < ll)),
alt AS (SELECT *, coalesce(lag(side) OVER (PARTITION BY symbol ORDER BY epoch), -1) AS before FROM cand),
sig AS (SELECT symbol, epoch, bar_index, close, side AS signal, close AS signal_price,
               CASE WHEN side = 1 THEN 'Buy {n}-Bar Breakout' ELSE 'Sell (Stop Loss)' END AS signal_label
        FROM alt WHERE side <> before)"""
    )


BREAKOUT_SQL = breakout_sql(3)

LEDGER_SQL = (
    BREAKOUT_SQL
    + """, pr AS (SELECT *, lag(close) OVER w AS ep, lag(epoch) OVER w AS ee,
               last_value(signal) OVER (PARTITION BY symbol ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
        FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY epoch)),
lastbar AS (SELECT symbol, max(epoch) AS epoch, arg_max(close, epoch) AS close, max(bar_index) AS bar_index FROM ib GROUP BY symbol),
closed AS (
  SELECT symbol, epoch, bar_index, CASE WHEN signal = 1 THEN 'buy' ELSE 'sell' END AS type, close AS price,
         CASE WHEN signal = -1 THEN close - ep END AS pnl, CASE WHEN signal = 1 THEN epoch ELSE ee END AS entry_epoch FROM pr
  UNION ALL
  SELECT l.symbol, l.epoch, l.bar_index, 'sell', l.close, l.close - p.price, p.ep FROM lastbar l JOIN (
    SELECT symbol, arg_max(close, epoch) AS price, max(epoch) AS ep FROM pr WHERE final = 1 GROUP BY symbol) p USING (symbol))"""
)


def breakout(spark, sf):
    return S.breakout_signals(inputs.hourly_indexed(spark, sf), 3)


def breakout_ledger(spark, sf):
    bars = inputs.hourly_indexed(spark, sf)
    return L.close_at_end(L.trades(S.breakout_signals(bars, 3)), bars)


@query(
    "w9_alternating_breakouts",
    with_sql(BREAKOUT_SQL, "SELECT symbol, epoch, signal, signal_price, signal_label FROM sig"),
)
def w9_alternating_breakouts(spark, sf):
    return breakout(spark, sf).select("symbol", "epoch", "signal", "signal_price", "signal_label")


@query(
    "g1_channel_strategy",
    with_sql(
        BREAKOUT_SQL,
        """SELECT b.symbol, b.epoch, coalesce(s.signal, 0) AS signal, b.close AS signal_price,
       coalesce(s.signal_label, '') AS signal_label
FROM ib b LEFT JOIN sig s ON b.symbol = s.symbol AND b.epoch = s.epoch""",
    ),
)
def g1_channel_strategy(spark, sf):
    bars = inputs.hourly_indexed(spark, sf)
    out = S.with_holds(bars, generate("mechanical_3day", bars))
    return out.select("symbol", "epoch", "signal", "signal_price", "signal_label")


@query(
    "g6_trade_ledger",
    with_sql(
        LEDGER_SQL,
        """SELECT symbol, epoch, CASE WHEN signal = 1 THEN 'buy' ELSE 'sell' END AS type, close AS price,
       round(CASE WHEN signal = -1 THEN close - ep END, 6) AS pnl,
       CASE WHEN signal = 1 THEN epoch ELSE ee END AS entry_epoch FROM pr""",
    ),
)
def g6_trade_ledger(spark, sf):
    out = L.trades(breakout(spark, sf)).select("symbol", "epoch", "type", "price", "pnl", "entry_epoch")
    return rounded(out, "pnl")


@query(
    "g7_close_at_end",
    with_sql(LEDGER_SQL, "SELECT symbol, epoch, type, price, round(pnl, 6) AS pnl, entry_epoch FROM closed"),
)
def g7_close_at_end(spark, sf):
    out = breakout_ledger(spark, sf).select("symbol", "epoch", "type", "price", "pnl", "entry_epoch")
    return rounded(out, "pnl")


METRICS_SQL = """SELECT symbol, count(*) AS total_trades, count(pnl) AS completed_trades,
  count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <= 0) AS losses,
  round(coalesce(sum(pnl), 0.0), 2) AS total_pnl,
  round(CASE WHEN count(pnl) > 0 THEN count(*) FILTER (pnl > 0) * 100.0::DOUBLE / count(pnl) ELSE 0.0 END, 1) AS win_rate,
  round(coalesce(avg(pnl) FILTER (pnl > 0), 0.0), 2) AS avg_win,
  round(coalesce(avg(pnl) FILTER (pnl <= 0), 0.0), 2) AS avg_loss,
  round(CASE WHEN abs(coalesce(sum(pnl) FILTER (pnl <= 0), 0.0)) > 0
        THEN coalesce(sum(pnl) FILTER (pnl > 0), 0.0) / abs(sum(pnl) FILTER (pnl <= 0)) ELSE 0.0 END, 2) AS profit_factor,
  round(coalesce(sum(pnl), 0.0) / 100000.0 * 100, 2) AS return_pct
FROM closed GROUP BY symbol"""


@query("a3_trade_metrics", with_sql(LEDGER_SQL, METRICS_SQL))
def a3_trade_metrics(spark, sf):
    return L.trade_metrics(breakout_ledger(spark, sf))


@query(
    "a9_equity_curve",
    with_sql(
        LEDGER_SQL,
        """SELECT symbol, epoch, round(pnl, 6) AS pnl, round(100000.0 + sum(pnl) OVER (PARTITION BY symbol ORDER BY epoch, bar_index), 6) AS equity
FROM closed WHERE pnl IS NOT NULL""",
    ),
)
def a9_equity_curve(spark, sf):
    return rounded(L.equity_curve(breakout_ledger(spark, sf)).select("symbol", "epoch", "pnl", "equity"), "pnl", "equity")


@query(
    "a10_risk_metrics",
    with_sql(
        LEDGER_SQL
        + """, eq AS (SELECT symbol, epoch, pnl, 100000.0 + sum(pnl) OVER (PARTITION BY symbol ORDER BY epoch) AS equity
  FROM closed WHERE pnl IS NOT NULL),
pk AS (SELECT *, greatest(100000.0, max(equity) OVER (PARTITION BY symbol ORDER BY epoch)) - equity AS dd FROM eq)""",
        """SELECT symbol, round(max(dd), 4) AS max_drawdown,
       round(CASE WHEN stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) END, 4) AS sharpe FROM pk GROUP BY symbol""",
    ),
)
def a10_risk_metrics(spark, sf):
    return rounded(L.risk_metrics(breakout_ledger(spark, sf)), "max_drawdown", "sharpe", places=4)


@query(
    "g4_hold_only_strategy",
    with_sql(
        INDEXED_SQL,
        "SELECT symbol, epoch, 0 AS signal, close AS signal_price, '' AS signal_label FROM ib",
    ),
)
def g4_hold_only_strategy(spark, sf):
    out = generate("time_cycle_breakout", inputs.hourly_indexed(spark, sf))
    return out.select("symbol", "epoch", "signal", "signal_price", "signal_label")


LEVELS_SQL = (
    INDEXED_SQL
    + """, lv AS (SELECT symbol, [pow(sqrt(o) + 0.25, 2), pow(sqrt(o) + 0.5, 2), pow(sqrt(o) + 0.75, 2), pow(sqrt(o) + 1.0, 2)] AS levels
  FROM (SELECT symbol, arg_min(open, epoch) AS o FROM bars GROUP BY symbol))"""
)

TOUCH_SQL = (
    LEVELS_SQL
    + """, touch AS (SELECT * FROM (SELECT b.*, list_filter(levels, lambda x : abs(low - x) < x * 0.02)[1] AS level
  FROM ib b JOIN lv USING (symbol)) WHERE level IS NOT NULL AND bar_index >= 1)"""
)


@query(
    "x10_square_levels",
    with_sql(LEVELS_SQL, "SELECT symbol, list_transform(levels, lambda x : round(x, 6)) AS levels FROM lv"),
)
def x10_square_levels(spark, sf):
    out = S.square_levels(inputs.hourly(spark, sf))
    return out.select("symbol", F.transform("levels", lambda x: F.round(x, 6)).alias("levels"))


@query("x11_level_touch", with_sql(TOUCH_SQL, "SELECT symbol, epoch, low, round(level, 6) AS level FROM touch"))
def x11_level_touch(spark, sf):
    out = S.level_touches(inputs.hourly_indexed(spark, sf), 0.02)
    return rounded(out.select("symbol", "epoch", "low", "level"), "level")


@query(
    "g2_square_strategy",
    "WITH RECURSIVE "
    + TOUCH_SQL
    + """, ent AS (
  SELECT symbol, min(bar_index) AS at FROM touch GROUP BY symbol
  UNION ALL
  SELECT e.symbol, min(t.bar_index) FROM ent e JOIN touch t ON t.symbol = e.symbol AND t.bar_index >= e.at + 6 GROUP BY e.symbol)
SELECT b.symbol, b.epoch, 1 AS signal FROM ent e JOIN ib b ON b.symbol = e.symbol AND b.bar_index = e.at
UNION ALL
SELECT b.symbol, b.epoch, -1 FROM ent e JOIN ib b ON b.symbol = e.symbol AND b.bar_index = e.at + 5""",
)
def g2_square_strategy(spark, sf):
    out = S.square_signals(inputs.hourly_indexed(spark, sf), 0.02)
    return out.select("symbol", "epoch", "signal")


@query(
    "g5_first_touch",
    with_sql(
        TOUCH_SQL.replace(", pow(sqrt(o) + 1.0, 2)]", "]"),
        "SELECT symbol, min(epoch) AS epoch, 1 AS signal, arg_min(close, epoch) AS signal_price FROM touch GROUP BY symbol",
    ),
)
def g5_first_touch(spark, sf):
    return S.first_touch(inputs.hourly_indexed(spark, sf), 0.02).select("symbol", "epoch", "signal", "signal_price")


def rules_sql(params: list[tuple[str, float, str, int]]) -> str:
    """Bar-by-bar recursion of the alert-candle rules for ``(param_id, reward, direction, validity)``."""
    rows = ", ".join(f"('{n}', {r}::DOUBLE, '{d}', {v})" for n, r, d, v in params)
    return (
        "WITH RECURSIVE "
        + INDEXED_SQL
        + f""", em AS (SELECT *, {ema_sql('close', 5, 'ema')} FROM ib),
pm(param_id, rr, dir, validity) AS (VALUES {rows}),
pb AS (SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(low) OVER w > lag(ema) OVER w AS above, lag(high) OVER w < lag(ema) OVER w AS below
       FROM em WINDOW w AS (PARTITION BY symbol ORDER BY epoch)),
bars2 AS (SELECT pb.*, pm.* FROM pb, pm),
st AS (
  SELECT param_id, symbol, bar_index, 0 AS side, NULL::DOUBLE AS stop, NULL::DOUBLE AS goal, NULL::DOUBLE AS sl, NULL::DOUBLE AS sh, NULL::BIGINT AS su,
         NULL::DOUBLE AS ll, NULL::DOUBLE AS lh, NULL::BIGINT AS lu, NULL::VARCHAR AS action, NULL::VARCHAR AS reason, NULL::DOUBLE AS out_stop, NULL::DOUBLE AS out_goal
  FROM bars2 WHERE bar_index = 5
  UNION ALL
  SELECT param_id, symbol, bar_index,
    CASE WHEN ex IS NOT NULL THEN 0 WHEN en IS NOT NULL THEN en ELSE side END,
    CASE WHEN ex IS NOT NULL THEN NULL WHEN en IS NOT NULL THEN estop ELSE stop END,
    CASE WHEN ex IS NOT NULL THEN NULL WHEN en IS NOT NULL THEN close - (estop - close) * rr ELSE goal END,
    CASE WHEN en IS NULL THEN nsl END, CASE WHEN en IS NULL THEN nsh END, CASE WHEN en IS NULL THEN nsu END,
    CASE WHEN en IS NULL THEN nll END, CASE WHEN en IS NULL THEN nlh END, CASE WHEN en IS NULL THEN nlu END,
    CASE WHEN ex IS NOT NULL THEN CASE WHEN side = 1 THEN 'exit_long' ELSE 'exit_short' END WHEN en = 1 THEN 'enter_long' WHEN en = -1 THEN 'enter_short' END,
    CASE WHEN ex IS NOT NULL THEN ex WHEN en IS NOT NULL THEN printf('%.0f', estop) END,
    CASE WHEN ex IS NOT NULL THEN stop WHEN en IS NOT NULL THEN estop END,
    CASE WHEN ex IS NOT NULL THEN goal WHEN en IS NOT NULL THEN close - (estop - close) * rr END
  FROM (SELECT *, CASE WHEN en = -1 THEN nsh WHEN en = 1 THEN nll END AS estop FROM (
    SELECT *, CASE WHEN side = 0 AND bar_index <= nsu AND close < nsl THEN -1 WHEN side = 0 AND bar_index <= nlu AND close > nlh THEN 1 END AS en FROM (
      SELECT b.*, s.side, s.stop, s.goal,
        CASE WHEN s.side = 1 THEN CASE WHEN close <= stop THEN 'SL Hit @ ' || printf('%.1f', stop) WHEN close >= goal THEN 'Target @ ' || printf('%.1f', goal) WHEN low <= ema THEN 'EMA Touch' END
             WHEN s.side = -1 THEN CASE WHEN close >= stop THEN 'SL Hit @ ' || printf('%.1f', stop) WHEN close <= goal THEN 'Target @ ' || printf('%.1f', goal) WHEN high >= ema THEN 'EMA Touch' END END AS ex,
        CASE WHEN s.side = 0 AND above AND dir <> 'long_only' THEN pl ELSE sl END AS nsl, CASE WHEN s.side = 0 AND above AND dir <> 'long_only' THEN ph ELSE sh END AS nsh,
        CASE WHEN s.side = 0 AND above AND dir <> 'long_only' THEN b.bar_index + validity ELSE su END AS nsu,
        CASE WHEN s.side = 0 AND below AND dir <> 'short_only' THEN pl ELSE ll END AS nll, CASE WHEN s.side = 0 AND below AND dir <> 'short_only' THEN ph ELSE lh END AS nlh,
        CASE WHEN s.side = 0 AND below AND dir <> 'short_only' THEN b.bar_index + validity ELSE lu END AS nlu
      FROM st s JOIN bars2 b ON b.param_id = s.param_id AND b.symbol = s.symbol AND b.bar_index = s.bar_index + 1)))),
ac AS (SELECT st.*, ib.epoch, ib.close FROM st JOIN ib ON ib.symbol = st.symbol AND ib.bar_index = st.bar_index WHERE action IS NOT NULL),
th AS (SELECT *, CAST(make_timestamp(epoch * 1000000) AS DATE) AS d, epoch % 86400 // 60 AS mi FROM ac),
es AS (SELECT *, CASE WHEN action IN ('enter_long', 'exit_short') THEN 1 ELSE -1 END AS signal,
         CASE WHEN action LIKE 'enter%' THEN 'Buy ' || CAST(round_even(close, 0) AS BIGINT) || CASE WHEN action = 'enter_long' THEN ' CE (' ELSE ' PE (' END
                || strftime(d + CAST((4 - isodow(d) + 7) % 7 + CASE WHEN isodow(d) = 4 AND mi >= 930 THEN 7 ELSE 0 END AS INTEGER), '%d-%b') || ') | SL:' || reason
              ELSE 'Exit ' || CASE WHEN action = 'exit_long' THEN 'Long (' ELSE 'Short (' END || reason || ')' END AS signal_label FROM th),
le AS (SELECT *, lag(close) OVER w AS ep, CASE WHEN action LIKE '%long' THEN 'long' ELSE 'short' END AS pside FROM es WINDOW w AS (PARTITION BY param_id, symbol ORDER BY bar_index)),
lb AS (SELECT symbol, max(epoch) AS epoch, arg_max(close, epoch) AS close, max(bar_index) AS bar_index FROM ib GROUP BY symbol),
op AS (SELECT param_id, symbol, arg_max(action, bar_index) AS action, arg_max(close, bar_index) AS close FROM es GROUP BY 1, 2),
closed AS (
  SELECT param_id, symbol, epoch, CASE WHEN signal = 1 THEN 'buy' ELSE 'sell' END AS type, pside AS side, close AS price,
         CASE WHEN action = 'exit_long' THEN close - ep WHEN action = 'exit_short' THEN ep - close END AS pnl FROM le
  UNION ALL
  SELECT o.param_id, o.symbol, l.epoch, CASE WHEN o.action = 'enter_long' THEN 'sell' ELSE 'buy' END, CASE WHEN o.action = 'enter_long' THEN 'long' ELSE 'short' END,
         l.close, CASE WHEN o.action = 'enter_long' THEN l.close - o.close ELSE o.close - l.close END
  FROM op o JOIN lb l ON l.symbol = o.symbol WHERE o.action LIKE 'enter%')
"""
    )


DEFAULT_RULES_SQL = rules_sql([("default", 3.0, "both", 3)])


@query(
    "g3_ema_breakout",
    DEFAULT_RULES_SQL
    + """SELECT symbol, epoch, param_id, signal, close AS signal_price, signal_label, round(out_stop, 6) AS stop_loss, round(out_goal, 6) AS target FROM es""",
)
def g3_ema_breakout(spark, sf):
    grid = {"default": S.EmaBreakout(strike_step=1)}
    out = S.ema_signals(inputs.hourly_indexed(spark, sf), grid)
    return rounded(
        out.select("symbol", "epoch", "param_id", "signal", "signal_price", "signal_label", "stop_loss", "target"),
        "stop_loss", "target",
    )


@query(
    "g6_label_ledger",
    DEFAULT_RULES_SQL + "SELECT symbol, epoch, type, side, price, round(pnl, 6) AS pnl FROM closed",
)
def g6_label_ledger(spark, sf):
    bars = inputs.hourly_indexed(spark, sf)
    out = L.close_at_end(L.trades(S.ema_signals(bars, {"default": S.EmaBreakout(strike_step=1)})), bars)
    return rounded(out.select("symbol", "epoch", "type", "side", "price", "pnl"), "pnl")


SWEEP = [(f"rr{int(r)}_{d}_{v}", r, d, v) for r in (1.0, 3.0) for d in ("both", "long_only") for v in (1, 3)]


@query(
    "g21_parameter_sweep",
    rules_sql(SWEEP) + METRICS_SQL.replace("SELECT symbol,", "SELECT symbol, param_id,").replace("GROUP BY symbol", "GROUP BY symbol, param_id"),
)
def g21_parameter_sweep(spark, sf):
    from tickloom.plans.sweep import sweep

    grid = {
        n: S.EmaBreakout(risk_reward_ratio=r, trade_direction=d, alert_validity_bars=v, strike_step=1) for n, r, d, v in SWEEP
    }
    return sweep(inputs.hourly_indexed(spark, sf), grid)


COMPARED = (3, 8, 20)


def total_sql(n: int) -> str:
    """Total profit per symbol of the registered breakout over ``n`` bars."""
    ledger = LEDGER_SQL.replace(BREAKOUT_SQL, breakout_sql(n))
    return f"(WITH {ledger} SELECT symbol, round(coalesce(sum(pnl), 0.0), 2) AS breakout_{n} FROM closed GROUP BY symbol)"


@query(
    "a11_compare_runs",
    f"SELECT symbol, {', '.join(f'breakout_{n}' for n in COMPARED)} FROM "
    + " FULL JOIN ".join(total_sql(n) + f" r{n}" + (" USING (symbol)" if k else "") for k, n in enumerate(COMPARED)),
)
def a11_compare_runs(spark, sf):
    from tickloom.plans.registry import generate

    bars = inputs.hourly_indexed(spark, sf)
    runs = {f"breakout_{n}": L.trade_metrics(L.close_at_end(L.trades(generate("mechanical_3day", bars, n=n)), bars)) for n in COMPARED}
    return L.compare_runs(runs)


SQUARE_TOTAL_SQL = (
    "(WITH RECURSIVE "
    + TOUCH_SQL
    + """, ent AS (
  SELECT symbol, min(bar_index) AS at FROM touch GROUP BY symbol
  UNION ALL
  SELECT e.symbol, min(t.bar_index) FROM ent e JOIN touch t ON t.symbol = e.symbol AND t.bar_index >= e.at + 6 GROUP BY e.symbol),
lastbar AS (SELECT symbol, arg_max(close, epoch) AS close FROM ib GROUP BY symbol)
SELECT e.symbol, round(sum(coalesce(x.close, l.close) - b.close), 2) AS square FROM ent e JOIN ib b ON b.symbol = e.symbol AND b.bar_index = e.at
LEFT JOIN ib x ON x.symbol = e.symbol AND x.bar_index = e.at + 5 JOIN lastbar l ON l.symbol = e.symbol GROUP BY e.symbol)"""
)


@query(
    "a11_compare_strategies",
    f"SELECT symbol, breakout_3 AS breakout, square, ema FROM {total_sql(3)} b FULL JOIN {SQUARE_TOTAL_SQL} s USING (symbol) "
    + f"FULL JOIN ({DEFAULT_RULES_SQL} SELECT symbol, round(coalesce(sum(pnl), 0.0), 2) AS ema FROM closed GROUP BY symbol) e USING (symbol)",
)
def a11_compare_strategies(spark, sf):
    """Total profit per symbol of three different strategies, their last positions closed at the end."""
    bars = inputs.hourly_indexed(spark, sf)
    runs = {
        "breakout": generate("mechanical_3day", bars),
        "square": generate("square_of_9", bars, tolerance=0.02),
        "ema": generate("five_ema", bars, strike_step=1),
    }
    return L.compare_runs({name: L.trade_metrics(L.close_at_end(L.trades(signals), bars), mode="all_closed") for name, signals in runs.items()})


@query(
    "g22_indicator_points",
    with_sql(
        INDEXED_SQL + f", e AS (SELECT *, {ema_sql('close', 5, 'ema')} FROM ib)",
        "SELECT symbol, epoch AS time, round(ema, 6) AS price FROM e WHERE bar_index <= 600",
    ),
)
def g22_indicator_points(spark, sf):
    from tickloom.plans.studies import indicator_points

    return rounded(indicator_points(inputs.hourly_indexed(spark, sf), 600), "price")


@query(
    "v1_plugin_strategy",
    with_sql(
        INDEXED_SQL
        + """, rc AS (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ib)""",
        "SELECT symbol, bar_index, epoch, 1 AS signal, close AS signal_price FROM rc WHERE high > top",
    ),
)
def v1_plugin_strategy(spark, sf):
    from tickloom.operators.folds import Summary
    from tickloom.plans.registry import folded_strategy, register_strategy

    def record_highs(memory, rows):
        top, out = (memory or {"top": None})["top"], []
        for r in rows.itertuples(index=False):
            if top is not None and r.high > top:
                out.append((r.symbol, int(r.bar_index), int(r.epoch), 1, float(r.close)))
            top = float(r.high) if top is None else max(top, float(r.high))
        return {"top": top}, out

    schema = "symbol string, bar_index long, epoch long, signal int, signal_price double"
    highest = Summary(
        leave=lambda rows: float(rows["high"].max()), compose=max, enter=lambda memory, top: {"top": max(top, memory["top"]) if memory else top}
    )
    register_strategy("record_highs", folded_strategy(record_highs, schema, summary=highest))
    return generate("record_highs", inputs.hourly_indexed(spark, sf))


@query(
    "v3_strategy_parameters",
    with_sql(breakout_sql(7), "SELECT symbol, epoch, signal, signal_label FROM sig"),
)
def v3_strategy_parameters(spark, sf):
    out = generate("mechanical_3day", inputs.hourly_indexed(spark, sf), n=7)
    return out.select("symbol", "epoch", "signal", "signal_label")
