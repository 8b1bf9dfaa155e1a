"""Queries of the other modules over bars of a minute in small blocks, so that every symbol spans many of them."""

from __future__ import annotations

from tickloom.catalog import indicator_queries, join_queries, stream_queries, strategy_queries, structure_queries  # noqa: F401  they register what is repeated here
from tickloom.catalog.inputs import HOUR_SQL, MINUTE_SQL, dense_bars
from tickloom.catalog.registry import ORACLES, QUERIES, query

NAMES = (
    "w1_donchian", "w2_ema", "w3_rsi", "w7_close_streak", "w5_raw_pivots", "w6_alternating_pivots", "w11_staircase", "j11_bars_asof_pivots", "j9_line_touches", "g16_angle_events",
    "g1_channel_strategy", "g2_square_strategy", "g3_ema_breakout", "g6_label_ledger", "a3_trade_metrics", "a9_equity_curve", "v1_plugin_strategy", "g20_angle_signals",
    "g11_pivot_hierarchy", "g12_active_pair", "g13_fans", "g14_fan_completion", "u4_g15_fan_changes", "u5_pivot_markers", "t5_first_inner_pairs", "v2_study_registry",
    "r4_pivot_steps",
)


def _dense(name: str):
    def run(spark, sf):
        with dense_bars():
            return QUERIES[name](spark, sf)

    run.__doc__ = QUERIES[name].__doc__
    return run


for _name in NAMES:
    assert HOUR_SQL in ORACLES[_name], _name
    query(f"{_name}_dense", ORACLES[_name].replace(HOUR_SQL, MINUTE_SQL))(_dense(_name))
