"""Named strategies and studies; user code adds its own with ``register_strategy``/``register_study``."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from tickloom.operators.folds import Summary, fold_blocks
from tickloom.operators.hierarchy import hierarchy

from tickloom.plans import strategies as S
from tickloom.streaming.stateful import hierarchy_steps

Strategy = Callable[..., DataFrame]

STRATEGIES: dict[str, Strategy] = {}
DEFAULTS: dict[str, dict] = {}


def register_strategy(name: str, build: Strategy, **defaults) -> None:
    """Add ``build(bars, **params) -> signals`` under ``name`` with default parameters."""
    STRATEGIES[name] = build
    DEFAULTS[name] = defaults


def generate(name: str, bars: DataFrame, **params) -> DataFrame:
    """Signals of a registered strategy; unknown names or parameters are errors that list the choices."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; available: {', '.join(sorted(STRATEGIES))}")
    unknown = set(params) - set(DEFAULTS[name])
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)} for {name!r}; available: {sorted(DEFAULTS[name])}")
    return STRATEGIES[name](bars, **{**DEFAULTS[name], **params})


def folded_strategy(step: Callable, schema: str, warm: int = 0, summary: Summary | None = None) -> Strategy:
    """A plug-in rule ``step(memory, rows) -> (memory, tuples)`` as a strategy.

    For rules no window can express; blocks of a symbol run in parallel (see ``folds.fold_blocks``). A ``summary`` of what a stretch does to the memory
    spares a memory that never fades from being handed on block by block; ``warm`` is for one that fades within so many rows.
    """
    return lambda bars, **params: fold_blocks(bars, partial(step, **params), schema, warm=warm, summary=summary)


STUDIES: dict[str, tuple[Callable[..., DataFrame], Callable[..., DataFrame]]] = {}


def register_study(name: str, batch: Callable[..., DataFrame], stream: Callable[..., DataFrame]) -> None:
    """Add a study with a batch form over bars and a streaming form over a stream of bars."""
    STUDIES[name] = (batch, stream)


def is_study(name: str) -> bool:
    return name in STUDIES


def run_study(name: str, bars: DataFrame, **params) -> DataFrame:
    """A registered study over a bars table or a stream of bars."""
    if name not in STUDIES:
        raise ValueError(f"unknown study {name!r}; available: {', '.join(sorted(STUDIES))}")
    batch, stream = STUDIES[name]
    return (stream if bars.isStreaming else batch)(bars, **params)


def _ema_breakout(bars: DataFrame, **params) -> DataFrame:
    return S.ema_signals(bars, {"default": S.EmaBreakout(**params)})


register_strategy("mechanical_3day", S.breakout_signals, n=3)
register_strategy("square_of_9", S.square_signals, tolerance=0.001, hold=5, anchor="dataset")
register_strategy("first_touch", S.first_touch, tolerance=0.001)
register_strategy(
    "five_ema",
    _ema_breakout,
    ema_period=5,
    risk_reward_ratio=3.0,
    trade_direction="both",
    alert_validity_bars=3,
    strike_step=50,
)
for _name in ("time_cycle_breakout", "ichimoku_cloud", "angular_coverage"):
    register_strategy(_name, S.hold_only)

register_study("angular_coverage", hierarchy, hierarchy_steps)
