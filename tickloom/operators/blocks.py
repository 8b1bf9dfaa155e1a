"""Ordered computations that never put one whole symbol into one task.

A plain ``Window.partitionBy("symbol")`` sends every row of a hot symbol to a single task. Here a
symbol's rows are cut into blocks of bounded size and the work is done per ``(symbol, block)``:

* ``index_rows``  dense row number per key (local numbering + offsets from chunk counts)
* ``framed``      window expressions with a bounded ROWS frame; rows next to a block edge are
                  copied into the neighbour block, so each block is self-contained
* ``running``     unbounded prefix (or suffix) aggregates: block totals, a window over the totals
                  only, then a local window plus the carry
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
CHUNK_SECONDS = 7 * 86400

KEYS = ("symbol",)


def block_rows(rows: int | None = None) -> int:
    """Rows per block: the given number or the default at call time."""
    return rows or BLOCK_ROWS


def index_rows(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: str = "epoch",
    chunk_seconds: int = CHUNK_SECONDS,
    name: str = "bar_index",
) -> DataFrame:
    """Number the rows of each key from 0 in ``order``; ``order`` must be unique within a key."""
    keys = list(keys)
    part = keys + ["_chunk"]
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk_seconds)))
    offsets = (
        chunked.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_offset",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*part).orderBy(order)) - 1
    return (
        chunked.join(offsets, part)
        .withColumn(name, (local + F.col("_offset")).cast("long"))
        .drop("_chunk", "_offset")
    )


def framed(
    df: DataFrame,
    before: int,
    after: int,
    add: Callable[[DataFrame, Window], DataFrame],
    keys: Sequence[str] = KEYS,
    index: str = "bar_index",
    rows: int | None = None,
) -> DataFrame:
    """Apply ``add(df, window)`` where every frame reaches at most ``before``/``after`` rows.

    ``window`` is partitioned by key and block and ordered by ``index``. ``rows`` is the block
    size; it is raised to the halo width when that is larger.
    """
    rows = max(block_rows(rows), before, after, 1)
    home = F.floor(F.col(index) / F.lit(rows)).cast("long")
    place = F.col(index) % F.lit(rows)
    homes = [home]
    if before:
        homes.append(F.when(place >= rows - before, home + 1))
    if after:
        homes.append(F.when((place < after) & (home > 0), home - 1))
    copied = df.withColumn("_block", F.explode(F.array_compact(F.array(*homes))))
    window = Window.partitionBy(*keys, "_block").orderBy(index)
    return add(copied, window).where(F.col("_block") == home).drop("_block")


def running(
    df: DataFrame,
    columns: dict[str, tuple[str, Column]],
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("bar_index",),
    block: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running aggregates over each key in ``order``.

    ``columns`` maps an output name to ``(how, expression)`` with ``how`` one of ``sum``,
    ``count``, ``max``, ``min``, ``last`` (latest non-null value) or ``next`` (coming non-null value).
    ``inclusive=False`` leaves out the row itself. ``block`` must be monotone in ``order`` and bounds
    the rows handled together; the default is ``bar_index`` in steps of ``BLOCK_ROWS``.
    """
    keys, order = list(keys), list(order)
    part = keys + ["_block"]
    if block is None:
        block = F.floor(F.col("bar_index") / F.lit(BLOCK_ROWS)).cast("long")
    src = df.withColumn("_block", block)
    for name, (_, expr) in columns.items():
        src = src.withColumn(f"_in_{name}", expr)

    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    step = 0 if inclusive else 1
    local, chain = Window.partitionBy(*part).orderBy(*order), Window.partitionBy(*keys).orderBy("_block")
    near, far = local.rowsBetween(Window.unboundedPreceding, -step), chain.rowsBetween(Window.unboundedPreceding, -1)
    # looking ahead is looking back in falling order: a frame to the partition's end costs n^2
    ahead = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    chain_ahead = Window.partitionBy(*keys).orderBy(F.col("_block").desc())
    near_next = ahead.rowsBetween(Window.unboundedPreceding, -step)
    far_next = chain_ahead.rowsBetween(Window.unboundedPreceding, -1)

    totals, carries, results = [], [], {}
    for name, (how, _) in columns.items():
        value, total, carry = F.col(f"_in_{name}"), f"_total_{name}", f"_carry_{name}"
        if how in ("sum", "count"):
            fn = F.sum if how == "sum" else F.count
            totals.append(fn(value).alias(total))
            carries.append(F.sum(total).over(far).alias(carry))
            results[name] = F.coalesce(F.col(carry), F.lit(0)) + F.coalesce(
                fn(value).over(near), F.lit(0)
            )
        elif how in ("max", "min"):
            fn, pick = (F.max, F.greatest) if how == "max" else (F.min, F.least)
            totals.append(fn(value).alias(total))
            carries.append(fn(total).over(far).alias(carry))
            results[name] = pick(F.col(carry), fn(value).over(near))
        elif how == "last":
            totals.append(F.max_by(value, F.when(value.isNotNull(), position)).alias(total))
            carries.append(F.last(total, ignorenulls=True).over(far).alias(carry))
            results[name] = F.coalesce(F.last(value, ignorenulls=True).over(near), F.col(carry))
        elif how == "next":
            totals.append(F.min_by(value, F.when(value.isNotNull(), position)).alias(total))
            carries.append(F.last(total, ignorenulls=True).over(far_next).alias(carry))
            results[name] = F.coalesce(F.last(value, ignorenulls=True).over(near_next), F.col(carry))
        else:
            raise ValueError(f"unknown running aggregate {how!r}; use sum, count, max, min, last or next")

    carry_in = src.groupBy(*part).agg(*totals).select(*part, *carries)
    out = src.join(carry_in, part).withColumns(results)
    scratch = ["_block"] + [f"_in_{n}" for n in columns] + [f"_carry_{n}" for n in columns]
    return out.drop(*scratch)
