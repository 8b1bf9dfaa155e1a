"""Sequential rules over long keys: streamed block by block, with the state between blocks found in parallel.

Blocks of a key are walked side by side; a task streams its blocks row by row in small frames and holds the memory of one rule, never a key or
a block. What a block starts from is found in one of two ways:

* A rule with a ``Summary`` (an associative description of what a stretch does to the memory) gets it exactly: summaries of blocks are composed
  over a tree of ``FANOUT`` blocks a node, up and down again, in a depth that grows with the logarithm of the blocks.
* Any other rule guesses it by walking ``warm`` rows before the block. Blocks whose guess differs from what the block before them left are walked
  again until all agree. Rules that forget within the warm-up need one walk; a memory that lives through n blocks needs up to n.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import KEYS, block_rows
from tickloom.session import settle

Step = Callable[[dict | None, pd.DataFrame], tuple[dict, list[tuple]]]

#: Blocks of a fold hold this many times the rows of other blocks: they are streamed, so only the number of states matters.
STREAMED = 8
#: Blocks whose summaries are composed at once.
FANOUT = 32


@dataclass(frozen=True)
class Summary:
    """What a stretch of rows does to the memory, as a JSON-able value.

    ``leave(rows)`` describes a sorted frame, ``compose(first, second)`` two stretches after one another (associative), ``enter(memory, summary)`` is the
    memory after a stretch that began with ``memory`` (None at the start of a key).
    """

    leave: Callable[[pd.DataFrame], object]
    compose: Callable[[object, object], object]
    enter: Callable[[dict | None, object], dict]


def fold_blocks(
    df: DataFrame,
    step: Step,
    schema: str,
    keys: Sequence[str] = KEYS,
    index: str = "bar_index",
    rows: int | None = None,
    warm: int = 0,
    summary: Summary | None = None,
) -> DataFrame:
    """Fold each key's rows in ``index`` order without gathering a key, or a block, in one task's memory.

    ``step(memory, rows)`` takes the memory left by the rows before (None at the start) and a sorted frame, a part of a block; it returns the new memory
    (JSON-able) and output tuples (``schema`` names their columns). ``df`` should be settled, it is read once per walk.
    """
    keys, size = list(keys), rows or block_rows() * STREAMED
    warm = min(warm, size)
    part = [*keys, "_block"]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", _block long"
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    home = F.floor(F.col(index) / size).cast("long")
    blocked = df.withColumn("_block", home).withColumn("_warm", F.lit(False))
    if warm and summary is None:
        ahead = df.where(F.col(index) % size >= size - warm).withColumn("_block", home + 1).withColumn("_warm", F.lit(True))
        blocked = blocked.unionByName(ahead)
    sorted_ = lambda rows_: rows_.repartition(*part).sortWithinPartitions(*part, index)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Output rows of every block, and one row with the memory it began and ended with."""
        at, began, memory = None, None, None

        def state() -> pd.DataFrame:
            return pd.DataFrame([(*at, began, json.dumps(memory), *[None] * len(names))], columns=columns, dtype=object)

        for frame in frames:
            for key, rows_ in _runs(frame, part):
                if key != at:
                    if began is not None:
                        yield state()
                    given = rows_["_in"].iloc[0]
                    at, began, memory = key, None, json.loads(given) if isinstance(given, str) else None
                cold = rows_["_warm"].to_numpy(bool)
                if cold.any():
                    # a block that was told its memory needs no warm-up
                    if not isinstance(rows_["_in"].iloc[0], str):
                        memory, _ = step(memory, rows_[cold])
                    rows_ = rows_[~cold]
                    if rows_.empty:
                        continue
                if began is None:
                    began = json.dumps(memory)
                memory, out = step(memory, rows_)
                if out:
                    yield pd.DataFrame([(*at, None, None, *o) for o in out], columns=columns, dtype=object)
        if began is not None:
            yield state()

    columns = [*part, "_began", "_left", *(f"_o_{n}" for n in names)]
    walked_schema = f"{key_schema}, _began string, _left string, " + ", ".join(f"_o_{c.strip()}" for c in schema.split(", "))
    run = lambda rows_: settle(sorted_(rows_).mapInPandas(walk, walked_schema))
    results = lambda walked: walked.where(F.col("_left").isNull()).drop("_began", "_left")
    final = lambda found: found.select(*[F.col(f"_o_{n}").alias(n) for n in names])

    if summary is not None:
        starts = _entered(sorted_(blocked.withColumn("_in", F.lit(None).cast("string"))), summary, part, keys, key_schema)
        return final(results(run(blocked.join(starts, part))))

    before = Window.partitionBy(*keys).orderBy("_block")
    walked = run(blocked.withColumn("_in", F.lit(None).cast("string")))
    walks, states = [walked], walked.where(F.col("_left").isNotNull()).select(*part, "_began", "_left", F.lit(0).alias("_walk"))
    while True:
        due = settle(states.withColumn("_in", F.coalesce(F.lag("_left").over(before), F.lit("null"))))
        wrong = due.where("_in <> _began").select(*part, "_in")
        if wrong.isEmpty():
            break
        walks.append(run(blocked.join(wrong, part)))
        redone = walks[-1].where(F.col("_left").isNotNull()).select(*part, "_began", "_left", F.lit(len(walks) - 1).alias("_walk"))
        states = due.select(redone.columns).join(wrong.select(*part), part, "left_anti").unionByName(redone)
    if len(walks) == 1:
        return final(results(walked))
    # the last walk of a block counts
    last = due.select(*part, "_walk")
    found = [results(w).withColumn("_walk", F.lit(n)) for n, w in enumerate(walks)]
    return final(reduce(DataFrame.unionByName, found).join(last, [*part, "_walk"], "left_semi"))


def _runs(frame: pd.DataFrame, part: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows of one key and block."""
    if frame.empty:
        return
    change = np.zeros(len(frame), bool)
    change[0] = True
    for c in part:
        values = frame[c].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    cuts = [*np.flatnonzero(change).tolist(), len(frame)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = frame.iloc[a:b]
        yield tuple(v.item() if isinstance(v, np.generic) else v for v in rows[part].iloc[0]), rows


def _entered(rows: DataFrame, summary: Summary, part: list[str], keys: list[str], key_schema: str) -> DataFrame:
    """``part, _in``: the memory each block begins with, from summaries composed up and down a tree."""
    node_schema = key_schema.replace("_block", "_node") + ", _parent long, _sum string"

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        done = lambda: pd.DataFrame([(*at, at[-1] // FANOUT, json.dumps(total))], columns=[*keys, "_node", "_parent", "_sum"], dtype=object)
        for frame in frames:
            for key, own in _runs(frame, part):
                here = summary.leave(own)
                if key == at:
                    total = summary.compose(total, here)
                    continue
                if at is not None:
                    yield done()
                at, total = key, here
        if at is not None:
            yield done()

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = [json.loads(s) for s in pdf.sort_values("_node")["_sum"]]
        total = sums[0]
        for s in sums[1:]:
            total = summary.compose(total, s)
        parent = int(pdf["_parent"].iloc[0])
        return pd.DataFrame([(*pdf[keys].iloc[0], parent, parent // FANOUT, json.dumps(total))], columns=[*keys, "_node", "_parent", "_sum"])

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_node")
        memory, out = json.loads(pdf["_in"].iloc[0]), []
        for s in pdf["_sum"]:
            out.append(json.dumps(memory))
            memory = summary.enter(memory, json.loads(s))
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "_node": pdf["_node"], "_in": out})

    levels = [settle(rows.mapInPandas(describe, node_schema))]
    top = levels[0].agg(F.max("_parent")).first()[0]
    while top is not None and top > 0:
        levels.append(levels[-1].groupBy(*keys, "_parent").applyInPandas(composed, node_schema))
        top //= FANOUT
    # the memory before each node of the top level, then before the nodes below it
    entered = levels[-1].select(*keys, "_parent").distinct().select(*keys, F.col("_parent").alias("_node"), F.lit("null").alias("_in"))
    in_schema = key_schema.replace("_block", "_node") + ", _in string"
    for level in reversed(levels):
        below = level.join(entered.withColumnRenamed("_node", "_parent"), [*keys, "_parent"])
        entered = below.groupBy(*keys, "_parent").applyInPandas(spread, in_schema)
    return entered.withColumnRenamed("_node", "_block")
