"""Nearest earlier level below a value, and the greatest one since: a search over trees of block extremes.

A key's levels are numbered from 0 without gaps. ``FANOUT`` levels make a leaf; a node keeps the lowest ``near`` and the greatest ``far`` of each of
its children, and ``FANOUT`` nodes make a node of the next level, up to one root per key. A leaf also gets its path: the extremes of all nodes
to the left of it that together cover every earlier level, nearest first. So a probe meets one row, which tells either its level or the one
node that must be opened; each opening is an equality join of the probes that are left. Probes move once per level of the tree, levels
once per side, and neither depends on how far back an answer lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import settle

FANOUT = 32


def level_tree(levels: DataFrame, keys: Sequence[str], fanout: int = FANOUT) -> list[DataFrame]:
    """Tables ``keys, node, kids`` from the leaves up to the roots.

    ``levels`` has ``keys, run, near, far, point``: the number, a score or null, a struct that starts with a score or null, and a payload. A kid is
    ``id, near, far`` (its lowest and greatest), in a leaf also ``point``.
    """
    keys = list(keys)
    kid = F.struct(F.col("run").alias("id"), "near", "far", "point")
    tables = [settle(_grouped(levels.withColumn("node", F.expr(f"run div {fanout}")), keys, kid))]
    top = tables[0].agg(F.max("node")).first()[0] or 0
    while top:
        near, far = F.array_min(F.transform("kids", lambda k: k["near"])), _greatest(F.col("kids"))
        kid = F.struct(F.col("node").alias("id"), near.alias("near"), far.alias("far"))
        below = tables[-1].select(*keys, kid.alias("kid"), F.expr(f"node div {fanout}").alias("node"))
        tables.append(settle(_grouped(below, keys, F.col("kid"))))
        top //= fanout
    return tables


def _grouped(rows: DataFrame, keys: list[str], kid: Column) -> DataFrame:
    return rows.groupBy(*keys, "node").agg(F.array_sort(F.collect_list(kid)).alias("kids"))


def _paths(tables: list[DataFrame], keys: list[str], fanout: int) -> DataFrame:
    """Leaves with ``path``: entries ``level, id, near, far`` of the nodes left of the leaf, nearest first."""
    far = tables[0].schema["kids"].dataType.elementType["far"].dataType.simpleString()
    nothing = F.array().cast(f"array<struct<level:int,id:bigint,near:double,far:{far}>>")
    rows = tables[0].withColumns({"path": nothing, "_at": F.col("node"), "_level": F.lit(0)})
    for table in tables[1:]:
        above = table.select(*keys, F.col("node").alias("_above"), F.col("kids").alias("_kids"))
        rows = rows.withColumn("_above", F.expr(f"_at div {fanout}")).join(above, [*keys, "_above"])
        left = F.filter("_kids", lambda k: k["id"] < F.col("_at"))
        left = F.transform(left, lambda k: F.struct(F.col("_level").alias("level"), k["id"].alias("id"), k["near"].alias("near"), k["far"].alias("far")))
        rows = rows.withColumn("path", F.concat("path", F.reverse(left))).withColumns({"_at": F.col("_above"), "_level": F.col("_level") + 1}).drop("_above", "_kids")
    return rows.drop("_at", "_level")


def _last(kids: Column) -> Column:
    return F.try_element_at(kids, F.lit(-1))


def _greatest(kids: Column) -> Column:
    return F.array_max(F.transform(kids, lambda k: k["far"]))


def nearest_below(probes: DataFrame, tables: list[DataFrame], keys: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """``probes`` with ``near`` (the level's ``id, point``) and ``far``.

    For ``last_run`` and ``value`` of a probe, ``near`` is the latest level up to that number whose near score is below the value, null if none is;
    ``far`` the greatest far struct of the levels after it, up to that number, null without one or without ``near``.
    """
    keys = list(keys)
    leaves = _paths(tables, keys, fanout).withColumnRenamed("node", "_leaf")
    met = probes.withColumn("_leaf", F.expr(f"last_run div {fanout}")).join(leaves, [*keys, "_leaf"]).drop("_leaf")
    met = met.withColumn("_seen", F.filter("kids", lambda k: k["id"] <= F.col("last_run"))).withColumn("_kid", _last(F.filter("_seen", lambda k: k["near"] < F.col("value"))))
    met = met.withColumn("_node", F.when(F.col("_kid").isNull(), F.try_element_at(F.filter("path", lambda k: k["near"] < F.col("value")), F.lit(1))))
    node = F.col("_node")
    between = F.filter("path", lambda k: (k["level"] < node["level"]) | ((k["level"] == node["level"]) & (k["id"] > node["id"])))
    far = F.when(F.col("_kid").isNotNull(), _greatest(F.filter("_seen", lambda k: k["id"] > F.col("_kid.id")))).when(node.isNotNull(), _greatest_of(_greatest(F.col("_seen")), _greatest(between)))
    near = F.when(F.col("_kid").isNotNull(), F.struct("_kid.id", "_kid.point"))
    columns = [*probes.columns, "near", "far"]
    met = met.withColumns({"near": near, "far": far}).select(*columns, "_node.level", "_node.id")
    if len(tables) == 1:
        return met.select(columns)
    met = settle(met)
    done, open_ = met.where(F.col("id").isNull()).select(columns), None
    for level in range(len(tables) - 2, -1, -1):
        here = met.where(F.col("level") == level).drop("level")
        open_ = here if open_ is None else here.unionByName(open_)
        below = tables[level].select(*keys, F.col("node").alias("id"), "kids")
        open_ = open_.join(below, [*keys, "id"]).withColumn("_kid", _last(F.filter("kids", lambda k: k["near"] < F.col("value"))))
        far = _greatest_of(F.col("far"), _greatest(F.filter("kids", lambda k: k["id"] > F.col("_kid.id"))))
        open_ = open_.withColumn("far", far)
        if level:
            open_ = open_.select(*columns, F.col("_kid.id").alias("id"))
    return done.unionByName(open_.withColumn("near", F.struct("_kid.id", "_kid.point")).select(columns))


def _greatest_of(a: Column, b: Column) -> Column:
    return F.array_max(F.array(a, b))


def levels_between(probes: DataFrame, tables: list[DataFrame], keys: Sequence[str], id_: Sequence[str], keep, fanout: int = FANOUT) -> DataFrame:
    """``id_`` and ``levels`` per probe: the leaf kids numbered ``first_run`` to ``last_run`` that ``keep(kid)`` accepts, reduced per leaf and in total to those of a new greatest far."""
    keys = list(keys)
    spread = probes.withColumn("node", F.explode(F.sequence(F.expr(f"first_run div {fanout}"), F.expr(f"last_run div {fanout}"))))
    met = spread.join(tables[0], [*keys, "node"])
    kept = F.filter("kids", lambda k: (k["id"] >= F.col("first_run")) & (k["id"] <= F.col("last_run")) & k["far"].isNotNull() & keep(k))
    met = met.select(*id_, new_greatest(F.transform(kept, lambda k: F.struct(k["id"], k["far"]["score"].alias("score"), k["point"]))).alias("_kept"))
    return met.where(F.size("_kept") > 0).groupBy(*id_).agg(new_greatest(F.array_sort(F.flatten(F.collect_list("_kept")))).alias("levels"))


def new_greatest(items: Column) -> Column:
    """Items (with ``score``) whose score is above all before them."""
    return F.filter(items, lambda x, n: (n == 0) | (x["score"] > F.array_max(F.transform(F.slice(items, 1, n), lambda y: y["score"]))))
