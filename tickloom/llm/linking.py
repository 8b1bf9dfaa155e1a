"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import settle


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``settle`` wrote and that a later table replaces."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours of each node on the smallest one: its larger neighbours, or itself and its smaller ones."""
    sides = edges if not larger else edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    hung = sides.join(least, "a")
    if larger:
        new = hung.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        new = hung.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return new.filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has an edge in ``a, b`` (longs); component is the smallest node reachable.

    Each round hangs larger neighbours, then smaller ones, on the smallest neighbour; the diameter shrinks geometrically, so
    the rounds grow with its logarithm. Hot nodes are summed before the shuffle and their joins can be split by AQE. Rows
    with a null end are ignored. Each round is written to the shared folder and replaces the one before.
    """
    ends = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = settle(edges.filter("a is not null and b is not null and a <> b").select(high.alias("a"), low.alias("b")).distinct())
    seen = ends(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        new = settle(_stars(_stars(now, True), False))
        found = ends(new)
        drop_table(now)
        now = new
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
