"""Hard negatives by best-first search over STR-packed R-trees.

Vectors are range-partitioned into shards by label and first components; a shard packs its rows into pages by sort-tile-recursive order, and
Spark carries every anchor to the shards that can hold an answer. There the pages become an R-tree: a box of coordinate minima and maxima
bounds the inner product of everything below it to an interval, summed over the coordinates. A queue opens the box with the highest upper
end first; boxes outside all score windows, or strictly below the k-th best of every window, are left out. Scores are exact integers.

Anchors are a stated query set: their copies are anchors times shards, and a shard holds at least ``SHARD_ROWS`` rows once the table has more than
that per shuffle partition. A task holds one shard's tree and streams the anchors past it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import settle

#: Rows of a shard, once there are more than this for each shuffle partition.
SHARD_ROWS = 1 << 18
PAGE_ROWS = 64
FANOUT = 16
#: Slabs that one coordinate is cut into by the tile order.
SLABS = 4


def tile_order(vectors: np.ndarray, page: int = PAGE_ROWS) -> np.ndarray:
    """Sort-tile-recursive order: slabs of whole pages by the coordinate that spreads most, each slab cut again by the next one."""
    spread = np.argsort(-np.ptp(vectors, axis=0), kind="stable") if len(vectors) else np.arange(0)

    def cut(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        pages = -(-len(rows) // page)
        rows = rows[np.argsort(vectors[rows, spread[depth]], kind="stable")]
        if pages <= 1:
            return [rows]
        if depth + 1 == len(spread):
            return [rows]
        slab = -(-pages // SLABS) * page
        return [x for k in range(0, len(rows), slab) for x in cut(rows[k : k + slab], depth + 1)]

    return np.concatenate(cut(np.arange(len(vectors)), 0)) if len(vectors) else np.arange(0)


@dataclass
class Level:
    """Boxes of one level: coordinate minima and maxima, label range, and the numbers below that each covers."""

    low: np.ndarray
    high: np.ndarray
    first_label: np.ndarray
    last_label: np.ndarray
    begins: np.ndarray


class Tree:
    """R-tree over pages of one label each, in the order of the pages; level 0 has one box per page."""

    def __init__(self, pages: list[tuple[int, np.ndarray, np.ndarray]]):
        self.ids = np.concatenate([ids for _, ids, _ in pages])
        whole = np.concatenate([codes for _, _, codes in pages]).astype(np.int64)
        self.top = int(np.abs(whole).max())
        self.whole, self.floats = whole, whole.astype(float)
        begins = np.cumsum([0, *(len(ids) for _, ids, _ in pages)])
        labels = np.array([label for label, _, _ in pages], np.int64)
        low, high, first, last = np.minimum.reduceat(whole, begins[:-1]), np.maximum.reduceat(whole, begins[:-1]), labels, labels
        self.levels = [Level(low, high, first, last, begins)]
        while len(low) > 1:
            heads = np.arange(0, len(low), FANOUT)
            begins = np.append(heads, len(low))
            low, high = np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
            first, last = np.minimum.reduceat(first, heads), np.maximum.reduceat(last, heads)
            self.levels.append(Level(low, high, first, last, begins))

    def search(self, query: np.ndarray, label: int, same: bool, low: np.ndarray, high: np.ndarray, k: int, skip: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window low..high the first ``k`` rows of the same label, or of another one, by score, then by id: scores and ids."""
        exact = len(query) * self.top * int(np.abs(query).max()) < 2**53
        rows = self.floats if exact else self.whole
        q = query.astype(rows.dtype)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        floor, ceiling = low.copy(), high
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
        queue: list[tuple[int, int, int, int]] = []

        def push(level: int, a: int, b: int) -> None:
            boxes = self.levels[level]
            bottom, top = boxes.low[a:b], boxes.high[a:b]
            least = (bottom @ up + top @ down).astype(np.int64)
            most = (top @ up + bottom @ down).astype(np.int64)
            if same:
                fit = (boxes.first_label[a:b] <= label) & (label <= boxes.last_label[a:b])
            else:
                fit = (boxes.first_label[a:b] != label) | (boxes.last_label[a:b] != label)
            fit &= ((most[:, None] >= floor) & (least[:, None] <= ceiling)).any(1)
            for n in np.flatnonzero(fit).tolist():
                heapq.heappush(queue, (-int(most[n]), level, a + n, int(least[n])))

        push(len(self.levels) - 1, 0, 1)
        while queue:
            below, level, n, least = heapq.heappop(queue)
            wanted = np.flatnonzero((floor <= -below) & (ceiling >= least))
            if not len(wanted):
                continue
            a, b = int(self.levels[level].begins[n]), int(self.levels[level].begins[n + 1])
            if level:
                push(level - 1, a, b)
                continue
            scores = (rows[a:b] @ q).astype(np.int64)
            for w in wanted.tolist():
                hit = (scores >= floor[w]) & (scores <= ceiling[w])
                if skip is not None:
                    hit &= self.ids[a:b] != skip
                if not hit.any():
                    continue
                found, ids = np.concatenate((best[w][0], scores[hit])), np.concatenate((best[w][1], self.ids[a:b][hit]))
                # sorted by the highest score first; the negated order also holds for the smallest long
                order = np.lexsort((ids, ~found))[:k]
                best[w] = found[order], ids[order]
                if len(order) == k:
                    floor[w] = best[w][0][-1]
        return best


def _paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of one shard, which is one partition."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    whole = pa.Table.from_batches(list(batches)) if batches else None
    if whole is None or not whole.num_rows:
        return
    key = np.stack([whole.column(c).to_numpy() for c in ("dim", "label")])
    heads = np.flatnonzero(np.concatenate(([True], (np.diff(key, axis=1) != 0).any(0))))
    page = 0
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), whole.num_rows], strict=True):
        own = whole.slice(a, b - a).combine_chunks()
        dim = int(key[0, a])
        codes = own.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        order = tile_order(codes)
        ids, codes = own.column("vec_id").to_numpy()[order], codes[order]
        cuts = np.append(np.arange(0, b - a, PAGE_ROWS), b - a)
        n = len(cuts) - 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, shard, np.int32)),
                pa.array(np.arange(page, page + n, dtype=np.int32)),
                pa.array(np.full(n, dim, np.int32)),
                pa.array(np.full(n, key[1, a])),
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)),
                pa.ListArray.from_arrays(pa.array((cuts * dim).astype(np.int32)), pa.array(codes.ravel().astype(np.int32))),
            ],
            ["shard", "page", "dim", "label", "ids", "codes"],
        )
        page += n


def _searched(same: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pages, trees = None, {}, {}
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                shard, dim, label, anchor, mark = (batch.column(c)[row].as_py() for c in ("shard", "dim", "label", "anchor_id", "mark"))
                if shard != at:
                    at, pages, trees = shard, {}, {}
                codes = batch.column("codes")[row].values.to_numpy()
                if anchor is None:
                    ids = batch.column("ids")[row].values.to_numpy()
                    pages.setdefault(dim, []).append((label, ids, codes.reshape(-1, dim)))
                    continue
                if dim not in trees:
                    trees[dim] = Tree(pages.pop(dim))
                low, high = (batch.column(c)[row].values.to_numpy() for c in ("low", "high"))
                for w, (scores, ids) in enumerate(trees[dim].search(codes, label, same, low, high, k, anchor if same else None)):
                    if len(ids):
                        found.append((np.full(len(ids), anchor), np.full(len(ids), mark), np.full(len(ids), w, np.int32), ids, scores))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["anchor_id", "mark", "window", "vec_id", "score"])

    return run


def _best_rows(pages: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """``anchor_id, mark, window, vec_id, score, rank``: the first ``k`` rows per window of each row of ``anchor_id, mark, dim, label, codes, low, high``."""
    spark = pages.sparkSession
    if same:
        sent = anchors.join(pages.select("shard", "dim", "label").distinct(), ["dim", "label"])
    else:
        labels = pages.groupBy("shard", "dim").agg(F.min("label").alias("first__"), F.max("label").alias("last__"))
        sent = anchors.join(labels, "dim").filter("first__ <> label OR last__ <> label")
    columns = ["shard", "kind", "page", "dim", "label", "anchor_id", "mark", "ids", "codes", "low", "high"]
    none, nothing = F.lit(None).cast("long"), F.lit(None).cast("array<long>")
    stored = pages.withColumns({"kind": F.lit(0), "anchor_id": none, "mark": none, "low": nothing, "high": nothing})
    asked = sent.withColumns({"kind": F.lit(1), "page": F.lit(0), "ids": nothing})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored.select(columns).union(asked.select(columns)).repartition(parts, "shard").sortWithinPartitions("shard", "kind", "page")
    found = rows.mapInArrow(_searched(same, k), "anchor_id long, mark long, window int, vec_id long, score long")
    first = Window.partitionBy("anchor_id", "mark", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from rows of ``vec_id, embedding, label``.

    Components become floor(256 x), scores are inner products of these integers, ordered from the highest, ties by the smaller vec_id. Anchors are the
    rows whose vec_id is divisible by ``every``; their positives the first rows of their label with another vec_id; the negatives of a positive the
    first rows of other labels with low % to high % of the positive's score, ends included.

    A row with a null id, label or vector, with an empty vector, or with a null or non-finite component takes no part, nor does one with a component
    so large that scores wouldn't fit a long (3.8e8 after scaling, at 64 components). Rows equal in all three columns count once; different rows with
    one vec_id count on their own, as anchors too. Vectors of different lengths are never compared. An anchor without positives and a positive without
    negatives give no row; the window of a negative score is empty. An empty table gives an empty result; further columns are ignored.
    """
    spark = rows.sparkSession
    base = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("x")).dropna()
    base = base.withColumn("dim", F.size("x")).filter("dim > 0 AND forall(x, v -> v IS NOT NULL AND NOT isnan(v))")
    base = base.filter("forall(x, v -> abs(v * 256D) < least(floor(sqrt(9223372036854775807D / dim)) - 1, 2147483647))")
    base = settle(base.selectExpr("vec_id", "label", "dim", "transform(x, v -> cast(floor(v * 256D) AS int)) AS codes").distinct())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // SHARD_ROWS))
    spread = base.withColumns({"x0__": F.expr("codes[0]"), "x1__": F.expr("get(codes, 1)"), "h__": F.xxhash64("vec_id", "codes")})
    shards = spread.repartitionByRange(parts, "dim", "label", "x0__", "x1__", "h__").sortWithinPartitions("dim", "label")
    pages = settle(shards.select("vec_id", "label", "dim", "codes").mapInArrow(_paged, "shard int, page int, dim int, label long, ids array<long>, codes array<int>"))
    anchors = base.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "codes").alias("mark"), "dim", "label", "codes")
    # the first search has one window that holds every score
    open_ = anchors.withColumns({"low": F.array(F.lit(1 - 2**63)), "high": F.array(F.lit(2**63 - 1))})
    found = _best_rows(pages, open_, True, positives).groupBy("anchor_id", "mark").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    found = settle(found)
    asked = anchors.join(found, ["anchor_id", "mark"])
    asked = asked.withColumn("low", F.expr(f"transform(positives, p -> cast(ceil(cast(p.score AS decimal(20, 0)) * {low} / 100) AS long))"))
    asked = asked.withColumn("high", F.expr(f"transform(positives, p -> cast(floor(cast(p.score AS decimal(20, 0)) * {high} / 100) AS long))"))
    best = _best_rows(pages, asked.drop("positives"), False, negatives).join(found, ["anchor_id", "mark"]).withColumn("p", F.expr("positives[window]"))
    return best.select("anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


#: DuckDB statement for hard_negatives over the table embeddings, where labels of ids divisible by 7 are moved on by one.
NEGATIVES_SQL = """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(x::DOUBLE * 256) FOR x IN embedding] AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_dot_product(a.code, b.code)::BIGINT AS score
  FROM fit a JOIN fit b ON a.vec_id % 100 = 0 AND len(a.code) = len(b.code)
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND n.label <> n.own
  AND 30 * p.positive_score::HUGEINT <= 100 * n.score::HUGEINT AND 100 * n.score::HUGEINT <= 90 * p.positive_score::HUGEINT
QUALIFY rank <= 10
"""
