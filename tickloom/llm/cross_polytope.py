"""Near duplicates among embeddings by cross-polytope hashing.

A vector is rotated by signs and fast Hadamard transforms; its hash is the nearest vertex of the cross-polytope (largest coordinate and its
sign). ``HASHES`` of them make a bucket code, ``TABLES`` codes are taken. Besides its own code a vector probes those in which one hash is
replaced by its second nearest vertex; at a cosine of 0.93 in 64 dimensions a pair is missed about once in 800. Spark joins the vectors of a bucket; every pair of a bucket in which one side has its own
code is verified by the cosine in double precision.

Equal vectors of a label are one vector with a number of copies, so a group of copies costs one row.

Buckets over ``BLOCK`` rows are cut into blocks, and every pair of blocks is a task's unit of its own, so no group grows with the data. Links are
counted where a pair meets first (by table, then code), so a pair that meets in several buckets counts once, and what leaves a unit is
a count and one edge per vector, to the smallest id that the unit's links reach from it: a spanning forest, never the list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.linking import components
from tickloom.llm.words import keyed
from tickloom.session import settle

TABLES, HASHES = 12, 3
#: Own code, and one with each hash replaced by its second nearest vertex.
CODES = 1 + HASHES
BLOCK = 256
_SEED = 202


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised Walsh-Hadamard transform of each row."""
    n, size = x.shape
    step = 1
    while step < size:
        y = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, size)
        step *= 2
    return x


def codes(vectors: np.ndarray) -> np.ndarray:
    """Bucket codes of unit vectors: rows x TABLES x CODES, the own code first."""
    n, dim = vectors.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = vectors
    signs = np.where(keyed(_SEED, TABLES * HASHES * 3 * size) >> np.uint64(63), 1.0, -1.0).reshape(TABLES, HASHES, 3, size)
    out = np.empty((n, TABLES, CODES), np.int64)
    every = np.arange(n)
    for t in range(TABLES):
        best, second = np.empty((n, HASHES), np.int64), np.empty((n, HASHES), np.int64)
        for h in range(HASHES):
            x = padded
            for r in range(3):
                x = _hadamard(x * signs[t, h, r])
            top = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
            swap = np.abs(x[every, top[:, 1]]) > np.abs(x[every, top[:, 0]])
            top[swap] = top[swap][:, ::-1]
            vertex = top * 2 + (x[every[:, None], top] < 0)
            best[:, h], second[:, h] = vertex[:, 0], vertex[:, 1]
        scale = (2 * size) ** np.arange(HASHES)
        out[:, t, 0] = (best * scale).sum(1)
        for h in range(HASHES):
            out[:, t, 1 + h] = out[:, t, 0] + (second[:, h] - best[:, h]) * scale[h]
    return out


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one length as a double matrix, scaled to length 1, and which rows can be compared (finite, not zero)."""
    flat = column.flatten()
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    with np.errstate(all="ignore"):
        # scaled first, so that very large or small components don't overflow when squared
        x = x / np.abs(x).max(1, keepdims=True, initial=0.0)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
    return x, np.isfinite(x).all(1)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = np.array(batch.column("dim").to_pylist(), np.int64)
        for dim in np.unique(lengths).tolist():
            rows = batch.take(pa.array(np.flatnonzero(lengths == dim)))
            unit, fit = _matrix(rows.column("embedding"))
            rows, unit = rows.filter(pa.array(fit)), unit[fit]
            found = codes(unit)
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c) for c in ("vec_id", "mark", "label", "dim", "copies")),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * dim), pa.array(unit.ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * TABLES * CODES), pa.array(found.ravel())),
                ],
                ["vec_id", "mark", "label", "dim", "copies", "unit", "codes"],
            )


def _met_before(a: np.ndarray, b: np.ndarray, table: int, code: int) -> np.ndarray:
    """Whether pairs of code arrays (pairs x TABLES x CODES) share a bucket before this one."""
    meets = lambda t: ((a[:, t, :1] == b[:, t]).any(1) | (b[:, t, :1] == a[:, t]).any(1))
    out = np.zeros(len(a), bool)
    for t in range(table):
        out |= meets(t)
    # in the same table a pair can meet at the own code of either side
    for x, y in ((a, b), (b, a)):
        own = x[:, table, 0]
        out |= (own < code) & (own[:, None] == y[:, table]).any(1)
    return out


def _least_reached(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest id that the links x - y (row numbers) reach from each row, itself included."""
    order = np.argsort(ids, kind="stable")
    root = np.empty(len(ids), np.int64)
    root[order] = np.arange(len(ids))
    x, y = root[x], root[y]
    # rows by rank of their id from here on
    root = np.arange(len(ids))
    while len(x):
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            break
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
    out = np.empty_like(ids)
    out[order] = ids[order][root]
    return out


def _linked(percent: int):
    def unit(rows: dict[str, np.ndarray], a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, link counts and smallest reached id of the rows a..b, which are one unit of a bucket."""
        vectors, code, own, side, copies = (rows[c][a:b] for c in ("unit", "codes", "own", "side", "copies"))
        near = vectors @ vectors.T >= percent / 100
        near &= own[:, None] | own[None, :]
        # a unit of two blocks compares across them only
        if rows["i"][a] != rows["j"][a]:
            near &= (side[:, None] == 0) & (side[None, :] == 1)
        x, y = np.nonzero(near)
        keep = x < y if rows["i"][a] == rows["j"][a] else np.ones(len(x), bool)
        x, y = x[keep], y[keep]
        first = ~_met_before(code[x], code[y], int(rows["t"][a]), int(rows["code"][a]))
        counts = np.zeros(b - a, np.int64)
        np.add.at(counts, x[first], copies[y[first]])
        np.add.at(counts, y[first], copies[x[first]])
        ids = rows["vec_id"][a:b]
        yield ids, counts, _least_reached(ids, x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: pa.Table | None = None
        keys = ["dim", "label", "t", "code", "i", "j"]

        def solved(whole: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            key = np.stack([whole.column(c).to_numpy() for c in keys])
            heads = np.flatnonzero(np.concatenate(([True], (np.diff(key, axis=1) != 0).any(0))))
            cuts = [*heads.tolist(), whole.num_rows] if last else heads.tolist()
            out = []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high - low < 2:
                    continue
                own = whole.slice(low, high - low).combine_chunks()
                rows = {c: own.column(c).to_numpy() for c in ("vec_id", "mark", "own", "side", "copies", *keys)}
                rows["unit"] = own.column("unit").combine_chunks().flatten().to_numpy().reshape(high - low, -1)
                rows["codes"] = own.column("codes").combine_chunks().flatten().to_numpy().reshape(high - low, TABLES, CODES)
                for ids, counts, least in unit(rows, 0, high - low):
                    out.append((ids, rows["mark"], counts, least))
            done = None
            if out:
                ids, marks, counts, least = (np.concatenate(x) for x in zip(*out, strict=True))
                some = least < ids
                some |= counts > 0
                done = pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ids, marks, counts, least)], ["vec_id", "mark", "links", "least"])
            return done, None if last else whole.slice(cuts[-1])

        for batch in batches:
            whole = pa.Table.from_batches([batch])
            whole = whole if wait is None else pa.concat_tables([wait, whole]).combine_chunks()
            done, wait = solved(whole, False)
            if done is not None:
                yield done
        if wait is not None and wait.num_rows:
            done, _ = solved(wait, True)
            if done is not None:
                yield done

    return run


def near_vectors(rows: DataFrame, percent: int = 93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vec_id, embedding, label``.

    Two vectors link when their labels are equal and not null, their lengths are equal and their cosine is at least percent / 100.
    n_links counts the other vectors linked directly, component_id is the smallest vec_id reachable by links, kept whether that is its own.

    A null, zero or empty vector, one with a null or non-finite component, and a row with a null label or vec_id link with nothing; a null
    vec_id has a null component and is not kept. Rows that are equal in all three columns are one vector and get equal results; different
    vectors with one vec_id count on their own and share the component. An empty table gives an empty result; further columns are ignored.
    """
    base = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).withColumn("mark", F.xxhash64("label", "embedding"))
    fit = base.dropna().withColumn("dim", F.size("embedding")).filter("dim > 0").dropDuplicates(["vec_id", "mark"])
    # equal vectors of a label are one, that of the smallest id, which counts as often as there are copies
    classes = fit.groupBy("mark", "label", "dim", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    kind = "vec_id long, mark long, label long, dim int, copies long, unit array<double>, codes array<long>"
    vectors = settle(classes.select("vec_id", "mark", "label", "dim", "copies", "embedding").mapInArrow(_coded, kind))
    codes_ = vectors.select("vec_id", "mark", "label", "dim", F.posexplode("codes").alias("at", "code"))
    spots = codes_.select("vec_id", "mark", "label", "dim", F.expr(f"cast(at div {CODES} AS int)").alias("t"), (F.col("at") % CODES == 0).alias("own"), "code")
    spots = spots.groupBy("vec_id", "mark", "label", "dim", "t", "code").agg(F.max("own").alias("own"))
    bucket = ["dim", "label", "t", "code"]
    sizes = settle(spots.groupBy(*bucket).agg(F.count("*").alias("members"), F.count_if("own").alias("owners")).filter("members > 1 AND owners > 0"))
    met = spots.join(sizes, bucket).withColumn("blocks", F.expr(f"cast(ceil(members / {BLOCK}) AS int)"))
    met = met.withColumn("block", F.expr("cast(pmod(xxhash64(vec_id, mark), blocks) AS int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("side", F.expr("cast(block > other AS int)"))
    units = met.select("vec_id", "mark", *bucket, "own", "i", "j", "side").join(vectors.select("vec_id", "mark", "copies", "unit", "codes"), ["vec_id", "mark"])
    keys = [*bucket, "i", "j"]
    parts_ = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = settle(units.repartition(parts_, *keys).sortWithinPartitions(*keys).mapInArrow(_linked(percent), "vec_id long, mark long, links long, least long"))
    counts = vectors.select("mark", F.col("vec_id").alias("stands"), "copies").join(
        found.groupBy(F.col("vec_id").alias("stands"), "mark").agg(F.sum("links").alias("links")), ["stands", "mark"], "left"
    )
    placed = base.join(counts, "mark", "left").withColumn("n_links", F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0)))
    placed = placed.withColumn("n_links", F.when(F.col("vec_id").isNull(), 0).otherwise(F.col("n_links")))
    same = placed.filter("stands < vec_id").select(F.col("vec_id").alias("a"), F.col("stands").alias("b")).distinct()
    labels = components(found.select(F.col("vec_id").alias("a"), F.col("least").alias("b")).union(same)).withColumnRenamed("node", "vec_id")
    out = placed.join(labels, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


#: DuckDB statement for near_vectors over the table embeddings: the cosines of all pairs, then all that is reachable.
VECTORS_SQL = """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93
), reached AS (
  SELECT vec_id AS node, vec_id AS start FROM embeddings
  UNION
  SELECT l.b, r.start FROM reached r JOIN links l ON l.a = r.node
), labelled AS (
  SELECT node, min(start) AS component_id FROM reached GROUP BY node
)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.component_id = e.vec_id AS kept FROM embeddings e JOIN labelled c ON c.node = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id
"""
