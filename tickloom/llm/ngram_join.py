"""Exact Jaccard self-join of documents on word n-grams, by rare-first prefix filtering.

1. *Classes.* Documents with the same n-gram set are one class; its smallest id stands for it from then on.
2. *Frequencies.* A fixed-size count sketch over all documents (``2**SKETCH_BITS`` counters, summed by Spark, then shared with
   every task) gives each n-gram an estimated frequency. Any common order makes prefix filtering exact; this one puts
   rare n-grams first, so that common passages stay out of the prefixes.
3. *Prefixes.* A set of ``n`` n-grams emits its first ``n - ceil(t n) + 1``. N-grams with one owner vanish in a window
   over the n-gram.
4. *Candidates.* Pairs that meet in a prefix and pass the length and positional filters. Two rounds compare every member of
   an n-gram's list with its first and its last member only; components that form there are contracted, and the last
   round compares just the pairs across components. So a group of copies costs a few comparisons a member, and no link between
   different components is lost.
5. *Suffix filter.* The two sets are cut at fixed hash ranges; the differences of the counts bound the overlap from above.
6. *Verification.* The whole sets of each remaining pair are intersected once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.linking import components, drop_table
from tickloom.llm.words import parts, shingles, text_bytes, word_hashes
from tickloom.session import settle

#: Counters of the frequency sketch, as a power of two; its size never depends on the data.
SKETCH_BITS = 20
_SLICES = 64
#: Ranges of the suffix filter.
_CUTS = 64


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    grams, begins = shingles(*word_hashes(*text_bytes(column)), size)
    return [np.unique(grams[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]


def _classes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            own = _sets(batch.column("text"), size)
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.array([len(x) for x in own], pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "print", "n_shingles", "key"])

    return run


def _partial_sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in parts(batches):
            own = _sets(batch.column("text"), size)
            if own:
                counts += np.bincount((np.concatenate(own) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        yield _sliced({k: x for k, x in enumerate(np.split(counts, _SLICES))})

    return run


def _sliced(slices: dict[int, np.ndarray]) -> pa.RecordBatch:
    data = [np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in slices.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array(data, pa.binary())], ["slice", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slices: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
            x = np.frombuffer(data.as_buffer(), np.uint32).astype(np.int64)
            slices[k] = slices[k] + x if k in slices else x
    yield _sliced(slices)


def frequency_sketch(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents have an n-gram of each hash bucket: ``2**SKETCH_BITS`` counters over all documents."""
    kind = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(_partial_sketch(size), kind).repartition(_SLICES // 4, "slice").mapInArrow(_summed, kind).collect()
    out = np.zeros((_SLICES, (1 << SKETCH_BITS) // _SLICES), np.uint32)
    for row in rows:
        out[row["slice"]] = np.frombuffer(row["counts"], np.uint32)
    return out.ravel()


def _prefixes(sketch, size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sketch.value
        for batch in parts(batches):
            grams, owners, sizes, places = [], [], [], []
            for doc, own in zip(batch.column("doc_id").to_pylist(), _sets(batch.column("text"), size), strict=True):
                n = len(own)
                if not n or doc is None:
                    continue
                most = n - -(-percent * n // 100) + 1
                # the rarest first, ties by hash
                first = own[np.argsort(seen[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:most]]
                grams.append(first)
                owners.append(np.full(most, doc))
                sizes.append(np.full(most, n))
                places.append(np.arange(most))
            if grams:
                columns = [np.concatenate(x) for x in (grams, owners, sizes, places)]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in columns], ["gram", "doc", "n", "place"])

    return run


def _pairs(both: DataFrame, percent: int) -> DataFrame:
    """Distinct id pairs of the prefix entries x and y that pass the length and positional filters: what can still be shared reaches the bound."""
    shared = "least(x.n - x.place, y.n - y.place)"
    close = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND {100 + percent} * {shared} >= {percent} * (x.n + y.n)"
    return both.filter(close).selectExpr("least(x.doc, y.doc) AS a", "greatest(x.doc, y.doc) AS b").distinct()


def _cuts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            own = _sets(batch.column("text"), size)
            counts = [np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=_CUTS).astype(np.uint32).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(counts, pa.binary())], ["doc_id", "text", "cuts"])

    return run


def _verified(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(parts([whole], "text_a"), "text_b"):
                keep = []
                known: dict[int, np.ndarray] = {}
                near = _suffix_bound(batch, percent)
                sets = {side: batch.column(f"text_{side}") for side in "ab"}
                for k in np.flatnonzero(near):
                    a = _known(known, batch.column("a")[k].as_py(), sets["a"].slice(k, 1), size)
                    b = _known(known, batch.column("b")[k].as_py(), sets["b"].slice(k, 1), size)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        keep.append(k)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def _known(known: dict, doc: int, text: pa.Array, size: int) -> np.ndarray:
    """The set of a text; the few last ones stay at hand, since pairs come sorted by one side."""
    key = (doc, hash(text[0].as_py()))
    if key not in known:
        if len(known) >= 8:
            known.pop(next(iter(known)))
        known[key] = _sets(text, size)[0]
    return known[key]


def _suffix_bound(batch: pa.RecordBatch, percent: int) -> np.ndarray:
    """Whether the counts in fixed hash ranges leave room for enough shared n-grams."""
    a, b = (np.frombuffer(b"".join(batch.column(f"cuts_{side}").to_pylist()), np.uint32).reshape(-1, _CUTS).astype(np.int64) for side in "ab")
    both = np.minimum(a, b).sum(1)
    return 100 * both >= percent * (a.sum(1) + b.sum(1) - both)


def _texts(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Texts and suffix-filter counts of the documents with these ids (which grow with the data, so they are never broadcast)."""
    return docs.join(ids.hint("merge"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_cuts(size), "doc_id long, text string, cuts binary")


def _checked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` of ids whose sets are alike enough."""
    side = lambda s: texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}"), F.col("cuts").alias(f"cuts_{s}")).hint("merge")
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_verified(size, percent), "a long, b long")


def near_links(docs: DataFrame, size: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """Set sizes and links of ``doc_id, text``: per row ``doc_id, n_shingles, stands`` and link pairs ``a, b`` of standing ids.

    ``stands`` is the smallest id with the same n-gram set (null for an empty set or a null id). The pairs contain enough verified
    links to join every two sets whose Jaccard likeness is at least ``percent`` / 100 into one component, and no others.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("print"))
    sized = settle(docs.mapInArrow(_classes(size), "doc_id long, print long, n_shingles long, key binary"))
    stands = settle(sized.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("stands"), F.count("*").alias("members")))
    copies = stands.filter("members > 1").select("key", "stands")
    placed = sized.join(copies, "key", "left").select(
        "doc_id", "print", "n_shingles", F.when(F.col("key").isNotNull() & F.col("doc_id").isNotNull(), F.coalesce("stands", "doc_id")).alias("stands")
    )
    spare = settle(placed.filter("stands < doc_id").select("doc_id", "print").distinct())
    single = docs.join(spare, ["doc_id", "print"], "left_anti")
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, size))
    entries = single.mapInArrow(_prefixes(sketch, size, percent), "gram long, doc long, n long, place long")
    gram = Window.partitionBy("gram")
    entry = F.struct("doc", "n", "place")
    lists = settle(entries.withColumns({"least": F.min(entry).over(gram), "most": F.max(entry).over(gram)}).filter("least.doc < most.doc"))
    texts = settle(_texts(single, lists.select(F.col("doc").alias("doc_id")).distinct(), size))
    # an id that has several texts joins their classes
    several = placed.filter("stands is not null").groupBy("doc_id").agg(F.min("stands").alias("c"), F.max("stands").alias("d")).filter("c < d").select("doc_id")
    links = placed.join(several, "doc_id", "left_semi").filter("stands < doc_id").select(F.col("stands").alias("a"), F.col("doc_id").alias("b")).distinct()
    tried, labels = None, None
    for hub in ("least", "most", None):
        if hub:
            # every member of a list against its first or last member
            pairs = _pairs(lists.select(entry.alias("x"), F.col(hub).alias("y")).filter("x.doc <> y.doc"), percent)
            if labels is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
                ends = [labels.select(F.col("node").alias(s), F.col("component").alias(f"of_{s}")) for s in "ab"]
                pairs = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").filter("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
        else:
            # the pairs across components of the lists that still have several
            named = lists.select("gram", "doc", "n", "place").join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
            open_lists = named.groupBy("gram").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter("c < d").select("gram")
            rest = named.join(open_lists, "gram", "left_semi").select("gram", F.struct("doc", "n", "place", "component").alias("x"))
            pairs = _pairs(rest.join(rest.withColumnRenamed("x", "y"), "gram").filter("x.doc < y.doc AND x.component <> y.component"), percent)
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = settle(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        links = links.union(settle(_checked(pairs, texts, size, percent)))
        if hub:
            labels = components(links)
    drop_table(lists)
    drop_table(texts)
    return placed, links


def near_components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``doc_id, text``.

    Words are runs of non-white bytes with A-Z lower-cased; the set of a text is its distinct runs of ``size`` words, the
    whole sequence as one when it has fewer words, and empty without words or text. Two documents link when
    ``100 * intersection >= percent * union``; component_id is the smallest doc_id reachable by links, itself included.

    Defined results: a null or blank text has 0 n-grams and is its own component; a row with a null doc_id keeps its size,
    links with nothing and has a null component; rows that share a doc_id stand for one document that links if any of them does;
    an empty table gives an empty result; further columns are ignored.
    """
    placed, links = near_links(docs, size, percent)
    labels = components(links).withColumnRenamed("node", "stands")
    return placed.join(labels, "stands", "left").select("doc_id", "n_shingles", F.coalesce("component", "stands", "doc_id").alias("component_id"))


#: DuckDB statement for near_components over a table of that name: all shared n-grams of all pairs, then all that is reachable.
COMPONENTS_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM split
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id JOIN sizes s ON s.doc_id = x.doc_id JOIN sizes t ON t.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, s.n, t.n HAVING 100 * count(*) >= 75 * (s.n + t.n - count(*))
), reached AS (
  SELECT doc_id AS node, doc_id AS start FROM documents
  UNION
  SELECT l.b, r.start FROM reached r JOIN links l ON l.a = r.node
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT node, min(start) AS component_id FROM reached GROUP BY node) c ON c.node = d.doc_id
"""
