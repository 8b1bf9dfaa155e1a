"""Audit of how a source's words diverge from its language's and from other sources'.

Pass one counts in how many documents of a language each term stands; terms in enough documents are kept. The kept terms are sorted over the cluster by
range; each range of a language becomes a minimal acyclic transducer, built from its sorted terms, whose outputs sum to the term's number in
lexicographic order. Pass two streams the terms of the texts through the transducer of their range for recounting, collapsed before they travel to
one row per language, source and term, and leaves counts by ordinal. Ordinals of all ranges together are lexicographic, so they break ties.

All figures are exact integers: shares in parts of 10^9, rounded down, and their divergences.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.words import LOWER, parts, text_bytes, word_spans
from tickloom.session import settle

#: Bytes of a term: ASCII letters and all of a non-ASCII code point.
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
#: Parts that a share of 1 has.
UNIT = 10**9
#: Kept terms of one transducer, about.
RANGE_TERMS = 1 << 19
#: Ordinals of a range follow those of the range before; no range has so many terms.
RANGE_STEP = 1 << 32
#: Ordinals whose counts are compared between sources at once.
SLICE = 4096


class Transducer:
    """Minimal acyclic transducer over sorted distinct byte strings; the outputs along a string's path sum to its number.

    Arcs are sorted keys ``state << 8 | byte`` with a target and an output.
    """

    def __init__(self, terms: Iterator[bytes]):
        # a state with one arc, the usual kind, is known by one number, any other by its arcs
        register: dict[object, int] = {}
        counts, final, arcs = array("q"), bytearray(), []
        # of the path of the last string: depths that end a string, and finished arcs by depth
        ends: set[int] = set()
        open_: dict[int, list[tuple[int, int]]] = {}
        last: bytes | None = None

        def finished(depth: int) -> int:
            own, ending = open_.pop(depth, []), depth in ends
            ends.discard(depth)
            key = own[0][1] << 9 | own[0][0] << 1 | ending if len(own) == 1 else (ending, *own)
            state = register.get(key)
            if state is None:
                state = register[key] = len(counts)
                counts.append(ending + sum(counts[t] for _, t in own))
                final.append(ending)
                arcs.append(tuple(own))
            return state

        def close(text: bytes, depth: int) -> None:
            for k in range(len(text), depth, -1):
                state = finished(k)
                open_.setdefault(k - 1, []).append((text[k - 1], state))

        for term in terms:
            if last is not None:
                if term <= last:
                    raise ValueError("terms must be sorted and distinct")
                close(last, len(os.path.commonprefix([term, last])))
            ends.add(len(term))
            last = term
        close(last or b"", 0)
        self.root = finished(0)
        self.size = counts[self.root]
        self.final = np.frombuffer(final, np.uint8).astype(bool)
        keys, targets, outputs = [], [], []
        for state, own in enumerate(arcs):
            passed = final[state]
            for byte, target in own:
                keys.append(state << 8 | byte)
                targets.append(target)
                outputs.append(passed)
                passed += counts[target]
        self.keys, self.targets, self.outputs = (np.array(x, np.int64) for x in (keys, targets, outputs))

    def ordinals(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The number of each string ``data[begins[k]:begins[k + 1]]`` among the terms, -1 if it is none; all strings advance together."""
        n = len(begins) - 1
        state, total = np.full(n, self.root), np.zeros(n, np.int64)
        length, row, step = np.diff(begins), np.arange(n), 0
        while len(self.keys):
            row = row[length[row] > step]
            if not len(row):
                break
            key = state[row] << 8 | data[begins[row] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            state[row[~known]] = -1
            row, at = row[known], at[known]
            state[row], total[row] = self.targets[at], total[row] + self.outputs[at]
            step += 1
        stays = (state >= 0) & (length <= step)
        stays[stays] = self.final[state[stays]]
        return np.where(stays, total, -1)


def _terms(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of a batch of texts, and for every occurrence the row it stands in and its term's number."""
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, rows = word_spans(data, offsets, TERM)
    begins = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    column = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(begins), pa.py_buffer(np.ascontiguousarray(LOWER[data[TERM[data]]]))])
    coded = column.dictionary_encode()
    return coded.dictionary, np.repeat(np.arange(batch.num_rows), np.diff(rows)), coded.indices.to_numpy().astype(np.int64)


def _counted(names: list[str], once: bool):
    """Rows of the columns ``names``, a term and a count: of its documents (once) or its occurrences in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            terms, rows, numbers = _terms(batch)
            if not len(numbers):
                continue
            if once:
                pairs = np.unique(rows * len(terms) + numbers)
                rows, numbers = pairs // len(terms), pairs % len(terms)
            # groups of the batch's rows, and the first row of each
            group = np.zeros(batch.num_rows, np.int64)
            for c in names:
                coded = batch.column(c).dictionary_encode()
                _, head, group = np.unique(group * len(coded.dictionary) + coded.indices.to_numpy(), return_index=True, return_inverse=True)
            keys, counts = np.unique(group[rows] * len(terms) + numbers, return_counts=True)
            of = pa.array(head[keys // len(terms)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in names), terms.take(pa.array(keys % len(terms))), pa.array(counts)], [*names, "term", "n"])

    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its kept terms, sorted, become transducers; the texts' terms after them become counts by ordinal."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() * RANGE_STEP
    vocabulary: dict[str, list[bytes]] = {}
    built: dict[str, tuple[Transducer, int]] = {}

    def build() -> None:
        offset = base
        for lang in sorted(vocabulary, key=str.encode):
            built[lang] = Transducer(iter(vocabulary.pop(lang))), offset
            offset += built[lang][0].size

    for batch in batches:
        kept = batch.filter(pc.equal(batch.column("kind"), 0))
        for lang, term in zip(kept.column("lang").to_pylist(), kept.column("term").cast(pa.binary()).to_pylist(), strict=True):
            vocabulary.setdefault(lang, []).append(term)
        texts = batch.filter(pc.equal(batch.column("kind"), 1))
        if not texts.num_rows:
            continue
        build()
        coded = texts.column("lang").dictionary_encode()
        found = np.full(texts.num_rows, -1, np.int64)
        for k, lang in enumerate(coded.dictionary.to_pylist()):
            if lang not in built:
                continue
            own = np.flatnonzero(coded.indices.to_numpy() == k)
            data, begins = text_bytes(texts.column("term").take(pa.array(own)))
            transducer, offset = built[lang]
            ordinals = transducer.ordinals(data, begins)
            found[own] = np.where(ordinals >= 0, ordinals + offset, -1)
        stays = pa.array(found >= 0)
        yield pa.RecordBatch.from_arrays([*(texts.column(c).filter(stays) for c in ("lang", "source")), pa.array(found[found >= 0]), *(texts.column(c).filter(stays) for c in ("term", "n"))], ["lang", "source", "ordinal", "term", "n"])


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """``lang, term`` of the terms that stand in at least ``least`` documents of a language."""
    found = docs.select("lang", "text").mapInArrow(_counted(["lang"], True), "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def recount(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, ordinal, term, n``: occurrences of kept terms by their lexicographic ordinal."""
    spark = docs.sparkSession
    found = docs.mapInArrow(_counted(["lang", "source"], False), "lang string, source string, term string, n long")
    found = settle(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))
    size = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // RANGE_TERMS))
    columns = ["kind", "lang", "term", "source", "n"]
    both = kept.selectExpr("0 AS kind", "lang", "term", "'' AS source", "0L AS n").select(columns).union(found.selectExpr("1 AS kind", "lang", "source", "term", "n").select(columns))
    ranges_ = both.repartitionByRange(size, "lang", "term").sortWithinPartitions("kind", "lang", "term")
    return ranges_.mapInArrow(_streamed, "lang string, source string, ordinal long, term string, n long")


def _share(count: str, total: str, size: str) -> F.Column:
    """1 + floor(UNIT (count + 1) / (total + size)), in decimals since the product can leave a long."""
    return F.expr(f"1L + cast((cast({UNIT} AS decimal(10, 0)) * cast({count} + 1 AS decimal(20, 0))) div cast({total} + {size} AS decimal(20, 0)) AS long)")


def _compared(table: pa.Table) -> pa.Table:
    """Divergence sums between all sources of one language over one slice of ordinals; rows without an ordinal hold each source's share of absent terms."""
    absent = table.column("ordinal").is_null()
    heads, rows = table.filter(absent), table.filter(pc.invert(absent))
    sources, base = heads.column("source").to_pylist(), heads.column("p").to_numpy()
    number = {s: k for k, s in enumerate(sources)}
    terms, inverse = np.unique(rows.column("ordinal").to_numpy(), return_inverse=True)
    shares = np.repeat(base[None, :], len(terms), 0)
    shares[inverse, [number[s] for s in rows.column("source").to_pylist()]] = rows.column("p").to_numpy()
    n = len(sources)
    sums = np.stack([((shares[:, k : k + 1] - shares) ** 2 // shares).sum(0) for k in range(n)])
    names, here = pa.array(sources, pa.string()), np.arange(n)
    lang = pa.array(heads.column("lang").to_pylist()[:1] * (n * n), pa.string())
    return pa.table({"lang": lang, "source": names.take(pa.array(np.repeat(here, n))), "item": names.take(pa.array(np.tile(here, n))), "value": pa.array(sums.ravel())})


def divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank`` from rows of ``text, lang, source``.

    Terms are runs of ASCII letters and non-ASCII code points, A-Z as a-z; a language keeps those in at least ``least`` of its documents. A group (a language
    and source) gives a kept term the share p = 1 + floor(10^9 (count + 1) / (N + V)), N its occurrences of the V kept terms; a language does likewise. Against a
    share q the divergence is floor((p - q)^2 / q). Part ``pair``: the sum over all kept terms for each other source of the language; part ``term``: the ``top`` kept
    terms of the group that it uses more than its language does. Ranks count from the highest value, ties by the item's UTF-8 bytes.

    Null texts, languages and sources are read as empty; a group without terms has pairs, but no terms; a language without kept terms has sums of 0. Repeated rows and
    rows without an id are documents of their own. An empty table gives an empty result; further columns, doc_id among them, are ignored.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = settle(kept_terms(docs, least))
    counts = settle(recount(docs, kept))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "size"])
    groups = settle(groups)
    shared = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "size")).withColumn("slice", F.expr(f"ordinal div {SLICE}"))

    whole = groups.groupBy("lang", "size").agg(F.sum("total").alias("total"))
    use = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n")).join(whole, "lang").select("lang", "ordinal", _share("n", "total", "size").alias("q"))
    terms = shared.join(use, ["lang", "ordinal"]).filter("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    terms = terms.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    absent = groups.filter("size > 0").withColumn("p", _share("0", "total", "size")).join(shared.select("lang", "slice").distinct(), "lang")
    columns = ["lang", "slice", "source", "ordinal", "p"]
    rows = shared.select(columns).union(absent.withColumn("ordinal", F.lit(None).cast("long")).select(columns))
    sums = rows.groupBy("lang", "slice").applyInArrow(_compared, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.union(terms)


#: DuckDB statement for divergence over the table documents.
DIVERGENCE_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), found AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT d) >= 3
), sizes AS (
  SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k USING (lang) GROUP BY 1
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, s.v, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), uses AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n)::HUGEINT + 1) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q
  FROM shares GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares JOIN uses USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms QUALIFY rank <= 200
"""
