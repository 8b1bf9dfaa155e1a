"""MinHash fingerprints of documents, their likeness, and near duplicates by signature bands.

A fingerprint is the minimum of each of ``PERMUTATIONS`` universal hash functions ``a x + b mod 2**64`` over the hashed word shingles, all
computed in numpy over whole Arrow batches. Near duplicates share a band of the fingerprint; Spark joins the bands and the
Jaccard likeness of each candidate pair is verified on the whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.linking import components, drop_table
from tickloom.llm.words import keyed, parts, shingles, text_bytes, word_hashes
from tickloom.session import settle

PERMUTATIONS = 128
#: Bands and rows of each; at a likeness of 0.75 a pair shares a band with a chance of 0.999.
BANDS, BAND_ROWS = 25, 5
_SCALE = keyed(101, PERMUTATIONS) | np.uint64(1)
_SHIFT = keyed(102, PERMUTATIONS)
#: Shingles that are permuted at once, few enough for the processor's cache.
_BLOCK = 1 << 14
#: Bytes of text worked on at once.
PART_BYTES = 4 << 20
#: Rounds at most in which the members of a list are compared with one of them, and the pairs for each entry of a list that are compared without further rounds.
RARE_ROUNDS = 12
MOST_PAIRS = 1000
#: Bits of the map of ids whose texts are compared, as a power of two; its size never depends on the data.
_BITMAP_BITS = 24


def signatures(column: pa.Array, size: int = 5) -> np.ndarray:
    """One row of PERMUTATIONS minima (upper 16 bits) per text; a text without words has all bits set."""
    grams, begins = shingles(*word_hashes(*text_bytes(column)), size)
    out = np.full((len(begins) - 1, PERMUTATIONS), np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(np.diff(begins) > 0)
    first = 0
    while first < len(full):
        # rows of one block, or one row that is worked on block by block
        last = max(first + 1, int(np.searchsorted(begins[full], begins[full[first]] + _BLOCK)))
        own = full[first:last]
        for low in range(int(begins[own[0]]), int(begins[own[-1] + 1]), _BLOCK if len(own) == 1 else 1 << 62):
            high = min(low + _BLOCK, int(begins[own[-1] + 1])) if len(own) == 1 else int(begins[own[-1] + 1])
            x, heads = grams[low:high], np.maximum(begins[own] - low, 0)
            y = np.empty_like(x)
            for k in range(PERMUTATIONS):
                np.multiply(x, _SCALE[k], out=y)
                y += _SHIFT[k]
                out[own, k] = np.minimum(out[own, k], np.minimum.reduceat(y, heads))
        first = last
    return (out >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima, an estimate of the Jaccard likeness."""
    return (a == b).mean(1)


def raw_signs(signs: np.ndarray) -> pa.Array:
    """Fingerprints as bytes, two per permutation."""
    return pa.array([x.astype(">u2").tobytes() for x in signs], pa.binary())


def _peeks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of a partition."""
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def _key(doc_id: int | None, mark: int) -> tuple:
    """Sorts descending ids, null last, and then by mark."""
    return (doc_id is None, -(doc_id or 0), mark)


#: Texts are packed row by row before they are exchanged: two thirds of what the exchange's own compression leaves.
_CODEC = pa.Codec("zstd", compression_level=1)


def _packed_texts(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Packed UTF-8 and its size for each text; null is empty."""
    data, offsets = text_bytes(column)
    rows = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return pa.array([_CODEC.compress(x, asbytes=True) if x else b"" for x in rows], pa.binary()), pa.array(np.diff(offsets))


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with ``text`` in place of ``packed`` and ``size``."""
    rows = zip(batch.column("packed"), batch.column("size").to_pylist(), strict=True)
    texts = [_CODEC.decompress(x.as_buffer(), decompressed_size=n, asbytes=True) if n else b"" for x, n in rows]
    names = ["doc_id", "mark", "part", "peek"]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.binary()).cast(pa.string())], [*names, "text"])


def _dealt(bounds: list[tuple]):
    """Rows with the number of their range; the first row of each range goes to the range before it as well."""
    import bisect

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(*x) for x in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), strict=True)]
            part = np.array([max(bisect.bisect_right(bounds, k) - 1, 0) for k in keys], np.int32)
            heads = np.array([k for k, key in enumerate(keys) if key == bounds[part[k]]], np.int64)
            packed, size = _packed_texts(batch.column("text"))
            for rows, parts_, peek in ((np.arange(len(keys)), part, False), (heads, (part[heads] - 1) % len(bounds), True)):
                if len(rows):
                    taken = [x.take(pa.array(rows)) for x in (batch.column("doc_id"), batch.column("mark"), packed, size)]
                    yield pa.RecordBatch.from_arrays([*taken, pa.array(parts_.astype(np.int32)), pa.array([peek] * len(rows))], ["doc_id", "mark", "packed", "size", "part", "peek"])

    return run


def _fingerprinted(size: int):
    def rows(batch: pa.RecordBatch, following: list[str | None]) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        following = [x or "" for x in following]
        halves = [len(t) // 2 for t in texts]
        edited = pa.array([t[: len(t) - h] + f[:h] for t, h, f in zip(texts, halves, following, strict=True)], pa.string())
        own = signatures(pa.array([*texts, following[-1]], pa.string()), size)
        other = signatures(edited, size)
        digests = [hashlib.sha256(x.encode()).digest() for x in edited.to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(digests, pa.binary()),
                raw_signs(own[:-1]),
                raw_signs(other),
                pa.array(likeness(own[:-1], other)),
                pa.array(likeness(own[:-1], own[1:])),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by range and order; the last row of a batch waits for its successor
        wait: pa.RecordBatch | None = None
        for whole in batches:
            for batch in map(_unpacked, parts([whole], "packed", most=PART_BYTES // 2)):
                peek = np.array(batch.column("peek").to_pylist(), bool)
                part = np.array(batch.column("part").to_pylist())
                if wait is not None:
                    batch = pa.Table.from_batches([wait, batch]).combine_chunks().to_batches()[0]
                    peek = np.array(batch.column("peek").to_pylist(), bool)
                    part = np.array(batch.column("part").to_pylist())
                texts = batch.column("text")
                # a row's successor is the row below; of several peeks the first counts
                keep = np.flatnonzero(~peek[:-1])
                if len(keep):
                    assert (part[keep] == part[keep + 1]).all(), "a range ends with the head of the next"
                    yield rows(batch.take(pa.array(keep)), texts.take(pa.array(keep + 1)).to_pylist())
                wait = batch.slice(batch.num_rows - 1, 1)

    return run


def _shown(rows: DataFrame) -> DataFrame:
    """Digests and fingerprints as lowercase hexadecimal text, four digits per permutation; until here they travel as bytes."""
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def fingerprint_documents(docs: DataFrame, size: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    The next document is the one below in descending doc_id (null ids last; equal ids by a hash of the text); after the last
    comes the first. The edited text has its last floor(n / 2) code points replaced by the first as many of the next text, or all of
    it if that is shorter. A null or empty text has no shingles: all bits of its fingerprint are set, and its likeness is 1 to
    another such text and 0 to any other. Repeated rows are kept; a single row is its own successor; an empty table gives an empty result;
    further columns are ignored.

    The texts are shuffled once, by ranges whose first rows were found on the ids alone; each range also receives the first row of
    the next one, so every row meets its successor within a task.
    """
    return _shown(_fingerprints(docs, size))


def _fingerprints(docs: DataFrame, size: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark")]
    heads = docs.select("doc_id", "mark").repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_peeks, "doc_id long, mark long").collect()
    bounds = sorted({_key(r["doc_id"], r["mark"]) for r in heads})
    dealt = docs.mapInArrow(_dealt(bounds), "doc_id long, mark long, packed binary, size long, part int, peek boolean")
    sorted_rows = dealt.repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("part", "peek", *order)
    kind = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    return sorted_rows.mapInArrow(_fingerprinted(size), kind)


def _banded(size: int):
    from tickloom.llm.ngram_join import _sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, most=PART_BYTES):
            signs = signatures(batch.column("text"), size)
            sets = _sets(batch.column("text"), size)
            full = np.flatnonzero(np.array([len(x) > 0 for x in sets], bool) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            bands = np.ascontiguousarray(signs[full][:, : BANDS * BAND_ROWS]).reshape(len(full), BANDS, BAND_ROWS).astype(np.uint64)
            weights = keyed(103, BAND_ROWS) | np.uint64(1)
            keys = (bands * weights).sum(2, dtype=np.uint64) + keyed(104, BANDS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(full)),
                    pa.array([hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest() for k in full], pa.binary()),
                    pa.array([len(sets[k]) for k in full], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64))),
                ],
                ["doc", "key", "n", "bands"],
            )

    return run


def _possible(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``doc_id, text`` whose id is among the ids, and few others: a bitmap of fixed size leaves the rest out before the exchange."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _BITMAP_BITS))
    bits = ids.select((spot + 1).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits")).collect()
    whole = np.zeros((1 << _BITMAP_BITS - 15, 1 << 12), np.uint8)
    for row in bits:
        whole[row["k"] - 1] = np.frombuffer(bytes(row["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(whole.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("spot").to_numpy()
            keep = np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if len(keep):
                yield batch.select(["doc_id", "text"]).take(pa.array(keep))

    return docs.filter("doc_id is not null").select("doc_id", "text", spot.alias("spot")).mapInArrow(run, "doc_id long, text string")


def near_classes(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``node, component`` of every doc_id that a verified link reaches: component is the smallest doc_id reachable.

    Documents with equal shingle sets are one, which keeps lists of copies linear. Every member of a band's list is compared with the list's first, and the
    components that form are contracted. What a list still holds apart, besides its first, are documents that share a frequent passage or whose first
    is no near duplicate; pairs of those grow with the square of the list, so they aren't formed: the documents go through a join on their rarest shingles
    instead, which finds every pair that is alike. So every two band partners that are alike are in one component, and sets are compared whole.
    """
    from tickloom.llm.ngram_join import _checked, _pairs, _texts

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    banded = settle(docs.mapInArrow(_banded(size), "doc long, key binary, n long, bands array<long>"))
    copies = banded.groupBy("key").agg(F.min("doc").alias("stands"), F.count("*").alias("members")).filter("members > 1").select("key", "stands")
    placed = banded.join(copies, "key", "left").withColumn("stands", F.coalesce("stands", "doc"))
    links = settle(placed.filter("stands < doc").select(F.col("stands").alias("a"), F.col("doc").alias("b")).distinct())
    # one row per document and set before the bands are spread
    single = placed.filter("stands = doc").dropDuplicates(["doc", "key"]).select("doc", "n", F.explode("bands").alias("band"))
    entry = F.struct("doc", "n", F.lit(0).alias("place"))
    lists = settle(single.withColumn("least", F.min(entry).over(Window.partitionBy("band"))).withColumn("most", F.max("doc").over(Window.partitionBy("band"))).filter("least.doc < most").drop("most"))
    ids = lists.select(F.col("doc").alias("doc_id")).distinct()
    texts = settle(_texts(_possible(docs, ids), ids, size))
    pairs = settle(_pairs(lists.select(entry.alias("x"), F.col("least").alias("y")).filter("x.doc <> y.doc"), percent))
    links = links.union(settle(_checked(pairs, texts, size, percent)))
    labels = components(links)
    rest = lists.filter("doc <> least.doc").join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    apart = rest.groupBy("band").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter("c < d").select("band")
    left = settle(rest.join(apart, "band", "left_semi").select(F.col("doc").alias("doc_id")).distinct())
    if not left.isEmpty():
        found = _joined_by_rare(texts.join(left.hint("merge"), "doc_id", "left_semi"), texts, labels, size, percent)
        if not found.isEmpty():
            labels = components(found.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    for table in (banded, lists, texts):
        drop_table(table)
    return labels


def _joined_by_rare(docs: DataFrame, texts: DataFrame, labels: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` that join any two of the documents that are alike and not in one component of ``labels``: such have a shingle in common among their rarest.

    While the lists of shingles hold more than ``MOST_PAIRS`` pairs across components for each of their entries, every list compares its members with one of them, drawn anew.
    Then the rest is compared pair by pair; length and place in the lists leave few of them to be verified.
    """
    from tickloom.llm.ngram_join import _checked, _pairs, _prefixes, frequency_sketch

    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, size))
    entries = docs.select("doc_id", "text").mapInArrow(_prefixes(sketch, size, percent), "gram long, doc long, n long, place long")
    several = F.count("*").over(Window.partitionBy("gram"))
    lists = settle(entries.withColumn("members", several).filter("members > 1").drop("members"))
    links, tried = None, None
    for k in range(RARE_ROUNDS + 1):
        named = lists.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        sizes = named.groupBy("gram", "component").agg(F.count("*").alias("m")).groupBy("gram").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm")).filter("m * m > mm")
        apart, held = sizes.agg(F.sum((F.col("m") * F.col("m") - F.col("mm")) / 2), F.sum("m")).first()
        if not apart:
            break
        named = named.join(sizes.select("gram"), "gram", "left_semi")
        member, last = F.struct("doc", "n", "place", "component"), k == RARE_ROUNDS or apart <= MOST_PAIRS * held
        if last:
            others = named.select("gram", member.alias("y"))
            both = named.select("gram", member.alias("x")).join(others, "gram").filter("x.doc < y.doc AND x.component <> y.component")
        else:
            hubs = named.groupBy("gram").agg(F.min_by(member, F.xxhash64("doc", F.lit(k))).alias("y"))
            both = named.select("gram", member.alias("x")).join(hubs, "gram").filter("x.component <> y.component")
        pairs = _pairs(both, percent)
        pairs = settle(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        found = settle(_checked(pairs, texts, size, percent))
        links = found if links is None else links.union(found)
        if last:
            break
        labels = components(found.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    drop_table(lists)
    return links if links is not None else lists.sparkSession.createDataFrame([], "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, class_id`` of each row: the smallest doc_id reachable over verified band partners (``near_classes``), itself included.

    A null id or a text without words links with nothing (class_id is then the doc_id).
    """
    return _classed(docs.select(F.col("doc_id").cast("long")), near_classes(docs, size, percent))


def fingerprints_with_classes(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``fingerprint_documents`` with the ``class_id`` of ``near_duplicates`` as a further column."""
    return _shown(_classed(_fingerprints(docs, size), near_classes(docs, size, percent)))


def _classed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    # the smallest of a class keep their own ids
    moved = labels.filter("component < node").select(F.col("node").alias("doc_id"), F.col("component").alias("class_id"))
    return rows.join(moved, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
