"""Packing of documents into token sequences by lexical retrieval.

1. *Tokens.* Texts are cut into units that the tokenizer treats on their own; each distinct unit is merged once, all at once. Units with rare
   characters go to the tokenizer library itself.
2. *Statistics.* How many documents have each token, over all documents: one counter per vocabulary entry.
3. *Shards.* Documents are range-sorted by their rarest shared token, so lexically close ones stand together, and cut into shards of about
   ``SHARD_TOKENS`` tokens; equal keys are told apart by id, so a large group of copies is spread over many shards.
4. *Retrieval.* Each shard has a BM25 inverted index. An unused document seeds a window; its highest-scored unused neighbours fill it, the last
   one is cut where the window ends. What is left at the end of a shard goes to the next one; at the end of a partition it is written in
   sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bpe import MergeTable, merged
from tickloom.llm.words import binaries, parts, ranges, span_hashes, text_bytes
from tickloom.session import settle

WINDOW = 4096
END_ID = 2
#: Tokens of a shard, and terms of a seed that are looked up at once.
SHARD_TOKENS = 1 << 20
QUERY_TERMS = 12
#: BM25 saturation and length normalisation.
K1, B = 1.2, 0.75
PART_BYTES = 4 << 20
#: Units whose ids a worker keeps from batch to batch, and the most ids of one.
KNOWN_UNITS, KNOWN_IDS = 1 << 18, 32

_LETTER, _DIGIT, _OTHER = 1, 2, 3


@cache
def _tables(path: str) -> tuple:
    """Merge table, symbols of the 256 bytes inside and at the end of a word, and the library's tokenizer."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    # printable bytes stand for themselves, the others for code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    names |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in names)}
    inside = np.array([vocab[names[b]] for b in range(256)], np.int64)
    last = np.array([vocab[names[b] + "</w>"] for b in range(256)], np.int64)
    rows = []
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        rows.append((vocab[left], vocab[right], rank, vocab[left + right]))
    return MergeTable.of(rows), inside, last, Tokenizer.from_file(path)


#: ASCII classes of the pre-tokenizer; 0 is white space.
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = _LETTER


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the units, and which of them the library has to encode.

    Runs of ASCII and Latin-1 letters, single digits and runs of other signs are units. A stretch between white space that holds anything else,
    or an apostrophe, is one unit for the library.
    """
    kind = _CLASS[data]
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    lead = data == 0xC3
    odd = (data >= 0x80) & ~lead & ~(after_c3 & (data < 0xC0)) | after_c3 & ((data == 0x97) | (data == 0xB7)) | (data < 0x20) & (kind != 0) | (data == 0x7F) | (data == 0x27)
    lower = data.copy()
    capital = (data >= 0x41) & (data <= 0x5A) | after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    lower[capital] += 0x20
    begin = np.zeros(len(data), bool)
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    space = kind == 0
    chunk = ~space & begin
    chunk[1:] |= ~space[1:] & space[:-1]
    number = np.cumsum(chunk)
    strange = np.zeros(int(number[-1]) + 1 if len(number) else 1, bool)
    strange[number[odd]] = True
    # "<|" may begin one of the tokenizer's own marks
    bar = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    strange[number[bar]] = True
    first = chunk.copy()
    first[1:] |= ~space[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & ~strange[number[1:]]
    first &= ~space
    starts = np.flatnonzero(first)
    stop = space.copy()
    stop |= first
    # the end of a unit is the next start or blank
    marks = np.concatenate((np.flatnonzero(stop | begin), [len(data)]))
    ends = marks[np.searchsorted(marks, starts, "right")]
    return lower, starts, ends, strange[number[starts]]


class _Spelled:
    """Ids of units that this worker has met, by their hash, so that a word is not merged again in every batch: up to ``KNOWN_UNITS`` of at most ``KNOWN_IDS`` ids."""

    def __init__(self):
        self.prints = np.zeros(0, np.uint64)
        self.begins, self.counts, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def find(self, prints: np.ndarray) -> np.ndarray:
        """Number of each unit, -1 for those not met yet."""
        if not len(self.prints):
            return np.full(len(prints), -1)
        at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        return np.where(self.prints[at] == prints, at, -1)

    def add(self, prints: np.ndarray, begins: np.ndarray, counts: np.ndarray, pool: np.ndarray) -> None:
        """Keep new units with ids ``pool[begins[k]:begins[k] + counts[k]]``; when there is no room, the older ones are forgotten."""
        own = np.flatnonzero(counts <= KNOWN_IDS)[:KNOWN_UNITS]
        if len(self.prints) + len(own) > KNOWN_UNITS:
            self.__init__()
        sizes = counts[own]
        prints, starts = np.concatenate((self.prints, prints[own])), np.concatenate((self.begins, len(self.ids) + np.cumsum(sizes) - sizes))
        order = np.argsort(prints)
        self.prints, self.begins, self.counts = prints[order], starts[order], np.concatenate((self.counts, sizes))[order]
        self.ids = np.concatenate((self.ids, pool[ranges(begins[own], sizes)]))


_spelled: dict[str, _Spelled] = {}


def tokenize(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, as the tokenizer file gives them without special tokens, and the n + 1 numbers at which rows begin."""
    table, inside, last, library = _tables(path)
    data, offsets = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    lower, starts, ends, strange = _units(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    prints = span_hashes(lower, starts, ends, cased=True)
    prints[strange] = span_hashes(data, starts[strange], ends[strange], cased=True) ^ np.uint64(1)
    coded = pa.array(prints).dictionary_encode()
    prints, inverse = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    # codes are given in the order of first places
    first = np.flatnonzero(np.diff(np.maximum.accumulate(inverse), prepend=-1))
    known = _spelled.setdefault(path, _Spelled())
    at = known.find(prints)
    plain = np.flatnonzero((at < 0) & ~strange[first])
    hard = np.flatnonzero((at < 0) & strange[first])
    sizes = (ends - starts)[first]
    place = ranges(starts[first][plain], sizes[plain])
    symbols = inside[lower[place]]
    begins = np.concatenate(([0], np.cumsum(sizes[plain])))
    symbols[begins[1:] - 1] = last[lower[place[begins[1:] - 1]]] if len(plain) else symbols[:0]
    ids, begins = merged(symbols, begins, table)
    texts = [data[starts[first[k]] : ends[first[k]]].tobytes().decode() for k in hard]
    spelled = [np.array(x.ids, np.int64) for x in library.encode_batch(texts, add_special_tokens=False)] if texts else []
    counts = np.zeros(len(first), np.int64)
    counts[plain], counts[hard] = np.diff(begins), [len(x) for x in spelled]
    pool = np.concatenate([known.ids, ids, *spelled])
    where = np.zeros(len(first), np.int64)
    where[plain] = len(known.ids) + begins[:-1]
    where[hard] = len(known.ids) + len(ids) + np.concatenate(([0], np.cumsum(counts[hard])))[:-1] if len(hard) else 0
    old = np.flatnonzero(at >= 0)
    where[old], counts[old] = known.begins[at[old]], known.counts[at[old]]
    out = pool[ranges(where[inverse], counts[inverse])]
    new = np.concatenate((plain, hard))
    known.add(prints[new], where[new], counts[new], pool)
    sums = np.concatenate(([0], np.cumsum(counts[inverse])))
    return out, sums[np.searchsorted(starts, offsets)]


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, most=PART_BYTES):
            ids, begins = tokenize(path, batch.column("text"))
            rows = len(begins) - 1
            # the end id after each document
            full = np.insert(ids, begins[1:], END_ID)
            begins = begins + np.arange(rows + 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), binaries(full.astype("<u2"), begins)], ["doc_id", "mark", "ids"])

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(size, np.int64)
        docs = total = 0
        for batch in parts(batches, "ids"):
            data, offsets = text_bytes(batch.column("ids"))
            ids, begins = data.view("<u2").astype(np.int64), offsets // 2
            for low in range(0, batch.num_rows, 64):
                high = min(low + 64, batch.num_rows)
                seen = np.zeros((high - low, size), bool)
                seen[np.repeat(np.arange(high - low), np.diff(begins[low : high + 1])), ids[begins[low] : begins[high]]] = True
                have += seen.sum(0)
            docs, total = docs + batch.num_rows, total + len(ids)
        found = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((found, [-1, -2]))), pa.array(np.concatenate((have[found], [docs, total])))], ["id", "n"])

    return run


def token_statistics(tokens: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Documents that have each token id, all documents, all tokens; no more numbers than the vocabulary has entries."""
    counts = {r["id"]: r["n"] for r in tokens.select("ids").mapInArrow(_frequencies(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    have = np.zeros(size, np.int64)
    for k, n in counts.items():
        if k >= 0:
            have[k] = n
    return have, counts.get(-1, 0), counts.get(-2, 0)


def _keyed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value[0]
        # the rarest token that another document has, too
        order = np.where(have > 1, have << 16 | np.arange(len(have)), np.int64(1) << 62)
        for batch in parts(batches, "ids"):
            data, offsets = text_bytes(batch.column("ids"))
            key = np.minimum.reduceat(order[data.view("<u2").astype(np.int64)], offsets[:-1] // 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], ["doc_id", "mark", "ids", "near"])

    return run


class _Shard:
    """Documents of a shard (id, tokens, first unused token) and a BM25 index over them."""

    def __init__(self, docs: list[list], have: np.ndarray, n_docs: int, mean: float):
        self.docs = docs
        self.left = np.array([len(ids) - start for _, ids, start in docs])
        rest = [ids[start:].astype(np.int64) for _, ids, start in docs]
        size = len(have)
        key, tf = np.unique(np.concatenate(rest) + np.repeat(np.arange(len(rest)) * size, self.left), return_counts=True)
        doc, term = key // size, key % size
        idf = np.log1p((n_docs - have[term] + 0.5) / (have[term] + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.left[doc] / mean))
        self.begins = np.searchsorted(doc, np.arange(len(docs) + 1))
        self.term, self.idf = term, idf
        order = np.argsort(term, kind="stable")
        self.posting_doc, self.posting_weight = doc[order], weight[order]
        self.terms = np.unique(term)
        self.at = np.searchsorted(term[order], np.concatenate((self.terms, [size])))
        self.shared = np.diff(self.at)[np.searchsorted(self.terms, term)] > 1

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents by falling score for the seed's terms of highest IDF, ties by their order; then those for its next terms, as far as they are asked for.

        Terms that no other document of the shard has are left out.
        """
        low, high = self.begins[seed], self.begins[seed + 1]
        terms, idf = self.term[low:high][self.shared[low:high]], self.idf[low:high][self.shared[low:high]]
        terms = terms[np.argsort(-idf, kind="stable")]
        for first in range(0, len(terms), QUERY_TERMS):
            scores = np.zeros(len(self.docs))
            for k in np.searchsorted(self.terms, terms[first : first + QUERY_TERMS]).tolist():
                own = slice(self.at[k], self.at[k + 1])
                scores[self.posting_doc[own]] += self.posting_weight[own]
            scores[self.left == 0] = 0
            found = np.flatnonzero(scores > 0)
            yield from found[np.argsort(-scores[found], kind="stable")].tolist()


def _filled(shard: _Shard, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Full windows of (document, start, length); stops when what is left doesn't fill one."""
    unused = int(shard.left.sum())
    seed = 0
    while unused >= window:
        while not shard.left[seed]:
            seed += 1
        pieces, room = [], window

        def take(k: int) -> None:
            nonlocal room
            doc, ids, start = shard.docs[k]
            n = min(room, int(shard.left[k]))
            pieces.append((k, start, n))
            shard.docs[k][2] += n
            shard.left[k] -= n
            room -= n

        take(seed)
        if room:
            for k in shard.neighbours(seed):
                if not room:
                    break
                if shard.left[k]:
                    take(k)
        nearest = seed
        while room:  # nothing else in the shard shares a term of the seed
            while not shard.left[nearest]:
                nearest += 1
            take(nearest)
        unused -= window
        yield pieces


def _packed(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n_docs, total = shared.value
        sequence = TaskContext.get().partitionId() << 40
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def rows(docs: list[list], sequences: Iterator[list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out = []
            for pieces in sequences:
                offset = 0
                for k, start, n in pieces:
                    doc, ids, _ = docs[k]
                    out.append((doc, start, n, zlib.crc32(ids[start : start + n].astype("<u4")), len(ids), sequence, offset))
                    offset += n
                sequence += 1
                if len(out) > 5000:
                    yield table(out)
                    out = []
            yield table(out)

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(7)], names)

        def shard(docs: list[list]) -> Iterator[pa.RecordBatch]:
            own = _Shard(docs, have, n_docs, total / max(1, n_docs))
            yield from rows(docs, _filled(own, window))

        pool: list[list] = []
        held = 0
        for batch in parts(batches, "ids"):
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(data.as_py(), "<u2")
                pool.append([doc, ids, 0])
                held += len(ids)
                if held >= SHARD_TOKENS:
                    yield from shard(pool)
                    pool = [x for x in pool if x[2] < len(x[1])]
                    held = sum(len(x[1]) - x[2] for x in pool)
        if pool:
            yield from shard(pool)
            pool = [x for x in pool if x[2] < len(x[1])]
            yield from rows(pool, _powers(pool, window))

    return run


def _powers(pool: list[list], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """The rest, less than a window, in sequences of falling powers of two."""
    left = sum(len(ids) - start for _, ids, start in pool)
    k = 0
    for size in (1 << e for e in range(window.bit_length() - 1, -1, -1)):
        while left >= size:
            pieces, room = [], size
            while room:
                _, ids, start = pool[k]
                n = min(room, len(ids) - start)
                if n:
                    pieces.append((k, start, n))
                    pool[k][2] += n
                    room -= n
                else:
                    k += 1
            left -= size
            yield pieces


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``; no sequence needs padding.

    A document is its token ids and END_ID, so a null or empty text is that id alone. Each token lies in exactly one piece. Sequences have
    ``window`` tokens, the last ones of a partition a power of two. Repeated rows are packed as often as they occur; a null id is kept; an
    empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    size = max(json.load(open(tokenizer_path, encoding="utf-8"))["model"]["vocab"].values()) + 3
    if size > 1 << 16:
        raise ValueError("token ids are held in two bytes")
    kind = "doc_id long, mark long, ids binary"
    tokens = settle(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).mapInArrow(_tokenized(tokenizer_path), kind))
    shared = spark.sparkContext.broadcast(token_statistics(tokens, size))
    parts_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["near", "doc_id", "mark"]
    dealt = tokens.mapInArrow(_keyed(shared), kind + ", near long").repartitionByRange(parts_, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_packed(shared, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
