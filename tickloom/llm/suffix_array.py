"""Removal of byte strings that stand in an earlier document, by blockwise suffix sorting with a difference cover.

Every suffix is a candidate at its first ``LENGTH`` bytes. They are sorted bucket by bucket:

1. *Blocks.* Documents are packed into compressed blocks, which are written once; one exchange of them serves both later joins.
2. *Buckets.* The bucket of a suffix is given by its anchor, the smallest hash of a ``GRAM``-byte string inside its first LENGTH
   bytes. Equal strings have equal anchors, neighbouring suffixes mostly share one, and travel as one fragment. Anchors that
   only one document has are filtered out first (four bytes each, a bit each back), so only suffixes that may repeat are sorted.
3. *Sorting.* A task holds the fragments of one bucket, each distinct fragment once. Fragments come in ``SLICES`` slices by anchor, and
   slices are sorted one after the other, small ones together. The suffixes of a slice are sorted one range of leading bytes at a time, on
   their first 32 bytes. Ties longer than that are resolved without looking at text: the positions of a difference cover modulo 31 are
   ranked beforehand, and any two suffixes have an offset below 31 at which both are in the cover. So a task needs memory for its
   fragments, and for the cover ranks and one range of suffixes of a slice. Buckets grow in number with the blocks.
4. *Removal.* The smallest doc_id of each run of equal suffixes goes back to the fragments' blocks, where the covered
   bytes of each document are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words
from tickloom.llm.words import mixed, parts, ranges, span_hashes, text_bytes
from tickloom.session import settle

#: Bytes of a repeated string, and of the string whose hash is its anchor.
LENGTH, GRAM = 50, 20
#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20
#: A perfect difference set: every difference modulo PERIOD is one of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Suffixes that are sorted at once.
RANGE = 1 << 19
#: Blocks for each bucket, at most; slices of a bucket; bytes of distinct fragments up to which slices are sorted together.
BUCKET_BLOCKS, SLICES, SLICE_BYTES = 4, 16, 1 << 19

_NONE = np.iinfo(np.int64).max


def _offsets() -> np.ndarray:
    """For residues r, s: the smallest d such that r + d and s + d are both in the cover."""
    out = np.full((PERIOD, PERIOD), PERIOD, np.int64)
    member = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    r, s, d = np.ogrid[:PERIOD, :PERIOD, :PERIOD]
    both = member[r + d] & member[s + d]
    out[:] = both.argmax(2)
    assert both.any(2).all()
    return out


_SHIFT = _offsets()


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as Python objects, one at a time: a row is a block with what was found for it."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents packed into blocks; the block number is unique over all tasks. ``more`` holds the further columns as an Arrow stream."""
    number = TaskContext.get().partitionId() << 32
    further: list[pa.RecordBatch] = []
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    texts: list[np.ndarray] = []
    held = 0

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, further[0].schema) as stream:
            for x in further:
                stream.write_batch(x)
        row = [[number], [np.concatenate(ids).tobytes()], [np.concatenate(sizes).tobytes()], [_packed(np.concatenate(texts).tobytes())], [_packed(sink.getvalue().to_pybytes())]]
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], ["block", "ids", "sizes", "data", "more"])

    for batch in parts(batches, most=BLOCK_BYTES // 2):
        data, offsets = text_bytes(batch.column("text"))
        if held and held + len(data) > BLOCK_BYTES:
            yield block()
            ids, sizes, texts, further, held, number = [], [], [], [], 0, number + 1
        ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64))
        sizes.append(np.diff(offsets))
        texts.append(data.copy())
        further.append(batch.select([c for c in batch.schema.names if c not in ("doc_id", "text")]))
        held += len(data)
    if ids:
        yield block()


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes at each position."""
    n = max(0, len(data) - GRAM + 1)
    out = np.empty(n, np.uint64)
    for low in range(0, n, words.CHUNK):
        high = min(n, low + words.CHUNK)
        up, down = words._powers(high - low + GRAM)
        sums = np.zeros(high - low + GRAM, np.uint64)
        np.cumsum(words._CASED[data[low : high + GRAM - 1]] * up[:-1], out=sums[1:])
        out[low:high] = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: high - low])
    return out


class _Block:
    """Suffix runs of a block: consecutive suffixes of one document with the same anchor."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(np.frombuffer(row["sizes"], np.int64))))
        self.data = _unpacked(row["data"])
        low = _gram_hashes(self.data)
        size, width = 1, LENGTH - GRAM + 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:]) if len(low) > size else low[:0]
            size *= 2
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :]) if len(low) > width - size else low[:0]
        inside = np.zeros(len(self.data) + 1, np.int32)
        ends = self.offsets[1:]
        long = np.diff(self.offsets) >= LENGTH
        np.add.at(inside, self.offsets[:-1][long], 1)
        np.add.at(inside, ends[long] - LENGTH + 1, -1)
        valid = np.cumsum(inside[: len(low)]) > 0
        step = np.flatnonzero(low[1:] != low[:-1]) + 1
        edge = np.zeros(len(low) + 1, bool)
        edge[0] = True
        edge[step] = True
        edge[1 : len(low)] |= valid[1:] != valid[:-1]
        starts = np.flatnonzero(edge[:-1]) if len(low) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate((starts, [len(low)])))
        keep = valid[starts]
        self.starts, self.counts = starts[keep], counts[keep]
        self.anchors = low[self.starts]
        self.rows = np.searchsorted(self.offsets, self.starts, "right") - 1

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors sorted by bucket and slice, their buckets and slices, and the number of each run's anchor in that order."""
        own, inverse = np.unique(self.anchors, return_inverse=True)
        fine = (mixed(own) % np.uint64(n * SLICES)).astype(np.int64)
        order = np.argsort(fine, kind="stable")
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        return own[order], fine[order] // SLICES, fine[order] % SLICES, rank[inverse]


def _anchor_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            block = _Block(row)
            own, bucket, _, number = block.buckets(n)
            first, last = np.full(len(own), _NONE), np.full(len(own), -1)
            np.minimum.at(first, number, block.rows)
            np.maximum.at(last, number, block.rows)
            heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(own) else np.zeros(0, np.int64)
            tails = np.concatenate((heads[1:], [len(own)])) if len(own) else heads
            cut = own.astype(np.uint32)
            several = first < last
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[heads], pa.int32()),
                    pa.array(np.full(len(heads), row["block"]), pa.int64()),
                    pa.array([cut[a:b].tobytes() for a, b in zip(heads, tails, strict=True)], pa.binary()),
                    pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(heads, tails, strict=True)], pa.binary()),
                ],
                ["bucket", "block", "anchors", "several"],
            )

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """A bit for each anchor of each block of one bucket: whether two documents have it."""
    anchors = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("anchors")]
    several = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(a)).astype(bool) for x, a in zip(table.column("several"), anchors, strict=True)]
    own, inverse, counts = np.unique(np.concatenate(anchors), return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[inverse[np.concatenate(several)]] = True
    bits = shared[inverse]
    ends = np.cumsum([len(a) for a in anchors])
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(bits[e - len(a) : e]).tobytes() for e, a in zip(ends, anchors, strict=True)], pa.binary())})


class _Fragments:
    """The distinct fragments of a block whose anchors are shared, by bucket and slice; ``number`` is the fragment of each kept run."""

    def __init__(self, block: _Block, n: int, replies: list[dict]):
        own, bucket, part, number = block.buckets(n)
        shared = np.zeros(len(own), bool)
        for r in replies:
            low, high = np.searchsorted(bucket, [r["bucket"], r["bucket"] + 1])
            shared[low:high] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=high - low)
        keep = shared[number]
        self.starts, self.counts, self.rows, number = block.starts[keep], block.counts[keep], block.rows[keep], number[keep]
        lengths = self.counts + (LENGTH - 1)
        prints = _fragment_prints(block.data, self.starts, self.starts + lengths)
        # by bucket and slice, then by hash: one fragment for all runs with the same bytes
        order = np.lexsort((prints, number))
        new = np.concatenate(([True], (np.diff(number[order]) != 0) | (prints[order][1:] != prints[order][:-1]))) if len(order) else np.zeros(0, bool)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        heads = order[new]
        self.lengths, self.first, self.bucket, self.slice = lengths[heads], self.starts[heads], bucket[number[heads]], part[number[heads]]
        self.least = np.full(len(heads), _NONE)
        np.minimum.at(self.least, self.number, block.ids[self.rows])


def _fragment_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans that may overlap: every second one, the third ones and so on are disjoint in turn."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + words.CHUNK, "right")))
        low, high = int(starts[k]), int(ends[k:stop].max())
        up, down = words._powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(words._CASED[data[low:high]] * up[:-1], out=sums[1:])
        a, b = starts[k:stop] - low, ends[k:stop] - low
        out[k:stop] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        k = stop
    return out


def _fragment_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            block = _Block(row)
            own = _Fragments(block, n, row["replies"] or [])
            heads = np.flatnonzero(np.concatenate(([True], own.bucket[1:] != own.bucket[:-1]))) if len(own.bucket) else np.zeros(0, np.int64)
            tails = np.concatenate((heads[1:], [len(own.bucket)])) if len(heads) else heads
            rows = []
            for a, b in zip(heads, tails, strict=True):
                data = block.data[ranges(own.first[a:b], own.lengths[a:b])].tobytes()
                slices = np.bincount(own.slice[a:b], minlength=SLICES)
                rows.append((slices.astype(np.int32).tobytes(), own.lengths[a:b].astype(np.int32).tobytes(), own.least[a:b].tobytes(), _packed(data)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.bucket[heads], pa.int32()), pa.array(np.full(len(heads), row["block"]), pa.int64()), *(pa.array([x[k] for x in rows], pa.binary()) for k in range(4))],
                ["bucket", "block", "slices", "lengths", "least", "data"],
            )

    return run


def _words_at(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from ``depth`` on after each position as one big-endian number; ``data`` is padded."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= data[at + (depth + k)].astype(np.uint64)
    return out


def _sorted(data: np.ndarray, at: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the positions by their first ``depth`` bytes, and how many of them each shares with the one before.

    Bytes from ``room`` on (the end of the fragment) count as smaller than any other. Only positions that still tie are read further.
    """
    order = np.arange(len(at))
    common = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    for low in range(0, depth, 8):
        if not len(live):
            break
        who = order[live]
        key = _words_at(data, at[who], low)
        left = np.clip(np.minimum(room[who], depth) - low, 0, 8)
        mask = np.where(left < 8, (np.uint64(1) << (np.uint64(64) - np.uint64(8) * left.astype(np.uint64)) % np.uint64(64)) - np.uint64(1), np.uint64(0))
        mask[left == 0] = np.iinfo(np.uint64).max
        key &= ~mask
        rank = np.lexsort((left, key, group))
        order[live] = who[rank]
        key, left, group = key[rank], left[rank], group[rank]
        same_group = np.concatenate(([False], group[1:] == group[:-1]))
        differ = np.zeros(len(key), np.uint64)
        differ[1:] = key[1:] ^ key[:-1]
        # equal leading bytes of the two words, at most as many as both have
        lead = np.full(len(key), 8)
        for k in range(8):
            lead = np.minimum(lead, np.where((differ >> np.uint64(56 - 8 * k)) & np.uint64(255), k, 8))
        lead[1:] = np.minimum(lead[1:], np.minimum(left[1:], left[:-1]))
        common[live[same_group]] += lead[same_group]
        tie = same_group & (lead == 8)
        group = np.cumsum(~tie)
        joined = tie.copy()
        joined[:-1] |= tie[1:]
        live, group = live[joined], group[joined]
    return order, common


def _classes(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes with LENGTH bytes left in their fragment, and a class number each, equal for equal strings of LENGTH bytes."""
    n = len(data)
    data = np.concatenate((data, np.zeros(LENGTH + 16, np.uint8)))
    ends = np.cumsum(lengths)
    room = np.repeat(ends, lengths) - np.arange(n)
    starts = np.flatnonzero(room >= LENGTH)
    # ranks of the cover positions by up to LENGTH bytes, and what neighbours in that order share
    cover = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[np.arange(n) % PERIOD] & (room > LENGTH - PERIOD - 1))
    order, common = _sorted(data, cover, room[cover], LENGTH)
    rank = np.zeros(n, np.int32)
    rank[cover[order]] = np.arange(len(cover))
    # names[d][r]: equal for cover ranks that share LENGTH - d bytes
    out = np.empty(len(starts), np.int64)
    lead = (data[starts].astype(np.int64) << 8) | data[starts + 1]
    by_lead = np.argsort(lead, kind="stable")
    bounds = np.flatnonzero(np.diff(lead[by_lead], prepend=-1))
    low, used = 0, 0
    cuts = [0]
    for b in [*bounds[1:], len(starts)]:
        if b - low > RANGE:
            cuts.append(int(b))
            low = b
    cuts = sorted({*cuts, len(starts)})
    names: dict[int, np.ndarray] = {}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = by_lead[a:b]
        at = starts[own]
        order, common_32 = _sorted(data, at, room[at], 32)
        at = at[order]
        klass = _resolved(at, np.cumsum(common_32 < 32) - 1, rank, common, names)
        out[own[order]] = klass + used
        used += int(klass.max()) + 1
    return starts, out


def _resolved(at: np.ndarray, group: np.ndarray, rank: np.ndarray, common: np.ndarray, names: dict[int, np.ndarray]) -> np.ndarray:
    """Class numbers of sorted suffixes of which those in one group tie on 32 bytes: groups are split by cover ranks alone.

    All open groups are split at once around a member each; those equal to it are done, the smaller and the larger ones go on.
    """
    out = np.full(len(at), -1, np.int64)
    live, used = np.arange(len(at)), 0
    while len(live):
        heads = np.flatnonzero(np.diff(group[live], prepend=-1))
        sizes = np.diff(np.concatenate((heads, [len(live)])))
        pivot = np.repeat(live[heads + sizes // 2], sizes)
        shift = _SHIFT[at[live] % PERIOD, at[pivot] % PERIOD]
        a, b = rank[at[live] + shift], rank[at[pivot] + shift]
        compared = np.sign(a - b).astype(np.int64)
        far = compared != 0
        for d in np.unique(shift[far]).tolist():
            if d not in names:
                names[d] = np.cumsum(common < LENGTH - d).astype(np.int32)
            here = far & (shift == d)
            compared[here] *= names[d][a[here]] != names[d][b[here]]
        equal = compared == 0
        number = np.repeat(np.arange(len(heads)), sizes)
        out[live[equal]] = used + number[equal]
        used += len(heads)
        rest = ~equal
        key = number[rest] * 2 + (compared[rest] > 0)
        order = np.argsort(key, kind="stable")
        live, new = live[rest][order], key[order]
        if len(live):
            group[live] = np.cumsum(np.diff(new, prepend=-1) != 0)
    return out


def _least_docs(table: pa.Table) -> pa.Table:
    """For every fragment of every block of one bucket: the smallest doc_id that has each of its suffixes, run-length coded.

    Fragments that share a suffix share its anchor and so a slice; only the fragments of some slices, ``SLICE_BYTES`` or a slice, are sorted at once.
    """
    lengths = [np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in table.column("lengths")]
    least = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("least")])
    data = np.concatenate([_unpacked(x.as_py()) for x in table.column("data")])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in table.column("slices")])
    part = np.repeat(np.arange(len(counts)) % SLICES, counts)
    every = np.concatenate(lengths)
    ends = np.cumsum(every)
    prints = span_hashes(data, ends - every, ends, cased=True)
    _, first, inverse = np.unique(prints, return_index=True, return_inverse=True)
    by_slice = np.argsort(part[first], kind="stable")
    place = np.empty(len(first), np.int64)
    place[by_slice] = np.arange(len(first))
    first, inverse = first[by_slice], place[inverse]
    lowest = np.full(len(first), _NONE)
    np.minimum.at(lowest, inverse, least)
    own, begin = every[first], (ends - every)[first]
    docs, runs, begins = [], [], [np.zeros(1, np.int64)]
    for a, b in _together(part[first], own):
        values, sizes, numbers = _runs(data[ranges(begin[a:b], own[a:b])], own[a:b], lowest[a:b])
        docs.append(values)
        runs.append(sizes)
        begins.append(begins[-1][-1] + numbers)
    docs, runs, begins = np.concatenate(docs), np.concatenate(runs), np.concatenate(begins)
    values, lasts = [], []
    at = 0
    for x in lengths:
        which = inverse[at : at + len(x)]
        at += len(x)
        k = ranges(begins[which], begins[which + 1] - begins[which])
        values.append(docs[k].tobytes())
        lasts.append(runs[k].tobytes())
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "docs": pa.array(values, pa.binary()), "runs": pa.array(lasts, pa.binary())})


def _together(part: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of whole slices, of up to ``SLICE_BYTES`` bytes or one slice, for fragments in the order of their slices."""
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    sizes = np.add.reduceat(lengths, heads)
    cuts, held = [], 0
    for head, size in zip(heads.tolist(), sizes.tolist(), strict=True):
        if not cuts or held + size > SLICE_BYTES:
            cuts.append(head)
            held = 0
        held += size
    return list(zip(cuts, [*cuts[1:], len(part)], strict=True))


def _runs(text: np.ndarray, lengths: np.ndarray, lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest doc_id of the suffixes of each fragment as values with their numbers of suffixes, and at how many of them each fragment ends."""
    starts, klass = _classes(text, lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths - (LENGTH - 1))
    smallest = np.full(int(klass.max()) + 1, _NONE)
    np.minimum.at(smallest, klass, lowest[owner])
    found = smallest[klass]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(found) != 0) | (np.diff(owner) != 0))))
    sizes = np.diff(np.concatenate((new, [len(found)])))
    return found[new], sizes.astype(np.int32), np.searchsorted(owner[new], np.arange(1, len(lengths) + 1))


def _covered(block: _Block, own: _Fragments, found: list[dict]) -> np.ndarray:
    """Which bytes of the block are removed."""
    found = sorted(found, key=lambda r: r["bucket"])
    docs = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["docs"], np.int64) for r in found)])
    runs = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r["runs"], np.int32) for r in found)])
    smallest = np.repeat(docs, runs)
    counts = own.lengths - (LENGTH - 1)
    begins = np.cumsum(counts) - counts
    assert len(smallest) == counts.sum(), "every fragment was answered"
    here = ranges(begins[own.number], own.counts)
    at = ranges(own.starts, own.counts)[smallest[here] < np.repeat(block.ids[own.rows], own.counts)]
    step = np.zeros(len(block.data) + 1, np.int32)
    step[at] += 1
    step[at + LENGTH] -= 1
    return np.cumsum(step[:-1]) > 0


def _reports(n: int, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            block = _Block(row)
            gone = _covered(block, _Fragments(block, n, row["replies"] or []), row["found"] or [])
            removed = np.concatenate(([0], np.cumsum(gone)))
            a, b = block.offsets[:-1], block.offsets[1:]
            first = gone & np.concatenate(([True], ~gone[:-1])) if len(gone) else gone
            heads = a[b > a]
            first[heads] = gone[heads]
            spans = np.concatenate(([0], np.cumsum(first)))
            kept = [block.data[x:y][~gone[x:y]].tobytes() for x, y in zip(a, b, strict=True)]
            columns = {
                "doc_id": pa.array(block.ids),
                "n_bytes": pa.array(b - a),
                "n_removed": pa.array(removed[b] - removed[a]),
                "n_spans": pa.array(spans[b] - spans[a]),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            }
            if keep:
                more = pa.ipc.open_stream(_unpacked(row["more"]).tobytes()).read_all()
                columns |= {c: pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if c == "text" else more.column(c).combine_chunks() for c in keep}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``doc_id, text``, and the columns named in ``keep``.

    A byte is removed if a string of LENGTH bytes around it also starts in a document with a smaller doc_id. Strings don't cross documents
    and are judged on the input. n_spans counts the maximal removed runs; kept_sha256 is the hash of the remaining bytes. A kept ``text`` is what
    remains, without bytes of code points that a cut went through.

    A null text is empty; texts under LENGTH bytes lose nothing; rows that share a doc_id don't remove from each other; a row with a null doc_id
    loses nothing and removes nothing; an empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    further = [c for c in keep if c not in ("doc_id", "text")]
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *further)
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = settle(docs.filter("doc_id IS NOT NULL").mapInArrow(_blocks, "block long, ids binary, sizes binary, data binary, more binary"))
    n = max(2 * dealt, -(-blocks.count() // BUCKET_BLOCKS))
    shared = settle(
        blocks.drop("more").mapInArrow(_anchor_rows(n), "bucket int, block long, anchors binary, several binary")
        .groupBy("bucket")
        .applyInArrow(_shared_anchors, "block long, bucket int, bits binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "bits")).alias("replies"))
    )
    # with all columns, so that the exchange of this join is that of the last one too
    replied = blocks.join(shared, "block", "left")
    found = (
        replied.mapInArrow(_fragment_rows(n), "bucket int, block long, slices binary, lengths binary, least binary, data binary")
        .groupBy("bucket")
        .applyInArrow(_least_docs, "block long, bucket int, docs binary, runs binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "docs", "runs")).alias("found"))
    )
    report = ["doc_id long", "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"]
    kept = [f"`{c}` {kinds[c]}" for c in keep if c != "doc_id"]
    out = replied.join(found, "block", "left").mapInArrow(_reports(n, tuple(c for c in keep if c != "doc_id")), ", ".join([*report, *kept]))
    none = F.lit(0).cast("long")
    lone = docs.filter("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *(c for c in keep if c != "doc_id"))
    return out.union(lone)
