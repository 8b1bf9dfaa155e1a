"""Byte-level BPE encoding by batched merge rounds, and decoding.

A text is cut into pieces (a blank and a run of letters, of digits, of other signs, and so on); every distinct piece of a stretch of text is merged
once. The symbols of all pieces lie in one flat array. In a round every piece applies its pair of lowest rank, at all its places at once; the
ranks of pairs are found by binary search over the sorted pair keys of the vocabulary.

A long piece is cut into blocks of twice the longest token. A block may apply its lowest pair when neither neighbour of the same piece has a
lower one: a merge that could touch the pair's symbols first would lie inside one token around them, hence in these three blocks. So a piece of
a million bytes takes few rounds more than a short one, and there is one path for all lengths.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.words import parts, ranges, span_hashes, text_bytes

#: Bytes of text worked on at once; longer texts are cut between two pieces.
STRETCH = 2 << 20
_LETTER, _DIGIT, _SIGN, _SPACE, _NEW = 0, 1, 2, 3, 4
_NEVER = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind: visible Latin-1 as itself, the rest from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """Sorted pair keys ``left << 32 | right`` with rank and product, symbols of single bytes, and the bytes of every id."""

    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    byte_ids: np.ndarray
    id_bytes: list[bytes]
    specials: dict[bytes, int]
    block: int
    cutter: object
    classes: np.ndarray = field(default_factory=lambda: np.full(0x110000, _NEW, np.uint8))

    def __post_init__(self) -> None:
        sizes = np.array([len(x) for x in self.id_bytes], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        self.flat = np.frombuffer(b"".join(self.id_bytes), np.uint8)
        digits = [b"%d," % k for k in range(len(self.id_bytes))]
        self.digit_begins = np.concatenate(([0], np.cumsum([len(x) for x in digits])))
        self.digits = np.frombuffer(b"".join(digits), np.uint8)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (never, if it isn't one) and its number among the keys."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER), at

    def class_of(self, points: np.ndarray) -> np.ndarray:
        """Whether code points are letters, digits, white space or other signs; new ones are looked up in the library's own cutter."""
        out = self.classes[points]
        if (out == _NEW).any():
            for c in np.unique(points[out == _NEW]).tolist():
                joined = [len(self.cutter.pre_tokenize_str(x + chr(c))) == 1 for x in ("a", "1", "!")]
                self.classes[c] = joined.index(True) if any(joined) else _SPACE
            out = self.classes[points]
        return out


@cache
def load_vocabulary(path: str) -> Vocabulary:
    """Read a vocabulary file of a byte-level BPE tokenizer; its cutter is used as the judge of letters, digits and white space.

    ValueError if the file asks for something else: a normalizer, a blank in front, continuing prefixes, special tokens that take blanks with
    them, or merges that use a token before it can have been made.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut["use_regex"] and spec["normalizer"] is None and model["type"] == "BPE"
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
    if not plain or any(odd) or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("not a plain byte-level BPE vocabulary")
    letters, ids = _byte_letters(), model["vocab"]
    rows, made = [], set()
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        if a + b in made or any(len(x) > 1 and x not in made for x in (a, b)):
            raise ValueError("merges aren't in the order in which tokens are made")
        made.add(a + b)
        rows.append((ids[a] << 32 | ids[b], rank, ids[a + b]))
    rows = np.array(sorted(rows), np.int64)
    id_bytes = [b""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
    for token, k in ids.items():
        id_bytes[k] = bytes(letters[c] for c in token)
    longest = max(map(len, id_bytes))
    byte_ids = np.zeros(256, np.int64)
    for c, b in letters.items():
        byte_ids[b] = ids[c]
    specials = {}
    for t in spec["added_tokens"]:
        specials[t["content"].encode()] = t["id"]
        id_bytes[t["id"]] = t["content"].encode()
    columns = (np.ascontiguousarray(rows[:, k]) for k in range(3))
    return Vocabulary(*columns, byte_ids, id_bytes, specials, 2 * longest, Tokenizer.from_file(path).pre_tokenizer)


def piece_starts(vocabulary: Vocabulary, data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Byte positions at which the pieces of valid UTF-8 begin; no piece crosses the positions ``heads``, which begin texts.

    Runs of one class are pieces; a blank in front of a run belongs to it; other white space in front of a run is a piece without its last sign,
    which is then a piece of its own; and an apostrophe with s, t, m, d, re, ve or ll behind it is one.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int32)
    a = padded[at]
    if (data < 0x80).all():
        points = a
    else:
        b, c, d = (padded[at + k] & 0x3F for k in (1, 2, 3))
        points = np.where(a >= 0xF0, (a & 7) << 18 | b << 12 | c << 6 | d, np.where(a >= 0xE0, (a & 15) << 12 | b << 6 | c, np.where(a >= 0xC0, (a & 31) << 6 | b, a)))
    n = len(points)
    kind = vocabulary.class_of(points)
    text = np.zeros(n + 1, bool)
    text[np.searchsorted(at, heads[heads < len(data)])] = True
    text[n] = True
    start = text.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # the last sign of white space in front of something else is split off, and joins what follows if it is a blank
    white = kind == _SPACE
    last = np.flatnonzero(white & start[1:] & ~text[1:])
    start[last] = True
    joined = last[points[last] == 32] + 1
    start[joined] = False
    # apostrophes: alone in their run, at the start of a piece, and letters behind
    quote = np.flatnonzero((points == 39) & start[:n] & start[1:] & ~text[1:])
    quote = quote[kind[quote + 1] == _LETTER]
    if len(quote):
        follow = np.concatenate((points, [0, 0]))
        end_of_run = np.append(np.flatnonzero(start), n)
        room = end_of_run[np.searchsorted(end_of_run, quote + 1, "right")] - quote - 1
        one, two = follow[quote + 1], follow[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (room >= 2) & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        for hit, size in ((short, 1), (long, 2)):
            start[quote[hit] + 1] = False
            # a further piece of the letters that are left
            behind = quote[hit] + 1 + size
            start[behind[room[hit] > size]] = True
    return at[np.flatnonzero(start[:n])]


def merge_rounds(vocabulary: Vocabulary, symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words after all merges, and the n + 1 symbol numbers at which words begin; ``symbols`` are those of single bytes."""
    word = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    inside = np.arange(len(symbols)) - begins[word]
    # blocks are numbered through; one word's blocks are neighbours
    blocks = -(-np.diff(begins) // vocabulary.block)
    block = (np.cumsum(blocks) - blocks)[word] + inside // vocabulary.block
    owner = np.repeat(np.arange(len(blocks)), blocks)
    beside = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)
    lowest = np.full(len(owner), _NEVER)
    place, sym = np.arange(len(symbols)), symbols.astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []

    def ranked(at: np.ndarray) -> np.ndarray:
        right = np.minimum(at + 1, len(sym) - 1)
        rank, _ = vocabulary.rank_of(sym[at], sym[right])
        rank[(word[at] != word[right]) | (right == at)] = _NEVER
        return rank

    rank = ranked(np.arange(len(sym))) if len(sym) else np.zeros(0, np.int64)
    while len(sym):
        heads = np.flatnonzero(np.diff(block, prepend=-1))
        lowest[:] = _NEVER
        lowest[block[heads]] = np.minimum.reduceat(rank, heads)
        # words without a pair left are finished
        alive = np.zeros(len(begins) - 1, bool)
        alive[owner[lowest != _NEVER]] = True
        still = alive[word]
        if not still.all():
            done.append((place[~still], sym[~still]))
            place, sym, word, block, rank = (x[still] for x in (place, sym, word, block, rank))
            if not len(sym):
                break
        # runs of blocks with equal lowest pair go together, if no neighbour of the run is lower
        same = beside & (np.append(lowest[1:], 0) == lowest)
        first = np.append(True, ~same[:-1])
        run = np.cumsum(first) - 1
        lower_left = np.append(False, beside[:-1] & (lowest[:-1] < lowest[1:]))
        lower_right = beside & (np.append(lowest[1:], _NEVER) < lowest)
        held = np.zeros(run[-1] + 1, bool)
        held[run[(lower_left & first) | (lower_right & ~same)]] = True
        going = ~held[run] & (lowest != _NEVER)
        at = np.flatnonzero((rank == lowest[block]) & going[block])
        # in an overlapping run of one pair every second place counts, from the left
        head = np.append(True, (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]]))
        at = at[(np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]) % 2 == 0]
        _, number = vocabulary.rank_of(sym[at], sym[at + 1])
        sym[at] = vocabulary.made[number]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place, sym, word, block, rank = (x[keep] for x in (place, sym, word, block, rank))
        at = at - np.arange(len(at))
        touched = np.union1d(at, np.maximum(at - 1, 0))
        rank[touched] = ranked(touched)
    if done:
        place, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        place, sym = place[order], sym[order]
    return sym, np.searchsorted(place, begins)


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first of each set of equal spans, and for each span the number of its set. Equality is checked byte by byte."""
    _, first, inverse = np.unique(span_hashes(data, starts, ends, cased=True), return_index=True, return_inverse=True)
    sizes, model = ends - starts, first[inverse]
    fits = sizes == sizes[model]
    like = np.flatnonzero(fits)
    differs = data[ranges(starts[like], sizes[like])] != data[ranges(starts[model[like]], sizes[like])]
    if differs.any():
        fits[like[np.unique(np.repeat(np.arange(len(like)), sizes[like])[differs])]] = False
    odd = np.flatnonzero(~fits)
    inverse = inverse.copy()
    inverse[odd] = len(first) + np.arange(len(odd))
    return np.concatenate((first, odd)), inverse


def encode(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, which lie end to end in ``data``, and the n + 1 numbers at which rows begin."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cuts, fixed = offsets, {}
    raw = data.tobytes()
    for token, k in vocabulary.specials.items():
        at = raw.find(token)
        while at >= 0:
            # a token that crosses two texts isn't one
            if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(token) - 1, "right"):
                fixed[at] = (len(token), k)
                at = raw.find(token, at + len(token))
            else:
                at = raw.find(token, at + 1)
    if fixed:
        spans = np.array(sorted((a, a + n) for a, (n, _) in fixed.items()))
        cuts = np.union1d(offsets, spans.ravel())
    starts = piece_starts(vocabulary, data, cuts)
    if fixed:
        inner = np.searchsorted(spans[:, 0], starts, "right") - 1
        starts = starts[(inner < 0) | (starts >= spans[inner, 1]) | (starts == spans[inner, 0])]
    ends = np.append(starts[1:], len(data))
    first, inverse = _distinct(data, starts, ends)
    sizes = (ends - starts)[first]
    symbols, begins = merge_rounds(vocabulary, vocabulary.byte_ids[data[ranges(starts[first], sizes)]], np.concatenate(([0], np.cumsum(sizes))))
    counts = np.diff(begins)[inverse]
    lead = begins[:-1][inverse]
    if fixed:
        special = np.searchsorted(starts, spans[:, 0])
        symbols, lead[special], counts[special] = np.concatenate((symbols, [fixed[a][1] for a in spans[:, 0].tolist()])), len(symbols) + np.arange(len(spans)), 1
    ids = symbols[ranges(lead, counts)]
    return ids, np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, offsets)]


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """The bytes of a row of ids; special tokens stand for their own text. Cut characters remain as they are."""
    sizes = np.diff(vocabulary.begins)[ids]
    return vocabulary.flat[ranges(vocabulary.begins[ids], sizes)].tobytes()


def decimals(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """The ids as decimal numbers, each with a comma behind it."""
    return vocabulary.digits[ranges(vocabulary.digit_begins[ids], np.diff(vocabulary.digit_begins)[ids])].tobytes()


def stretches(vocabulary: Vocabulary, data: np.ndarray, most: int = STRETCH) -> Iterator[np.ndarray]:
    """A text in stretches of about ``most`` bytes, cut where a blank or line feed follows a visible ASCII sign that no special token holds.

    Such a place is always between two pieces; without one a stretch goes on.
    """
    visible = np.zeros(256, bool)
    visible[33:127] = True
    for token in vocabulary.specials:
        visible[list(token)] = False
    low = 0
    while len(data) - low > most:
        high = low + most
        while True:
            window = data[high : high + most]
            found = np.flatnonzero(((window[1:] == 32) | (window[1:] == 10)) & visible[window[:-1]])
            if len(found) or high + most >= len(data):
                break
            high += most - 1
        cut = high + int(found[0]) + 1 if len(found) else len(data)
        yield data[low:cut]
        low = cut
    yield data[low:]


def _encoded(path: str, with_ids: bool):
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "lossless": pa.bool_()}

    def long_row(vocabulary: Vocabulary, data: np.ndarray) -> tuple[int, str, str, bool, list[np.ndarray]]:
        count, listed, decoded, same, kept = 0, hashlib.sha256(), hashlib.sha256(), True, []
        wait = b""
        for stretch in stretches(vocabulary, data):
            ids, _ = encode(vocabulary, stretch, np.array([0, len(stretch)]))
            back = decode(vocabulary, ids)
            count, same = count + len(ids), same and back == stretch.tobytes()
            # the last comma waits until more ids follow
            listed.update(wait + decimals(vocabulary, ids)[:-1])
            wait = b"," if len(ids) else wait
            decoded.update(back)
            if with_ids:
                kept.append(ids)
        return count, listed.hexdigest(), decoded.hexdigest(), same, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path)
        for batch in parts(batches, most=STRETCH):
            data, offsets = text_bytes(batch.column("text"))
            if batch.num_rows == 1:
                rows = [long_row(vocabulary, data)]
                ids = [np.concatenate([np.zeros(0, np.int64), *rows[0][4]])]
            else:
                flat, begins = encode(vocabulary, data, offsets)
                ids = [flat[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
                rows = []
                for own, a, b in zip(ids, offsets[:-1], offsets[1:], strict=True):
                    back = decode(vocabulary, own)
                    rows.append((len(own), hashlib.sha256(decimals(vocabulary, own)[:-1]).hexdigest(), hashlib.sha256(back).hexdigest(), back == data[a:b].tobytes()))
            columns = [batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(list(kinds.values())[1:]))]
            names = list(kinds)
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_bytes(docs: DataFrame, vocabulary_path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, lossless`` for each row of ``doc_id, text``; with_ids adds ``ids``.

    Ids are those of the tokenizers library for the vocabulary file without added special tokens; a special token's own text is that token.
    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the decoded text.

    A null or empty text has no tokens and decodes to an empty text. A null id is kept; repeated rows give equal rows; an empty table gives an
    empty result; further columns are ignored. Rows are worked on alone, a long text in stretches, so the result doesn't depend on neighbours.
    """
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(_encoded(vocabulary_path, with_ids), kind)
