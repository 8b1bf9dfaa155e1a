"""SentencePiece BPE encoding with seeded merge dropout, and lossless decoding.

A text is cut before each run of blanks; no piece crosses such a cut, so these units can be merged on their own and all at once. Every
occurrence of a unit is merged by itself: each candidate merge is skipped by a hash keyed by the seed, the document and the unit's number in it
while the agenda is worked off. Without dropout each distinct unit is merged once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bpe import Dropout, MergeTable, merged
from tickloom.llm.words import keyed, mixed, parts, ranges, span_hashes, text_bytes

#: Bytes of text worked on at once.
PART_BYTES = 1 << 20
#: Symbols of code points without a piece lie above this number.
_UNKNOWN = 1 << 24


@dataclass(frozen=True)
class PieceModel:
    """Tables of a BPE model with byte fallback and identity normalization."""

    table: MergeTable
    codes: np.ndarray
    char_pieces: np.ndarray
    byte_pieces: np.ndarray
    piece_bytes: np.ndarray
    piece_begins: np.ndarray


@cache
def load_model(path: str) -> PieceModel:
    """Read a model file; only pieces, scores and types are used."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces = [sp.id_to_piece(k) for k in range(n)]
    plain = {p: k for k, p in enumerate(pieces) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))}
    if any("▁" in p.lstrip("▁") for p in plain):
        raise ValueError("pieces that cross a blank aren't supported")
    order = {k: r for r, k in enumerate(sorted(plain.values(), key=lambda k: (-sp.get_score(k), k)))}
    merges = [(plain[p[:c]], plain[p[c:]], order[k], k) for p, k in plain.items() for c in range(1, len(p)) if p[:c] in plain and p[c:] in plain]
    # equal scores are told apart by place, not by piece
    level: dict[float, int] = {}
    for p, k in plain.items():
        level[sp.get_score(k)] = min(level.get(sp.get_score(k), n), order[k])
    merges = [(a, b, level[sp.get_score(k)], k) for a, b, _, k in merges]
    chars = sorted((ord(p), k) for p, k in plain.items() if len(p) == 1 and p != "▁")
    byte_pieces = np.zeros(256, np.int64)
    texts = []
    for k, p in enumerate(pieces):
        if sp.is_byte(k):
            byte_pieces[int(p[3:5], 16)] = k
            texts.append(bytes([int(p[3:5], 16)]))
        else:
            texts.append(p.replace("▁", " ").encode() if k in order else b"")
    codes = np.array([32, *(c for c, _ in chars if c != 32)], np.int64)
    ids = np.array([plain["▁"], *(k for c, k in chars if c != 32)], np.int64)
    rank = np.argsort(codes)
    return PieceModel(MergeTable.of(merges), codes[rank], ids[rank], byte_pieces, np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts]))))


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte at which each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
    a = padded[at]
    b, c, d = (padded[at + k] & 0x3F for k in (1, 2, 3))
    two, three, four = a >= 0xC0, a >= 0xE0, a >= 0xF0
    out = np.where(four, (a & 7) << 18 | b << 12 | c << 6 | d, np.where(three, (a & 15) << 12 | b << 6 | c, np.where(two, (a & 31) << 6 | b, a)))
    return out, at


def encode(model: PieceModel, column: pa.Array, salts: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and the n + 1 numbers at which rows begin; ``salts`` has a 64-bit key per row.

    A row's text gets a blank in front, unless it is empty. With a chance of 0 this is the model's own BPE segmentation, except that U+2581 in
    a text is written as its bytes, so that it isn't read back as a blank.
    """
    data, offsets = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    # a blank in front of every text
    full = np.diff(offsets) > 0
    shift = np.cumsum(full)
    texts = np.full(len(data) + int(full.sum()), 32, np.uint8)
    rows = np.repeat(np.arange(len(full)), np.diff(offsets))
    texts[np.arange(len(data)) + shift[rows]] = data
    offsets = offsets + np.concatenate(([0], shift))
    blank = texts == 32
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    cut[offsets[:-1][full]] = True
    starts = np.flatnonzero(cut)
    ends = np.concatenate((starts[1:], [len(texts)]))
    row = np.searchsorted(offsets, starts, "right") - 1
    if chance:
        number = np.arange(len(starts)) - np.searchsorted(starts, offsets)[row]
        own, first, inverse = mixed(salts[row] + mixed(number)), np.arange(len(starts)), np.arange(len(starts))
    else:
        own, first, inverse = np.unique(span_hashes(texts, starts, ends, cased=True), return_index=True, return_inverse=True)
    sizes = (ends - starts)[first]
    points, at = _code_points(texts[ranges(starts[first], sizes)])
    begins = np.searchsorted(at, np.concatenate(([0], np.cumsum(sizes))))
    known = np.minimum(np.searchsorted(model.codes, points), len(model.codes) - 1)
    symbols = np.where(model.codes[known] == points, model.char_pieces[known], points + _UNKNOWN)
    pieces, begins = merged(symbols, begins, model.table, Dropout(chance) if chance else None, own)
    # code points without a piece become their bytes
    odd = np.flatnonzero(pieces >= _UNKNOWN)
    if len(odd):
        spelled = [model.byte_pieces[list(chr(int(pieces[k]) - _UNKNOWN).encode())] for k in odd]
        wide = np.ones(len(pieces), np.int64)
        wide[odd] = [len(x) for x in spelled]
        after = np.concatenate(([0], np.cumsum(wide)))
        pieces = np.repeat(pieces, wide)
        pieces[ranges(after[odd], wide[odd])] = np.concatenate(spelled)
        begins = after[begins]
    counts = np.diff(begins)[inverse]
    ids = pieces[ranges(begins[inverse], counts)]
    ends = np.concatenate(([0], np.cumsum(counts)))
    return ids, ends[np.searchsorted(starts, offsets)]


def decode(model: PieceModel, ids: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """The UTF-8 texts of rows of piece ids."""
    sizes = np.diff(model.piece_begins)[ids]
    data = model.piece_bytes[ranges(model.piece_begins[ids], sizes)]
    ends = np.concatenate(([0], np.cumsum(sizes)))[begins]
    return [data[a + 1 : b].tobytes() if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def document_salts(marks: np.ndarray, seed: int) -> np.ndarray:
    return mixed(marks.astype(np.uint64) + keyed(seed, 1))


def _encoded(path: str, seed: int, chance: float, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for batch in parts(batches, most=PART_BYTES):
            ids, begins = encode(model, batch.column("text"), document_salts(batch.column("mark").to_numpy(), seed), chance)
            back = decode(model, ids, begins)
            data, offsets = text_bytes(batch.column("text"))
            same = [data[a:b].tobytes() == x for a, b, x in zip(offsets[:-1], offsets[1:], back, strict=True)]
            raw = ids.astype("<i4")
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.array(np.diff(begins)),
                pa.array([zlib.crc32(raw[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                pa.array(same, pa.bool_()),
            ]
            names = ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(docs: DataFrame, model_path: str, seed: int = 0, chance: float = 0.1, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_pieces, ids_crc32, decoded_sha256, lossless`` for each row of ``doc_id, text``; with_ids adds ``ids``.

    Each document's randomness is keyed by the seed, its id and its text, so a run can be repeated; another seed gives other segmentations. A null or
    empty text has no pieces and decodes to an empty text. A null id is kept; repeated rows give equal rows; an empty table gives an empty
    result; further columns are ignored.
    """
    kind = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("mark")).mapInArrow(_encoded(model_path, seed, chance, with_ids), kind)
