"""Byte-pair merges of many words at once.

All words of a batch go through the agenda together: in every round each word applies its best remaining merge, the leftmost among equals. Long
words, which would need many rounds, are merged one by one with a heap; both follow the same rule.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from tickloom.llm.words import mixed, ranges

#: Symbols above which a word is merged with a heap.
LONG_WORD = 40
_NEVER = np.iinfo(np.int64).max
_PLACE = np.uint64(0xD1342543DE82EF95)
_PIECE = np.uint64(0xDA942042E4DD58B5)


@dataclass(frozen=True)
class MergeTable:
    """Sorted keys ``left << 32 | right`` of all merges, with the rank (smaller first) and the symbol each makes."""

    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray

    @staticmethod
    def of(merges: list[tuple[int, int, int, int]]) -> MergeTable:
        """From rows (left, right, rank, made)."""
        rows = np.array(sorted((a << 32 | b, rank, made) for a, b, rank, made in merges), np.int64).reshape(-1, 3)
        return MergeTable(*(np.ascontiguousarray(rows[:, k]) for k in range(3)))

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of each pair in the table, -1 if it has none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


@dataclass(frozen=True)
class Dropout:
    """Skips a candidate merge with the given chance; the choice is a hash of the word's salt, the place of the pair and the piece it would make."""

    chance: float

    def skips(self, salt, place, made):
        salt, place, made = (np.atleast_1d(np.asarray(x)).astype(np.uint64) for x in (salt, place, made))
        key = mixed(salt + place * _PLACE + made * _PIECE)
        return key < np.uint64(min(self.chance * 2.0**64, 2.0**64 - 2048))


def merged(symbols: np.ndarray, begins: np.ndarray, table: MergeTable, drop: Dropout | None = None, salts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of every word after all merges, and the n + 1 symbol numbers at which words begin."""
    counts = np.diff(begins)
    long = np.flatnonzero(counts > LONG_WORD)
    short = np.flatnonzero(counts <= LONG_WORD)
    out_counts = np.zeros(len(counts), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    place = ranges(begins[:-1][short], counts[short])
    found, owners = _together(symbols[place], np.repeat(short, counts[short]), place - np.repeat(begins[:-1][short], counts[short]), table, drop, salts)
    done.append((found, owners))
    for k in long.tolist():
        own = _alone(symbols[begins[k] : begins[k + 1]].tolist(), table, drop, None if salts is None else salts[k])
        done.append((np.array(own, symbols.dtype), np.full(len(own), k)))
    pieces, owner = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
    order = np.argsort(owner, kind="stable")
    np.add.at(out_counts, owner, 1)
    return pieces[order], np.concatenate(([0], np.cumsum(out_counts)))


def _together(sym: np.ndarray, word: np.ndarray, start: np.ndarray, table: MergeTable, drop: Dropout | None, salts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    done_sym, done_word = [], []

    def look(at: np.ndarray) -> np.ndarray:
        """Candidate numbers of the pairs that begin at the places."""
        right = np.minimum(at + 1, len(sym) - 1)
        k = table.find(sym[at], sym[right])
        k[(right == at) | (word[at] != word[right])] = -1
        if drop is not None:
            have = np.flatnonzero(k >= 0)
            if len(have):
                k[have[drop.skips(salts[word[at[have]]], start[at[have]], table.made[k[have]])]] = -1
        return k

    pair = look(np.arange(len(sym))) if len(sym) else np.zeros(0, np.int64)
    while len(sym):
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        key = np.where(pair >= 0, table.ranks[pair] << 32 | np.arange(len(sym)), _NEVER)
        best = np.minimum.reduceat(key, heads)
        open_ = best != _NEVER
        if not open_.all():
            sizes = np.diff(np.concatenate((heads, [len(sym)])))
            still = np.repeat(open_, sizes)
            done_sym.append(sym[~still])
            done_word.append(word[~still])
            # places move up by what was taken out before them
            moved = np.cumsum(np.where(open_, 0, sizes))[open_]
            at = (best[open_] & 0xFFFFFFFF) - moved
            sym, word, start, pair = sym[still], word[still], start[still], pair[still]
        else:
            at = best & 0xFFFFFFFF
        if not len(sym):
            break
        sym[at] = table.made[pair[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, word, start, pair = sym[keep], word[keep], start[keep], pair[keep]
        at = at - np.arange(len(at))
        before = at[at > 0] - 1
        before = before[word[before] == word[before + 1]]
        for where in (at, before):
            pair[where] = look(where)
    if not done_sym:
        return sym, word
    return np.concatenate(done_sym), np.concatenate(done_word)


def _alone(sym: list[int], table: MergeTable, drop: Dropout | None, salt) -> list[int]:
    after = list(range(1, len(sym) + 1))
    before = list(range(-1, len(sym) - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def push(a: int) -> None:
        b = after[a]
        if a < 0 or b >= len(sym):
            return
        k = int(table.find(np.array([sym[a]]), np.array([sym[b]]))[0])
        if k >= 0 and not (drop is not None and drop.skips(salt, a, table.made[k])[0]):
            heapq.heappush(heap, (int(table.ranks[k]), a, sym[a], sym[b], int(table.made[k])))

    for a in range(len(sym) - 1):
        push(a)
    while heap:
        _, a, left, right, made = heapq.heappop(heap)
        b = after[a]
        if b >= len(sym) or sym[a] != left or sym[b] != right:
            continue
        sym[a], sym[b] = made, -1
        after[a] = after[b]
        if after[b] < len(sym):
            before[after[b]] = a
        push(a)
        if before[a] >= 0:
            push(before[a])
    return [x for x in sym if x >= 0]
