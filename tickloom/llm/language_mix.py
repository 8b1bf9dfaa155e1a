"""Language identification by mixture inference over character n-grams.

Training counts the n-grams of every labelled text into ``2**BUCKET_BITS`` hash buckets per language: one array per language and
task, summed by Spark. Prediction runs expectation-maximisation per document: its n-grams are drawn from a mixture of the
languages, whose proportions are re-estimated until they settle. The language set is the one with the highest likelihood after
a penalty for each further language, of the sets that take languages by falling share: from one language up to all that were learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import LOWER, mixed, parts, ranges, text_bytes

BUCKET_BITS = 15
#: Lengths in bytes of the n-grams, and what every bucket counts besides what was seen.
GRAMS = (2, 3, 4)
SMOOTHING = 0.5
#: Rounds of expectation-maximisation, and the log-likelihood that a further language must gain for each log(1 + n-grams).
ROUNDS = 12
PENALTY = 12.0
#: Bytes of text worked on at once.
PART_BYTES = 1 << 20

#: Bytes as n-grams see them: A-Z as a-z, all other ASCII that isn't a letter as a blank.
_SEEN = np.where((LOWER >= 97) & (LOWER < 123) | (LOWER >= 128), LOWER, 32).astype(np.uint64)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams in text order, and the row of each; none crosses rows, runs of blanks have none."""
    data, offsets = text_bytes(column)
    seen = _SEEN[data]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found, owners = [], []
    for n in GRAMS:
        if len(seen) < n:
            continue
        key = np.zeros(len(seen) - n + 1, np.uint64)
        for k in range(n):
            key = (key << np.uint64(8)) | seen[k : len(seen) - n + 1 + k]
        whole = rows[: len(key)] == rows[n - 1 :]
        # no n-gram of blanks only or with a blank inside
        blank = (seen[: len(key)] == 32) & (seen[1 : len(key) + 1] == 32)
        for k in range(1, n - 1):
            blank |= seen[k : k + len(key)] == 32
        keep = whole & ~blank
        found.append((mixed(key[keep] + (np.uint64(n) << np.uint64(40))) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(rows[: len(key)][keep])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in parts(batches, most=PART_BYTES):
        names = batch.column("lang").to_pylist()
        own = sorted(set(names))
        code = np.array([own.index(x) for x in names], np.int64)
        buckets, rows = grams(batch.column("text"))
        counts = np.bincount((code[rows] << BUCKET_BITS) + buckets, minlength=len(own) << BUCKET_BITS).reshape(len(own), -1)
        for name, x in zip(own, counts, strict=True):
            sums[name] = sums[name] + x if name in sums else x
    yield _packed(sums)


def _packed(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.astype(np.int64).tobytes() for x in sums.values()], pa.binary())], ["lang", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for name, data in zip(batch.column("lang").to_pylist(), batch.column("counts"), strict=True):
            x = np.frombuffer(data.as_buffer(), np.int64)
            sums[name] = sums[name] + x if name in sums else x
    yield _packed(sums)


@dataclass(frozen=True)
class LanguageModel:
    """Names of the learned languages, and the probability of every bucket in each of them (buckets x languages)."""

    names: tuple[str, ...]
    chances: np.ndarray


def train(docs: DataFrame) -> LanguageModel:
    """Learn from all rows of ``text, lang`` with neither null; what comes to the driver is one array per language."""
    kind = "lang string, counts binary"
    rows = docs.select("text", "lang").dropna().mapInArrow(_counted, kind).repartition("lang").mapInArrow(_summed, kind).collect()
    counts = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in rows}
    names = tuple(sorted(n for n, x in counts.items() if x.sum()))
    if not names:
        return LanguageModel((), np.zeros((1 << BUCKET_BITS, 0)))
    table = np.stack([counts[n] for n in names], 1) + SMOOTHING
    return LanguageModel(names, table / table.sum(0))


def _mixture(chances: np.ndarray, weights: np.ndarray, heads: np.ndarray, rows: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) and log-likelihood per document of the mixture over its allowed languages.

    chances: languages x entries; weights: how often each entry occurs; heads: first entry of each document; rows: document of each entry.
    """
    share = (allowed / allowed.sum(1, keepdims=True)).T
    total = np.add.reduceat(weights, heads)
    for _ in range(ROUNDS):
        joint = chances * np.take(share, rows, axis=1)
        joint *= weights / joint.sum(0)
        share = np.add.reduceat(joint, heads, axis=1) / total
    return share.T, np.add.reduceat(weights * np.log((chances * np.take(share, rows, axis=1)).sum(0)), heads)


def infer(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Proportions over all languages, and over the selected set (zero outside it), for each text; rows without n-grams are zero."""
    n, size = len(column), len(model.names)
    every, chosen = np.zeros((n, size)), np.zeros((n, size))
    buckets, rows = grams(column)
    if not size or not len(buckets):
        return every, chosen
    entries, weights = np.unique((rows << BUCKET_BITS) + buckets, return_counts=True)
    rows, weights = entries >> BUCKET_BITS, weights.astype(float)
    docs, heads = np.unique(rows, return_index=True)
    rows = np.searchsorted(docs, rows)
    chances = np.ascontiguousarray(model.chances[entries & ((1 << BUCKET_BITS) - 1)].T)
    total = np.add.reduceat(weights, heads)
    share, most = _mixture(chances, weights, heads, rows, np.ones((len(docs), size)))
    every[docs] = share
    alone = np.add.reduceat(weights * np.log(chances), heads, axis=1).T
    best, top = np.eye(size)[alone.argmax(1)], alone.max(1)
    # no set fits better than the mixture of all languages: where even that doesn't pay for a second language, one is enough
    tails = np.concatenate((heads[1:], [len(rows)]))
    some = np.flatnonzero(most - PENALTY * np.log1p(total) > top)
    if len(some):
        own = ranges(heads[some], tails[some] - heads[some])
        begins = np.concatenate(([0], np.cumsum(tails[some] - heads[some])))[:-1]
        local = np.repeat(np.arange(len(some)), tails[some] - heads[some])
        order = np.argsort(-share[some], axis=1, kind="stable")
        for k in range(2, size + 1):
            allowed = np.zeros((len(some), size))
            np.put_along_axis(allowed, order[:, :k], 1.0, 1)
            part, fit = _mixture(chances[:, own], weights[own], begins, local, allowed)
            fit -= PENALTY * (k - 1) * np.log1p(total[some])
            better = fit > top[some]
            best[some[better]], top[some[better]] = part[better], fit[better]
    chosen[docs] = best
    return every, chosen


def _predicted(shared, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in parts(batches, most=PART_BYTES):
            every, chosen = infer(model, batch.column("text"))
            names, scores, sets = [], [], []
            for text, share, own in zip(batch.column("text").to_pylist(), every, chosen, strict=True):
                if text is None or not own.any() and not model.names or not any(map(str.isalpha, text)):
                    names.append("und"), scores.append(0.0), sets.append("")
                    continue
                top = int(own.argmax())
                names.append(model.names[top])
                scores.append(float(min(1.0, max(share[top], 0.0))))
                sets.append(",".join(sorted(model.names[k] for k in np.flatnonzero(own > 0))))
            found = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, "lang_pred", "score", "languages"])

    return run


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred, score, languages`` for each row of ``text``.

    lang_pred is the largest language of the selected set, score its proportion in the mixture of all languages, languages the set.
    A null text, a text without a letter, and any text when nothing was learned is ``und`` with score 0 and no languages. A
    text whose letters give no known n-gram (a single letter) gets the alphabetically first language with score 0.
    """
    kinds = dict(docs.dtypes)
    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double", "languages string"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(_predicted(shared, keep), out)


def identify_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` of ``doc_id, text, lang``; learns from the rows that are not held out.

    Rows with a null id, text or lang teach nothing; repeated rows count as often as they occur; held_out is null for a null id.
    An empty table gives an empty result; further columns are ignored.
    """
    own = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    return identify(own, train(own.filter("NOT held_out")), ("doc_id", "held_out"))
