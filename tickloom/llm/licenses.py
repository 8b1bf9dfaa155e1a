"""License scan with a positional index of rare licence words.

Templates and key phrases are small fixed texts. How many documents have each template word is counted over all documents, which gives its
inverse document frequency. The words of highest IDF of every template are looked up in the positional index wherever they occur, whatever else
the document holds; each posting votes for (template, place where the template would begin). Places that several words agree on, and
where the votes leave room for enough of the template, are compared word by word, and a label is given when enough of the template stands
there and its mandatory phrases do too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import ALNUM, parts, ranges, text_bytes, word_hashes

#: Phrases whose every place is reported, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Label, notice text, phrases that must stand in the matched place.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("apache org licenses license 2 0",),
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version",
        ("gnu general public license", "version 3"),
    ),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)

#: Highest-IDF words looked up per template besides as many as may be missing, the votes that make a place worth comparing, and the part of a
#: template that must stand there.
RARE_WORDS = 8
MIN_VOTES = 2
MIN_COVERAGE = 0.7
#: Words by which a part of a notice may have moved.
_DRIFT = 6


def _hashes(text: str) -> np.ndarray:
    return word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), ALNUM)[0]


@cache
def _index() -> tuple:
    """Template words (sorted hashes), postings of each as (template, position), templates and phrases as hash arrays."""
    templates = [_hashes(text) for _, text, _ in TEMPLATES]
    vocabulary = np.unique(np.concatenate(templates))
    postings = [(int(np.searchsorted(vocabulary, h)), t, p) for t, words in enumerate(templates) for p, h in enumerate(words)]
    postings = np.array(sorted(postings), np.int64)
    begins = np.searchsorted(postings[:, 0], np.arange(len(vocabulary) + 1))
    phrases = [[_hashes(x) for x in key] for _, _, key in TEMPLATES]
    return vocabulary, begins, postings[:, 1], postings[:, 2], templates, phrases, [(_hashes(p), label) for p, label in BASE_PHRASES.items()]


def _codes(words: np.ndarray) -> np.ndarray:
    """Number of each word in the template vocabulary, -1 for others."""
    vocabulary = _index()[0]
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at, -1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = len(_index()[0])
    counts, docs = np.zeros(size, np.int64), 0
    for batch in parts(batches):
        words, rows = word_hashes(*text_bytes(batch.column("text")), ALNUM)
        codes = _codes(words)
        owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        pairs = np.unique(owner[codes >= 0] * size + codes[codes >= 0])
        counts += np.bincount(pairs % size, minlength=size)
        docs += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.concatenate(([docs], counts)))], ["code", "docs"])


def word_idf(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every template word, over all documents; as many numbers as the templates have words."""
    counts = {r["code"]: r["docs"] for r in docs.select("text").mapInArrow(_frequencies, "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs")).collect()}
    total = counts.pop(-1, 0)
    out = np.zeros(len(_index()[0]))
    for code, n in counts.items():
        out[code] = n
    return np.log((1 + total) / (1 + out))


def _consecutive(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """All places where the phrase's words stand one after the other, rows not regarded."""
    if len(words) < len(phrase):
        return np.zeros(0, np.int64)
    places = np.flatnonzero(words[: len(words) - len(phrase) + 1] == phrase[0])
    for k in range(1, len(phrase)):
        places = places[words[places + k] == phrase[k]]
    return places


def _looked_up(idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins, templates and positions of the postings that are looked up, and how many words of each template they leave out.

    A notice may lack 1 - MIN_COVERAGE of its words; RARE_WORDS more than that are taken, so that as many of them stand in every notice.
    """
    _, begins, templates, positions, wanted, *_ = _index()
    code = np.repeat(np.arange(len(idf)), np.diff(begins))
    taken = np.zeros(len(code), bool)
    for t, words in enumerate(wanted):
        own = np.unique(code[templates == t])
        most = int((1 - MIN_COVERAGE) * len(words)) + RARE_WORDS
        # the highest IDF first, ties by word number
        taken |= (templates == t) & np.isin(code, own[np.lexsort((own, -idf[own]))[:most]])
    left_out = np.bincount(templates[~taken], minlength=len(wanted))
    return np.searchsorted(code[taken], np.arange(len(idf) + 1)), templates[taken], positions[taken], left_out


def _alignments(words: np.ndarray, rows: np.ndarray, idf: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """For each row the (template, begin) pairs that at least MIN_VOTES words agree on and where enough of the template can stand."""
    begins, templates, positions, left_out = _looked_up(idf)
    codes = _codes(words)
    places = np.flatnonzero(codes >= 0)
    counts = np.diff(begins)[codes[places]]
    at = ranges(begins[codes[places]], counts)
    group = np.repeat(np.searchsorted(rows, places, "right") - 1, counts) * len(left_out) + templates[at]
    # a begin can lie before the first word
    votes, many = np.unique(group << 32 | np.repeat(places, counts) - positions[at] + (1 << 16), return_counts=True)
    votes, many = votes[many >= MIN_VOTES], many[many >= MIN_VOTES]
    # what stands at nearby begins, and the words without a posting, bound the coverage from above
    sums = np.concatenate(([0], np.cumsum(many)))
    near = sums[np.searchsorted(votes, votes + _DRIFT, "right")] - sums[np.searchsorted(votes, votes - _DRIFT)]
    group = votes >> 32
    sizes = np.array([len(x) for x in _index()[4]])
    template = group % len(sizes)
    votes, group, template = (x[near + left_out[template] >= MIN_COVERAGE * sizes[template]] for x in (votes, group, template))
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for row, t, begin in zip((group // len(sizes)).tolist(), template.tolist(), ((votes & 0xFFFFFFFF) - (1 << 16)).tolist(), strict=True):
        found[row].append((t, begin))
    return found


def _matches(words: np.ndarray, low: int, high: int, begins: list[tuple[int, int]]) -> tuple[set[str], float]:
    """Labels whose template stands in words[low:high], and the best coverage of a template with its phrases.

    All places of a template are compared at once, and each with its neighbours alone, so the work grows with the places.
    """
    *_, templates, phrases, _ = _index()
    labels, score, own = set(), 0.0, words[low:high]
    found = np.array(begins, np.int64).reshape(-1, 2)
    for template in np.unique(found[:, 0]).tolist():
        wanted, places = templates[template], np.unique(found[found[:, 0] == template, 1]) - low
        # a mandatory phrase must begin and end around the place
        first, last = np.maximum(places - _DRIFT, 0), np.minimum(places + len(wanted) + _DRIFT, len(own))
        fits = np.ones(len(places), bool)
        for phrase in phrases[template]:
            at = np.append(_consecutive(own, phrase), len(own))
            fits &= at[np.searchsorted(at, first)] + len(phrase) <= last
        here = np.empty((len(places), len(wanted)), bool)
        for k, word in enumerate(wanted):
            at = places + k
            inside = (at >= 0) & (at < len(own))
            here[:, k] = inside & (own[np.where(inside, at, 0)] == word)
        # words that moved by an insertion or omission stand at a nearby begin
        covered = here.copy()
        for near in range(-_DRIFT, _DRIFT + 1):
            other = np.minimum(np.searchsorted(places, places + near), len(places) - 1)
            same = places[other] == places + near
            covered[same] |= here[other[same]]
        coverage = covered.mean(1)[fits]
        if len(coverage) and coverage.max() >= MIN_COVERAGE:
            labels.add(TEMPLATES[template][0])
            score = max(score, float(coverage.max()))
    return labels, score


def _scanned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        base = _index()[-1]
        for batch in parts(batches):
            words, rows = word_hashes(*text_bytes(batch.column("text")), ALNUM)
            n = batch.num_rows
            count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: dict[int, set[str]] = defaultdict(set)
            for phrase, label in base:
                at = _consecutive(words, phrase)
                row = np.searchsorted(rows, at, "right") - 1
                inside = at + len(phrase) <= rows[row + 1]
                at, row = at[inside], row[inside]
                np.add.at(count, row, 1)
                np.minimum.at(first, row, at - rows[row])
                np.maximum.at(last, row, at - rows[row])
                for k in np.unique(row).tolist():
                    labels[k].add(label)
            found = {k: _matches(words, int(rows[k]), int(rows[k + 1]), x) for k, x in _alignments(words, rows, idf).items()}
            texts = lambda sets: pa.array([",".join(sorted(x)) for x in sets], pa.string())
            none = (set(), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(rows)),
                    pa.array(count),
                    pa.array(first, mask=count == 0),
                    pa.array(last, mask=count == 0),
                    texts(labels.get(k, ()) for k in range(n)),
                    texts(labels.get(k, set()) | found.get(k, none)[0] for k in range(n)),
                    pa.array([1.0 if k in labels else found.get(k, none)[1] for k in range(n)]),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row of ``doc_id, text``.

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII code points. n_base counts all places of the base phrases, first_word
    and last_word are the smallest and largest word number at which one begins, base_labels their labels; labels adds those found by the
    index. score is 1 with a base phrase, else the best covered part of a template whose phrases stand there, else 0. A null or empty text has no
    words, no labels and score 0; a null id and repeated rows are kept; an empty table gives an empty result; further columns are ignored. Of
    places that cover a template equally any counts, since only the label and the coverage are kept; the work grows with the words and places of
    a text, so a very long one is no case of its own.
    """
    docs = docs.select("doc_id", "text")
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.mapInArrow(_scanned(docs.sparkSession.sparkContext.broadcast(word_idf(docs))), kind)
