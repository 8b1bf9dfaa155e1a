"""Operators on documents against brute force on the odd rows, and their results on empty tables."""

import hashlib
import math
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_rows import edited, prose

from tickloom.llm import fingerprints, language_mix, licenses, line_dedup, ngram_join, suffix_array, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def joined(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def jaccard_components(rows):
    sets = [(i, shingle_set(t)) for i, t, *_ in rows if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a != b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return joined(links, {i for i, _ in sets})


def test_jaccard_join(odd_docs, odd_rows, no_docs):
    found = ngram_join.near_components(odd_docs).collect()
    component = jaccard_components(odd_rows)
    want = sorted(((i, len(shingle_set(t)), component.get(i)) for i, t, *_ in odd_rows), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == want
    assert ngram_join.near_components(no_docs).count() == 0


def test_jaccard_join_loses_no_link_behind_a_bad_hub(spark):
    """Chains of edits: members that are not alike to the first or last of their lists."""
    texts = [prose(5, 200)]
    for k in range(25):
        texts.append(edited(texts[-1], k, 2))
    rows = [(1000 - k if k % 2 else k, t) for k, t in enumerate(texts)]
    component = jaccard_components(rows)
    assert len(set(component.values())) == 1
    found = ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == component


def test_fingerprints(odd_docs, odd_rows, no_docs):
    rows = odd_docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = []
    for k, r in enumerate(rows):
        a, b = r.text or "", rows[(k + 1) % len(rows)].text or ""
        half = len(a) // 2
        want.append((r.doc_id, len(a), hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()))
    found = fingerprints.fingerprint_documents(odd_docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=str) == sorted(want, key=str)
    texts = {(r.doc_id, r.h): r.text for r in rows}
    assert len({r.fingerprint for r in found}) == len({frozenset(shingle_set(t)) for t in texts.values()})
    assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    assert fingerprints.fingerprint_documents(no_docs).count() == 0


def test_likeness_estimates_jaccard():
    a = prose(1, 600)
    for changes in (5, 40, 120):
        b = edited(a, 7, changes)
        x, y = shingle_set(a), shingle_set(b)
        signs = fingerprints.signatures(pa.array([a, b]))
        assert abs(fingerprints.likeness(signs[:1], signs[1:])[0] - len(x & y) / len(x | y)) < 0.17


def test_signatures_equal_plain_minima(odd_rows):
    """Every permutation's minimum by plain integers, for texts of one batch, a long one among them; likeness is the share of equal ones."""
    texts = [t for _, t, *_ in odd_rows if t is None or len(t) < 5000] + [prose(7, 3000)]
    found = fingerprints.signatures(pa.array(texts, pa.string()))
    scale, shift = fingerprints._SCALE.tolist(), fingerprints._SHIFT.tolist()
    for row, t in enumerate(texts):
        grams = {int(x) for x in words.shingles(*words.word_hashes(*words.text_bytes(pa.array([t], pa.string()))))[0]}
        assert len(grams) == len(shingle_set(t))
        want = [min(((a * x + b) % 2**64 for x in grams), default=2**64 - 1) >> 48 for a, b in zip(scale[:12], shift[:12], strict=True)]
        assert found[row, :12].tolist() == want
    assert fingerprints.likeness(found[:1], found[1:2])[0] == sum(a == b for a, b in zip(found[0].tolist(), found[1].tolist(), strict=True)) / fingerprints.PERMUTATIONS


def test_band_join_finds_near_duplicates(odd_docs, odd_rows):
    found = {r.doc_id: r.class_id for r in fingerprints.near_duplicates(odd_docs).collect()}
    assert found == {i: c for i, c in jaccard_components(odd_rows).items()} | {None: None}


@pytest.mark.parametrize("most", [fingerprints.MOST_PAIRS, 0])
def test_band_join_loses_no_link_behind_a_bad_hub(spark, monkeypatch, most):
    """Two near duplicates whose bands all hold documents of smaller and larger ids that share their passage but are near duplicates of nothing; with and without further rounds."""
    monkeypatch.setattr(fingerprints, "MOST_PAIRS", most)
    monkeypatch.setattr(fingerprints, "RARE_ROUNDS", 3)
    rows = []
    for family in range(4):
        passage = prose(1000 * family, 300)
        tail = lambda k, n: " " + prose(1000 * family + k, n)
        rows += [(100 * family + k * 10_000, passage + tail(1 + k, 75)) for k in (*range(12), *range(20, 32))]
        rows += [(150_000 + 100 * family + k, passage + tail(100 + k, 40)) for k in range(2)]
    want = jaccard_components(rows)
    assert sum(i != c for i, c in want.items()) == 4
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert {r.doc_id: r.class_id for r in fingerprints.near_duplicates(docs).collect()} == want


def test_fingerprints_with_classes(odd_docs, odd_rows, no_docs):
    found = fingerprints.fingerprints_with_classes(odd_docs).collect()
    component = jaccard_components(odd_rows)
    assert sorted(map(str, ((r.doc_id, r.class_id) for r in found))) == sorted(str((i, component.get(i))) for i, *_ in odd_rows)
    plain = fingerprints.fingerprint_documents(odd_docs).collect()
    assert sorted(map(str, (tuple(r)[:-1] for r in found))) == sorted(map(str, map(tuple, plain)))
    assert fingerprints.fingerprints_with_classes(no_docs).count() == 0


def repeats(rows):
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(odd_docs, odd_rows, no_docs):
    found = suffix_array.remove_repeats(odd_docs).collect()
    assert sorted((tuple(r) for r in found), key=str) == repeats(odd_rows)
    assert suffix_array.remove_repeats(no_docs).count() == 0


def test_repeats_of_runs_and_shared_starts(spark):
    """Long runs of one byte, and many texts that part only after 32 equal bytes, which only cover ranks tell apart."""
    stem = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKL"
    rows = [(k, f"{stem}{k % 7:03d}{'z' * (k % 5)}{k // 9}") for k in range(300)]
    rows += [(1000 + k, "a" * (40 + 7 * k)) for k in range(8)] + [(2000, "ab" * 60), (2001, "ba" * 61)]
    found = suffix_array.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((tuple(r) for r in found), key=str) == repeats(rows)


def bucket_of(texts, block=suffix_array.LENGTH << 10):
    """The rows that the task of one bucket gets for these texts, a block each ``block`` bytes; ids count up."""
    rows, ids, held = [], [], 0
    for k, t in enumerate(texts):
        ids.append(k)
        held += len(t)
        if held >= block or k == len(texts) - 1:
            own = [texts[i].encode() for i in ids]
            rows.append((len(rows), np.array(ids).tobytes(), np.array([len(x) for x in own]).tobytes(), suffix_array._packed(b"".join(own))))
            ids, held = [], 0
    schema = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "sizes", "data"))])
    blocks = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    anchors = pa.Table.from_batches(suffix_array._anchor_rows(1)(iter([blocks])))
    replies = {r["block"]: [{"bucket": 0, "bits": r["bits"]}] for r in suffix_array._shared_anchors(anchors).to_pylist()}
    kind = pa.list_(pa.struct([("bucket", pa.int32()), ("bits", pa.binary())]))
    replied = blocks.append_column("replies", pa.array([replies.get(r[0]) for r in rows], kind))
    return replied, pa.Table.from_batches(suffix_array._fragment_rows(1)(iter([replied])))


def test_a_bucket_is_sorted_in_little_memory():
    """A bucket whose fragments are all shared needs a few times their bytes, not a hundred times."""
    half = [prose(k, 2500) for k in range(60)]
    texts = [*half, *(x[9:] for x in half)]
    replied, bucket = bucket_of(texts, 400_000)
    held = sum(int.from_bytes(x.as_py()[:8], "little") for x in bucket.column("data"))
    assert held > 4_000_000
    suffix_array._least_docs(bucket)
    tracemalloc.start()
    found = suffix_array._least_docs(bucket).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000 + 5 * held
    gone = []
    for row in replied.to_pylist():
        block = suffix_array._Block(row)
        here = suffix_array._covered(block, suffix_array._Fragments(block, 1, row["replies"]), [r for r in found if r["block"] == row["block"]])
        gone += [int(here[a:b].sum()) for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
    assert gone == [r[2] for r in sorted(repeats(list(enumerate(texts))), key=lambda r: r[0])]


def test_buckets_of_the_passage_stage_follow_the_blocks(spark, monkeypatch):
    """The fourth stage of the pipeline has a bucket for a few blocks at most, however few partitions the session asks for."""
    asked = []
    reports = suffix_array._reports
    monkeypatch.setattr(suffix_array, "_reports", lambda n, keep: asked.append(n) or reports(n, keep))
    rows = [(k, prose(k % 80, 40), "aa", "s", 1) for k in range(120)]
    found = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(60), "").collect()
    assert sorted(r.doc_id for r in found) == list(range(80))
    assert all(r.text == rows[r.doc_id][1] and r.n_chars == len(r.text) for r in found)
    assert asked[0] == 60 // suffix_array.BUCKET_BLOCKS


def test_repeats_over_many_small_blocks(spark, monkeypatch):
    """More buckets than the session's partitions ask for."""
    monkeypatch.setattr(suffix_array, "BUCKET_BLOCKS", 1)
    rows = [(k % 97, prose(k % 60, 40)[k % 9 :]) for k in range(150)] + [(None, prose(1, 40))]
    found = suffix_array.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(40)).collect()
    assert sorted((tuple(r) for r in found), key=str) == repeats(rows)


def test_sorted_orders_suffixes():
    data = np.frombuffer(b"banana bandana banana" + b"\0" * 80, np.uint8)
    at = np.arange(21)
    order, common = suffix_array._sorted(data, at, 21 - at, 16)
    texts = [data[k:21].tobytes()[:16] for k in at[order]]
    assert texts == sorted(texts)
    for a, b, n in zip(texts, texts[1:], common[1:], strict=False):
        assert next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) == n


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) <= 1 and a != b and any(a[:k] == b[:k] and a[k + (len(a) == len(b)) :] == b[k + 1 :] for k in range(len(b)))


def lines_lost(rows):
    places = defaultdict(list)
    for i, t, *_ in rows:
        if i is not None and t is not None:
            for k, line in enumerate(t.split("\n")):
                line = line.strip(" \t\r")
                if len(line) >= line_dedup.MIN_CHARS:
                    places[line].append((i, k))
    lost = set()
    for line, own in places.items():
        near = any(one_edit(line, other) and min(at) < min(own) for other, at in places.items())
        lost |= {p for p in own if near or p != min(own)}
    return lost


def test_line_dedup(odd_docs, odd_rows, no_docs):
    assert {(r.doc_id, r.line_no) for r in line_dedup.dropped_lines(odd_docs).collect()} == lines_lost(odd_rows)
    report = line_dedup.line_report(odd_docs).collect()
    assert len(report) == len(odd_rows)
    assert line_dedup.dedup_lines(no_docs).count() == line_dedup.line_report(no_docs).count() == 0


def test_line_dedup_edits(spark):
    """Every kind of edit at every place, chains of edits, long lines and short ones."""
    line = "the quick brown fox jumps over the lazy dog again and again"
    texts = [line, *(line[:k] + "#" + line[k + 1 :] for k in range(0, len(line), 5)), *(line[:k] + line[k + 1 :] for k in range(0, len(line), 7)), *(line[:k] + "é" + line[k:] for k in range(0, len(line) + 1, 6))]
    texts += [line + "xx", line + "xxx", "short line", "short lint", "x" * 3000, "x" * 2999 + "y", "\t" + line + " \r", "b" * 40, "b" * 41, "b" * 43]
    rows = [(k, "\n".join(texts[k::3])) for k in (2, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lost = lines_lost(rows)
    assert {(r.doc_id, r.line_no) for r in line_dedup.dropped_lines(docs).collect()} == lost
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert kept == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in lost) for i, t in rows}


def test_licenses(spark, odd_docs, odd_rows, no_docs):
    texts = ["Released under the MIT License.", "x MIT\nLicense MIT license", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0", "mitlicense, mit-licenses", "This work is licensed under the GNU General Public License, version 3.", "Redistribution and use, in source and binary forms; with or without any modification, are permitted provided that the following conditions are met", "the software is without restriction", None, ""]
    docs = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string").union(odd_docs.select("doc_id", "text"))
    found = licenses.scan(docs).collect()
    by = {r.doc_id - 1000: r for r in found if r.doc_id is not None and r.doc_id >= 1000}
    assert [by[k].n_base for k in range(5)] == [1, 0, 1, 1, 0]
    assert (by[0].first_word, by[0].last_word) == (1, 1) and by[1].first_word is None and by[4].first_word is None
    assert by[1].base_labels == "" and by[1].score < 1
    assert [by[k].labels for k in (0, 2, 3, 5, 6, 7, 9)] == ["mit", "cc-by-nc", "apache-2", "gpl-3", "bsd", "", ""]
    assert by[6].base_labels == "" and 0.7 <= by[6].score <= 1 and by[7].score == 0 and by[0].score == 1
    assert len(found) == len(texts) + len(odd_rows)
    assert licenses.scan(no_docs).count() == 0


def base_places(text):
    """Words, and the places of each base phrase, by plain scans."""
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return len(w), sorted((k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())


def test_base_places_equal_brute_force(spark, odd_rows):
    r = random.Random(9)
    bits = ["under", "the", "MIT", "license", "Apache License,", "version 2", "cc", "by-nc", "by nc", "x", "é", "Ünder", "2", "under the MIT license"]
    rows = [(k, " ".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for k in range(400)] + [(10_000 + k, t) for k, (_, t, *_) in enumerate(odd_rows)]
    if os.path.isdir("/root/testdata/sf0.01"):
        table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
        rows += [(20_000 + x["doc_id"], x["text"]) for x in table.to_pylist()]
    found = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for doc_id, text in rows:
        n, places = base_places(text)
        x, at = found[doc_id], [k for k, _ in places]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (n, len(at), min(at, default=None), max(at, default=None))
        assert x.base_labels == ",".join(sorted({label for _, label in places})) and set(x.base_labels.split(",")) - {""} <= set(x.labels.split(","))


def test_a_long_text_of_one_notice(spark):
    """Work grows with the places: a megabyte of one notice, whole or with a word missing everywhere, takes seconds."""
    notice = licenses.TEMPLATES[0][1]
    texts = [f"{notice}. " * 30_000, notice.replace("released", "given") + " so " + f"{notice.replace('released', 'given')}. " * 30_000]
    started = time.time()
    found = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - started < 30
    assert found[0].n_base == 30_000 and found[0].labels == "mit" and found[1].n_base == 30_001 and found[1].labels == "mit"


def test_every_notice_of_a_bundle_is_found(spark):
    """All notices in one long document, among prose of rarer licence words, are found as in documents of their own."""
    notices = [t for _, t, _ in licenses.TEMPLATES]
    prose = "they merge and publish charge conditions commons copies sublicense binary forms source attribution warranty "
    docs = [(k, t) for k, t in enumerate(notices)]
    docs += [(100, " -- ".join(notices)), (101, prose * 40 + (" " + prose * 40).join(reversed(notices)) + prose * 40)]
    docs += [(200 + k, notices[1] + f" {prose * 30}" + t) for k, t in enumerate(notices)]
    docs += [(300 + k, "of the software this is to be used under the terms") for k in range(100)]
    by = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(label in by[k].labels.split(",") for k, (label, *_) in enumerate(licenses.TEMPLATES))
    everything = set().union(*(by[k].labels.split(",") for k in range(len(notices))))
    assert set(by[100].labels.split(",")) == set(by[101].labels.split(",")) == everything
    assert all(set(by[200 + k].labels.split(",")) == {"mit", *by[k].labels.split(",")} for k in range(len(notices)))
    assert all(by[300 + k].labels == "" for k in range(100))


def test_language(spark, no_docs):
    kinds = {"aa": "ka lo mi ne ru sa", "bb": "schu ger ung zwe ick ött"}
    rows = []
    for k in range(240):
        lang = ("aa", "bb")[k % 2]
        r = __import__("random").Random(k)
        text = " ".join("".join(r.choice(kinds[lang].split()) for _ in range(3)) for _ in range(30))
        rows.append((k, text, lang if k % 5 else None))
    half = rows[1][1] + " " + rows[0][1]
    rows += [(500, None, None), (501, "", None), (502, "12 34 !", None), (504, "½ ² Ⅷ", None), (503, half, None), (None, rows[0][1], "bb"), rows[7]]
    found = language_mix.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert [by[k].lang_pred for k in (500, 501, 502, 504)] == ["und"] * 4
    assert by[503].languages == "aa,bb" and 0 <= by[503].score <= 1
    for k, _, _ in rows[:240]:
        assert by[k].lang_pred == ("aa", "bb")[k % 2] and by[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
    assert by[None].held_out is None
    assert language_mix.identify_documents(no_docs).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_mix.identify_documents(unlabelled).first().lang_pred == "und"


def test_language_sets_up_to_all_languages():
    """Documents that mix one to five of five languages in equal parts get just these."""
    kinds = ["ka lo mi ne ru sa", "schu ger ung zwe ick", "twi yax opp quu jez", "ça vé hâb fûd gôn", "ñan dxi cło bźu przy"]
    r = __import__("random").Random(4)
    text = lambda k: " ".join("".join(r.choice(kinds[k].split()) for _ in range(3)) for _ in range(400))
    counts = [np.bincount(language_mix.grams(pa.array([text(k) for _ in range(5)]))[0], minlength=1 << language_mix.BUCKET_BITS) for k in range(5)]
    table = np.stack(counts, 1) + language_mix.SMOOTHING
    model = language_mix.LanguageModel(tuple("abcde"), table / table.sum(0))
    chosen = language_mix.infer(model, pa.array([" ".join(text(k) for k in range(n)) for n in range(1, 6)]))[1]
    assert [np.flatnonzero(x > 0).tolist() for x in chosen] == [list(range(n)) for n in range(1, 6)]


def plain_mixture(counts, chances, allowed):
    """Expectation-maximisation of one document by plain loops: proportions and log-likelihood."""
    share = {k: 1 / len(allowed) for k in allowed}
    for _ in range(language_mix.ROUNDS):
        taken = dict.fromkeys(allowed, 0.0)
        for bucket, n in counts.items():
            whole = sum(share[k] * chances[bucket][k] for k in allowed)
            for k in allowed:
                taken[k] += n * share[k] * chances[bucket][k] / whole
        share = {k: x / sum(counts.values()) for k, x in taken.items()}
    return share, sum(n * math.log(sum(share[k] * chances[b][k] for k in allowed)) for b, n in counts.items())


def test_inference_equals_plain_em():
    """Proportions and chosen sets of short, long and mixed texts, in one batch, next to one document at a time."""
    kinds = ["ka lo mi ne ru sa", "schu ger ung zwe ick", "twi yax opp quu jez"]
    r = random.Random(12)
    text = lambda k, n: " ".join("".join(r.choice(kinds[k].split()) for _ in range(3)) for _ in range(n))
    seen = np.stack([np.bincount(language_mix.grams(pa.array([text(k, 300)]))[0], minlength=1 << language_mix.BUCKET_BITS) for k in range(3)], 1) + language_mix.SMOOTHING
    model = language_mix.LanguageModel(tuple("abc"), seen / seen.sum(0))
    texts = [text(0, 3), text(1, 40) + " " + text(2, 40), "", text(2, 1) + " xyz", " ".join(text(k, 60) for k in range(3)), "Q", text(1, 200) + " " + text(0, 5)]
    every, chosen = language_mix.infer(model, pa.array(texts))
    for row, t in enumerate(texts):
        counts = Counter(language_mix.grams(pa.array([t]))[0].tolist())
        if not counts:
            assert not every[row].any() and not chosen[row].any()
            continue
        share, most = plain_mixture(counts, model.chances, range(3))
        assert every[row] == pytest.approx([share[k] for k in range(3)], abs=1e-9)
        alone = [sum(n * math.log(model.chances[b][k]) for b, n in counts.items()) for k in range(3)]
        best, top = {max(range(3), key=lambda k: alone[k]): 1.0}, max(alone)
        cost = language_mix.PENALTY * math.log1p(sum(counts.values()))
        if most - cost > top:
            for size in (2, 3):
                part, fit = plain_mixture(counts, model.chances, sorted(range(3), key=lambda k: -share[k])[:size])
                if fit - cost * (size - 1) > top:
                    best, top = part, fit - cost * (size - 1)
        assert chosen[row] == pytest.approx([best.get(k, 0.0) for k in range(3)], abs=1e-9)
    assert [int((x > 0).sum()) for x in chosen] == [1, 2, 0, 1, 3, 0, int((chosen[6] > 0).sum())]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_nothing_to_do(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.near_components(docs).count() == len(rows)
    assert suffix_array.remove_repeats(docs).count() == len(rows)
    assert line_dedup.line_report(docs).count() == len(rows)
