"""Archives, embeddings, merge dropout, packing and the pipeline, against brute force or exact round trips."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import SCHEMA, edited, prose

import corpus_pipeline
from tickloom.llm import bpe, cross_polytope, merge_dropout, packing, warc
from tickloom.llm.queries import tokenizer_file
from tickloom.session import settle

PIECES, WORDS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")


def archived(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = page is not None and first[html or ""] != page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def test_archives(spark):
    mark = "WARC/1.1\r\n"
    fake = mark + "WARC-Type: response\r\nContent-Length: 3\r\nWARC-Record-ID: <urn:page:99>\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/", "x" * 50), (2, "http://a/ b\n", "x" * 50), (3, None, None), (4, "u", ""), (5, "u", fake + "tail" + fake * 3 + mark), (6, "u", mark), (7, "u", "\r\n\r\n" + fake)]
    rows += [(None, "u", "x" * 50), (8, "u", fake + "tail" + fake * 3 + mark), (9, "u", "é" * 4000), (10, "u", mark * 9 + "z"), (10, "u", mark * 9 + "z"), (-3, "u", "y"), (11, "u", "p"), (11, "u", "q"), (12, "u", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS block", "2 AS digest").coalesce(2)
    for size in ("128m", "2k"):
        before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        try:
            found = warc.archive_pages(pages).collect()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert sorted((tuple(r) for r in found), key=str) == archived(rows)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_embeddings(spark, monkeypatch):
    """Random vectors, hot groups over several blocks, odd ones; recall is measured on pairs near the bound."""
    monkeypatch.setattr(cross_polytope, "BLOCK", 16)
    r = np.random.default_rng(3)
    rows = []
    for group in range(12):
        middle = r.normal(size=24)
        for k in range(60 if group == 0 else 8):
            rows.append((len(rows) * 3, (middle + r.normal(size=24) * (0.05, 0.25, 0.33)[group % 3]).astype(np.float32).tolist(), group % 2))
    rows += [(5000, None, 0), (5001, [0.0] * 24, 0), (5002, [float("nan")] * 24, 0), (5003, [None] + [1.0] * 23, 0), (5004, [], 0), (5005, rows[0][1], None), (None, rows[0][1], 0), (5006, rows[0][1][:12], 0), (5007, [float("inf")] * 24, 0)]
    rows += [(5008, [1e30] * 24, 1), (5009, [1e-30] * 24, 1), rows[1], (6000, rows[2][1], 0)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS mark", "2 AS code", "3 AS dim")
    found = cross_polytope.near_vectors(docs).collect()
    assert len(found) == len(rows)
    fit = {(i, tuple(v), l): (i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if None not in (i, v, l) and v and None not in v and np.isfinite(v).all() and any(v)}
    fit = list(fit.values())
    links, pairs = defaultdict(int), 0
    up = {}
    for k, (i, v, l) in enumerate(fit):
        for j, w, m in fit[:k]:
            if l == m and len(v) == len(w) and (v / np.linalg.norm(v)) @ (w / np.linalg.norm(w)) >= 0.93:
                links[i] += 1
                links[j] += 1
                pairs += 1
                up.setdefault(i, set()).add(j)
                up.setdefault(j, set()).add(i)
    got = {r.vec_id: r for r in found}
    assert sum(r.n_links for r in {r.vec_id: r for r in found}.values()) / 2 >= 0.95 * pairs > 500
    assert all(got[i].n_links <= links[i] for i in got if i is not None)
    assert got[None].component_id is None and not got[None].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in (5000, 5001, 5002, 5003, 5004, 5005, 5006, 5007))
    assert got[5008].n_links == 1 and got[5009].component_id == 5008
    exact = {i for i in got if i is not None and got[i].n_links == links[i]}
    for i in exact & set(up):
        assert got[i].component_id <= min(up[i])
    assert cross_polytope.near_vectors(docs.limit(0)).count() == 0


def test_one_bucket_links_whole_components():
    """Chains and stars whose inner vectors have the largest ids, all in one bucket: what its edges reach against brute force."""
    r = np.random.default_rng(11)
    for trial in range(60):
        n = 3 + trial % 7
        plane = np.linalg.qr(r.normal(size=(8, 2)))[0]
        angles = np.radians(20) * np.arange(n) if trial % 2 else np.radians(r.uniform(0, 60 * n, 4 * n))
        vectors = np.stack([np.cos(angles), np.sin(angles)], 1) @ plane.T
        ids = r.permutation(len(vectors))
        if trial % 2:
            # the ends have the smallest ids
            ids = np.array([1, *range(n - 1, 1, -1), 0])
        batch = pa.table({
            "vec_id": ids, "mark": ids, "own": np.ones(len(ids), bool), "side": np.zeros(len(ids), np.int32), "copies": np.ones(len(ids), np.int64),
            **{c: np.zeros(len(ids), np.int64) for c in ("dim", "label", "t", "code", "i", "j")},
            "unit": pa.array(vectors.tolist()), "codes": pa.array(cross_polytope.codes(vectors).reshape(len(ids), -1).tolist()),
        }).to_batches()[0]
        edges = [(x["vec_id"], x["least"]) for out in cross_polytope._linked(93)(iter([batch])) for x in out.to_pylist()]
        near = [(a, b) for i, a in enumerate(ids.tolist()) for j, b in enumerate(ids.tolist()) if a != b and vectors[i] @ vectors[j] >= 0.93]
        assert reached(ids.tolist(), edges) == reached(ids.tolist(), near)


def reached(nodes, edges):
    least = {k: k for k in nodes}
    for _ in nodes:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_merges_alone_and_together_agree(monkeypatch):
    r = random.Random(5)
    merges = [(97, 98, 0, 300), (300, 97, 1, 301), (98, 97, 2, 302), (301, 302, 3, 303), (97, 97, 4, 304), (304, 304, 5, 305)]
    table = bpe.MergeTable.of(merges)
    words = [[r.choice((97, 98, 99)) for _ in range(r.randint(1, 30))] for _ in range(200)]
    begins = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    salts = np.arange(200).astype(np.uint64)
    for drop in (None, bpe.Dropout(0.3), bpe.Dropout(1.0)):
        monkeypatch.setattr(bpe, "LONG_WORD", 40)
        a = bpe.merged(np.concatenate(words), begins, table, drop, salts)
        monkeypatch.setattr(bpe, "LONG_WORD", 3)
        b = bpe.merged(np.concatenate(words), begins, table, drop, salts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert a[0].tolist() == [x for w in words for x in w]


ODD_TEXTS = ["", " ", "  two  blanks ", "tab\tnew\n\nline", "▁ literal ▁x", "日本語テキスト 🎉 ok", "é" * 50 + " " + "x" * 90, "It's we'll DON'T 's", "<|endoftext|> x", "ÉCOLE Straße ×÷ ñÑ naïve", "nbsp \x01ctl 100%...", "a1b22 c-d--e…", "é combining"]


def test_merge_dropout(spark, odd_docs, odd_rows, no_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = merge_dropout.load_model(PIECES)
    texts = [*ODD_TEXTS, *(t or "" for _, t, *_ in odd_rows)]
    column, salts = pa.array(texts), np.arange(len(texts)).astype(np.uint64)
    ids, begins = merge_dropout.encode(model, column, salts, 0.0)
    for k, text in enumerate(texts):
        if "▁" not in text:
            assert ids[begins[k] : begins[k + 1]].tolist() == library.encode(text)
    plain = len(ids)
    for chance in (0.1, 0.5, 1.0):
        ids, begins = merge_dropout.encode(model, column, salts, chance)
        assert [x.decode() for x in merge_dropout.decode(model, ids, begins)] == texts
        assert len(ids) > plain
    once, again, other = (merge_dropout.encode_documents(odd_docs, PIECES, seed=s, with_ids=True).collect() for s in (1, 1, 2))
    assert sorted(map(str, once)) == sorted(map(str, again)) != sorted(map(str, other))
    assert all(r.lossless and len(r.ids) == r.n_pieces and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4")) for r in once) and len(once) == len(odd_rows)
    assert merge_dropout.encode_documents(no_docs, PIECES).count() == 0


def test_merge_dropout_has_no_fixed_pool():
    """Every occurrence, document and seed has segmentations of its own, and merges are skipped with the given chance."""
    model = merge_dropout.load_model(PIECES)
    column = pa.array([" ".join(["international"] * 300)] * 2)
    pools = []
    for seed in (1, 2):
        ids, begins = merge_dropout.encode(model, column, merge_dropout.document_salts(np.array([5, 6]), seed), 0.3)
        ends = np.cumsum(np.diff(model.piece_begins)[ids])
        words = np.concatenate(([0], np.flatnonzero(ends % len(" international") == 0) + 1))
        own = [tuple(ids[a:b].tolist()) for a, b in zip(words[:-1], words[1:], strict=True)]
        assert len(own) == 600 and own[:300] != own[300:]
        pools.append(own)
    assert all(len(set(own)) > 30 for own in pools) and len(set(pools[0]) ^ set(pools[1])) > 8
    two = pa.array([" ".join(["th"] * 4000)])
    ids, _ = merge_dropout.encode(model, two, np.array([3], np.uint64), 0.1)
    whole, _ = merge_dropout.encode(model, two, np.array([3], np.uint64), 0.0)
    assert len(whole) == 4000 and 4200 < len(ids) < 4900


def test_packing(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    ids, begins = packing.tokenize(WORDS, pa.array(ODD_TEXTS))
    for k, text in enumerate(ODD_TEXTS):
        assert ids[begins[k] : begins[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    rows = odd_docs.select("doc_id", "text").collect()
    found = packing.pack(odd_docs, WORDS).collect()
    whole = defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID], "<u4"))
    for doc, own in whole.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found if r.doc_id == doc)
        assert sum(p[1] for p in pieces) == sum(map(len, own))
        for start, length, crc, total in pieces:
            assert any(len(x) == total and zlib.crc32(x[start : start + length]) == crc for x in own)
        if len(own) == 1:
            assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1].tolist()]
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        size = sum(n for _, n in own)
        assert size <= packing.WINDOW and size & (size - 1) == 0
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()]
    assert packing.pack(no_docs, WORDS).count() == 0


@pytest.mark.parametrize("most", [packing.KNOWN_UNITS, 5, 0])
def test_units_met_before_are_not_merged_again(monkeypatch, most):
    """A later batch merges its new units only, with the library's ids; also when there is no room for all units."""
    from tokenizers import Tokenizer

    merged, library = [], Tokenizer.from_file(WORDS)
    monkeypatch.setattr(packing, "KNOWN_UNITS", most)
    monkeypatch.setattr(packing, "_spelled", {})
    monkeypatch.setattr(packing, "merged", lambda symbols, begins, table: merged.append(len(begins) - 1) or bpe.merged(symbols, begins, table))
    long = "q" * 300 + " x" + "yz" * 90
    batches = [["the old mill, the mill", "Ünder it's 47 café", None, long], ["an old MILL 4 it's", "", long], ["the old mill", "Ünder 7"], ["", None], ["日本 the 日本", "old"]]
    for texts in batches:
        ids, begins = packing.tokenize(WORDS, pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[begins[k] : begins[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids
        for known in packing._spelled.values():
            assert len(known.prints) <= most
    if most > 5:
        # "an" and the two words of too many ids; "7" was met as a digit of 47
        assert merged[1:] == [3, 0, 0]


def test_packing_prefers_lexical_neighbours():
    have = np.ones(100, np.int64)
    docs = [[k, np.array([10 + k % 3, 20 + k % 3, 50 + k, 2], np.uint16), 0] for k in range(12)]
    shard = packing._Shard(docs, have, 12, 4.0)
    assert {docs[k][0] % 3 for k in list(shard.neighbours(0))[:4]} == {0}


def test_pipeline(spark):
    """Each stage against its operator's rule, on its own input."""
    rows = [(k, prose(k, 150), "en" if k % 2 else "de", "s", 1) for k in range(20)]
    passage = prose(500, 80).replace("\n", " ")
    rows += [(100 + k, prose(200 + k, 90) + "\n" + passage + f" tail {k} of its own " + prose(300 + k, 24), "en", "s", 1) for k in range(3)]
    rows += [(200, rows[3][1], "en", "s", 1), (201, edited(rows[4][1], 1, 3).replace("\n", " "), "de", "s", 1), (202, None, "en", "s", 1), (203, "12 !?", "en", "s", 1), (204, rows[6][1].replace("\n", " "), None, "s", 1), (None, prose(900), "en", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, ""))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept[name] = {r.doc_id: r for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in kept[name].values())
    ids = {i for i, *_ in rows}
    assert set(kept["language_id"]) == ids - {202, 203} and kept["language_id"][204].lang is not None
    assert set(kept["line_dedup"]) == ids - {200, 202, 203}
    assert set(kept["near_duplicates"]) == ids - {200, 201, 202, 203, 204}
    assert set(kept["repeated_passages"]) == set(kept["near_duplicates"])
    assert passage in kept["repeated_passages"][100].text
    assert all(passage[60:-60] not in kept["repeated_passages"][k].text and f"{k - 100} of its own" in kept["repeated_passages"][k].text for k in (101, 102))
    assert all(kept["repeated_passages"][k].text == rows[k][1] for k in range(20))
    assert {r.doc_id for r in docs.collect()} == set(kept["repeated_passages"])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_stage(spark, no_docs, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, no_docs, "").count() == 0


def test_every_record_has_a_date(spark, tmp_path):
    """The mandatory date of WARC 1.1, the same for all records of a call, and as given."""
    pages = spark.createDataFrame([(k, f"http://x/{k}", "<p>same</p>" if k % 2 else f"<p>{k}</p>") for k in range(6)], "page_id long, url string, html string")
    for name, date in (("now", None), ("then", "2024-01-31T12:00:00Z")):
        warc.write_archives(pages, str(tmp_path / name), date=date)
        text = "".join(p.read_text() for p in sorted((tmp_path / name).iterdir()) if not p.name.startswith((".", "_")))
        dates = re.findall(r"^WARC-Date: (\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ)\r?$", text, re.M)
        assert len(dates) == text.count("WARC-Record-ID") == 6 and len(set(dates)) == 1 and date in (None, dates[0])


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """Copies count as links of each other and of what is near them, but only one of them is coded and compared."""
    r = np.random.default_rng(3)
    one, other = r.normal(size=64), r.normal(size=64)
    near = one + 0.05 * r.normal(size=64)
    rows = [(k + 10, one.tolist(), 1) for k in range(700)] + [(5, near.tolist(), 1), (6, near.tolist(), 1), (7, other.tolist(), 1), (8, one.tolist(), 2), (9, [0.0] * 64, 1), (4, [0.0] * 64, 1)]
    rows += [rows[0], (None, one.tolist(), 1)]
    seen = []
    kept = cross_polytope.settle
    monkeypatch.setattr(cross_polytope, "settle", lambda df: seen.append(kept(df)) or seen[-1])
    found = {x.vec_id: x for x in cross_polytope.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect() if x.vec_id is not None}
    assert seen[0].count() == 4
    assert all((found[k + 10].n_links, found[k + 10].component_id) == (701, 5) for k in range(700))
    assert [(found[k].n_links, found[k].component_id, found[k].kept) for k in (5, 6, 7, 8, 9, 4)] == [(701, 5, True), (701, 5, False), (0, 7, True), (0, 8, True), (0, 9, True), (0, 4, True)]
