"""Divergence audit, hard negatives and byte-level BPE against brute force and the library itself, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import CLASHING, words
from pyspark.sql import functions as F

from tickloom.llm import packing
from tickloom.llm.byte_bpe import decode, encode, encode_bytes, load_vocabulary, stretches
from tickloom.llm.divergence import Transducer, divergence
from tickloom.llm.hard_negatives import Tree, hard_negatives, tile_order
from tickloom.llm.queries import tokenizer_file
from tickloom.llm.words import text_bytes

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids_of(texts):
    vocabulary = load_vocabulary(PATH)
    ids, begins = encode(vocabulary, *text_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)]


def test_bpe_equals_library(library):
    r = random.Random(5)
    bits = ["a", "b", "st", "t", "'", "'s", "'re", "'ll", "'d", " ", "  ", "\n", "\t", "1", "2²", "é", "日本", "!", "?!", "<|endoftext|>", "<|", "|>", " ", "　", "Ⅷ", "🎉", "́", "aaaa", "\r\n", "\x00", "\x85", "'v", "WE'LL"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    texts += ["", "a" * 300, "ab" * 900, " " * 700 + "x", "\n" * 300, "日本語" * 400, "=-" * 700 + "=" * 333, "<|endoftext|>" * 3, "'" * 50 + "s"]
    texts += ["".join(r.choice("etaoinshrdlu") for _ in range(9000)), "".join(r.choice("ab'\n .") for _ in range(9000))]
    assert ids_of(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_one_long_unit(library):
    """A piece of many blocks, in which merges must wait for lower ones beside them."""
    r = random.Random(8)
    text = "".join(r.choice(["the", "re", "in", "zq", "a", "an", "tion"]) for _ in range(60_000))
    assert ids_of([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_bpe_stretches(library):
    vocabulary = load_vocabulary(PATH)
    text = "One two  three\n\nfour <|endoftext|> five't 日本 " * 400 + "x" * 5000 + " end"
    cut = list(stretches(vocabulary, np.frombuffer(text.encode(), np.uint8), most=500))
    assert len(cut) > 10 and b"".join(c.tobytes() for c in cut).decode() == text
    ids = [k for c in cut for k in encode(vocabulary, c, np.array([0, len(c)]))[0].tolist()]
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert decode(vocabulary, np.array(ids)).decode() == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_of_odd_documents(spark, odd_docs, odd_rows, no_docs, library):
    found = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.lossless) for r in encode_bytes(odd_docs, PATH).collect() if r.doc_id is not None)
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        listed, back = ",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        if doc_id is not None:
            want.append((False, doc_id, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), True))
    assert found == sorted(want)
    assert encode_bytes(odd_docs, PATH).count() == len(odd_rows)
    assert encode_bytes(no_docs, PATH).collect() == []


def test_transducer_is_minimal():
    r = random.Random(3)
    for _ in range(60):
        terms = sorted({bytes(r.choice(b"abc") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 60))})
        built = Transducer(iter(terms))
        probes = terms + [bytes(r.choice(b"abcd") for _ in range(r.randint(0, 7))) for _ in range(40)]
        begins = np.concatenate(([0], np.cumsum([len(p) for p in probes])))
        assert built.ordinals(np.frombuffer(b"".join(probes), np.uint8), begins).tolist() == [terms.index(p) if p in terms else -1 for p in probes]
        right = {frozenset(t[k:] for t in terms if t.startswith(p)) for w in terms for k in range(len(w) + 1) for p in [w[:k]]}
        assert len(built.final) == max(1, len(right))


def test_transducer_of_a_very_long_term():
    long = b"k" * 200_000
    built = Transducer(iter([b"a", long, long + b"x"]))
    assert built.ordinals(np.frombuffer(long + long[1:] + long + b"x", np.uint8), np.array([0, 200_000, 399_999, 600_000])).tolist() == [1, -1, 2]
    with pytest.raises(ValueError):
        Transducer(iter([b"b", b"a"]))


def plain_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))) for _, text, lang, source, _ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= least}
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if t in kept) for s in {d[1] for d in docs if d[0] == lang}}
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept))
        whole = sum(counts.values(), Counter())
        for s, own in counts.items():
            apart = {o: sum((share(own, t) - share(c, t)) ** 2 // share(c, t) for t in kept) for o, c in counts.items() if o != s}
            use = {t: (share(own, t) - share(whole, t)) ** 2 // share(whole, t) for t in kept if own[t] and share(own, t) > share(whole, t)}
            for part, values, most in (("pair", apart, None), ("term", use, top)):
                order = sorted(values, key=lambda k: (-values[k], k.encode()))[:most]
                out |= {(lang, s, part, k, values[k], n + 1) for n, k in enumerate(order)}
    return out


def test_divergence_equals_brute_force(spark, odd_docs, odd_rows, no_docs):
    for least, top in ((3, 200), (1, 7), (10**6, 5)):
        found = [tuple(r) for r in divergence(odd_docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(found) == len(set(found)) and set(found) == plain_divergence(odd_rows, least, top)
    assert divergence(no_docs).collect() == []


def test_divergence_of_many_ranges(spark):
    """Terms of two languages over several ranges, slices with ties, and a source without terms."""
    r = random.Random(4)
    rows = [(k, " ".join(words(k % 90, 300)) + " Éaé zZ", ["x", "y"][k % 2], f"s{r.randrange(3)}", 0) for k in range(120)] + [(500, "1 2", "x", "none", 0), (501, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    found = [tuple(x) for x in divergence(docs, 3, 50).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found)) and set(found) == plain_divergence(rows, 3, 50)


def plain_negatives(rows, every, positives, negatives, low, high):
    fit = []
    for vec_id, x, label in {(a, None if b is None else tuple(b), c) for a, b, c in rows}:
        if vec_id is None or label is None or not x or any(v is None or not math.isfinite(v) or abs(v) > 1e6 for v in x):
            continue
        fit.append((vec_id, label, [math.floor(v * 256) for v in x]))
    score = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = []
    for a, own, x in fit:
        if a % every:
            continue
        same = [(k, label, score(x, y)) for k, label, y in fit if len(x) == len(y)]
        first = sorted(((s, k) for k, label, s in same if label == own and k != a), key=lambda p: (-p[0], p[1]))[:positives]
        for p, k in first:
            fits = sorted(((s, n) for n, label, s in same if label != own and low * p <= 100 * s <= high * p), key=lambda p: (-p[0], p[1]))[:negatives]
            out += [(a, k, rank + 1, n, p, s) for rank, (s, n) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("dim", [1, 3, 24])
def test_negatives_equal_brute_force(spark, dim):
    r = random.Random(dim)
    rows = [(k, [r.choice([0.0, r.gauss(0.2, 1), 0.5]) for _ in range(dim)], r.randrange(4)) for k in range(400)]
    # copies with other ids, odd vectors, another length, and rows that stand twice
    rows += [(1000 + k, rows[3][1], k % 2) for k in range(40)] + [(2000, [float("nan")] * dim, 1), (2001, [None] * dim, 1), (2002, None, 1), (2003, rows[5][1], None), (None, rows[5][1], 1)]
    rows += [(2004, [float("inf")] * dim, 1), (2005, [], 1), (2006, [1e30] * dim, 1), (2007, [0.0] * dim, 2), rows[0], rows[0], *[(3000 + k, [0.5] * (dim + 1), k % 2) for k in range(20)]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    table = table.withColumns({c: F.lit(1) for c in (*CLASHING, "codes", "dim", "shard", "window", "rank", "p", "score")})
    found = sorted(tuple(x) for x in hard_negatives(table, every=10).collect())
    assert found == plain_negatives(rows, 10, 5, 10, 30, 90) and found


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert hard_negatives(none).collect() == []


def test_large_components_are_exact(spark):
    """Scores beyond 2**53, where doubles would round."""
    rows = [(k, [1e5 + k * 0.01, 3e5 - k * 0.01], k % 2) for k in range(60)]
    found = sorted(tuple(x) for x in hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), every=10, high=100).collect())
    assert found == plain_negatives(rows, 10, 5, 10, 30, 100) and found


def test_search_leaves_out_boxes():
    """The first rows of a tree over separate clusters are found without opening most pages."""
    r = np.random.default_rng(1)
    points = np.concatenate([r.integers(-5, 6, (640, 4)) + 300 * center for center in r.integers(-3, 4, (20, 4))]).astype(np.int64)
    order = tile_order(points)
    pages = [(0, order[k : k + 64], points[order[k : k + 64]]) for k in range(0, len(order), 64)]
    tree, opened = Tree(pages), []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            opened.append(key)
            return np.ndarray.__getitem__(self, key)

    tree.floats = tree.floats.view(Watched)
    [(scores, ids)] = tree.search(points[7], 0, True, np.array([1 - 2**63]), np.array([2**63 - 1]), 5, 7)
    want = sorted(((-int(points[k] @ points[7]), k) for k in range(len(points)) if k != 7))[:5]
    assert [(-s, k) for s, k in zip(scores.tolist(), ids.tolist(), strict=True)] == want
    assert len(opened) < len(pages) / 4


def test_a_seed_goes_on_with_its_next_terms():
    """A seed whose rarest tokens stand alone finds the document that shares its other ones, far off in the shard's order."""
    size = 5000
    seed = np.array([*range(100, 160), 7, 8, 9], np.uint16)
    others = [np.arange(200 + 20 * k, 220 + 20 * k, dtype=np.uint16) for k in range(50)]
    docs = [[0, seed, 0], *[[1 + k, x, 0] for k, x in enumerate(others)], [99, np.array([9, 8, 7] * 5, np.uint16), 0]]
    have = np.bincount(np.concatenate([np.unique(x[1]) for x in docs]), minlength=size)
    shard = packing._Shard(docs, have, len(docs), 20.0)
    # the seed is used up first
    shard.left[0] = 0
    assert list(shard.neighbours(0)) == [len(docs) - 1]
    docs = [[k, x[1], 0] for k, x in enumerate(docs)]
    [first] = list(packing._filled(packing._Shard(docs, have, len(docs), 20.0), 1024))[:1]
    assert [k for k, _, _ in first][:2] == [0, len(docs) - 1]
