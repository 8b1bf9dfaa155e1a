"""Cases a past review found wrong: mixed EMA spans, repeated requests, filters before a limit, numbers as text, contract candidates."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.functions.dates import month_number
from tickloom.functions.labels import money
from tickloom.operators import components, contracts, ranges, search
from tickloom.operators.bars import with_bar_index
from tickloom.operators.indicators import ema
from tickloom.session import settle


def test_ema_of_mixed_spans(spark, small_blocks):
    """Spans of which the shortest sets the block, over many blocks and a move of many orders of magnitude."""
    values = np.concatenate((np.full(40, 1e200), 100 + np.cumsum(np.random.default_rng(1).normal(size=900))))
    rows = [(s, k, float(v)) for s in ("a", "b") for k, v in enumerate(values)]
    bars = with_bar_index(spark.createDataFrame(rows, "symbol string, epoch long, close double"))
    spans = {f"e{n}": n for n in (1, 2, 5, 50, 200)}
    found = ema(bars, spans).where("symbol = 'b'").orderBy("epoch").toPandas()
    assert len(found) == len(values)
    for name, n in spans.items():
        want = pd.Series(values).ewm(span=n, adjust=False).mean()
        assert np.allclose(found[name], want, rtol=1e-9), name


def test_equal_requests_stay_rows(spark):
    bars = spark.createDataFrame([("s", k, 1.0) for k in range(10)], "symbol string, epoch long, close double")
    asked = spark.createDataFrame([("s", 2, 5), ("s", 2, 5), ("t", 0, 9)], "symbol string, start long, end long")
    assert sorted((r.symbol, r.bars) for r in ranges.range_status(asked, bars).collect()) == [("s", 4), ("s", 4), ("t", 0)]


def test_search_filters_before_its_limit(spark):
    rows = [(f"RED RING {k}", "EQUITY" if k < 30 else "INDEX", k, "d", f"i{k}") for k in range(55)]
    found = search.search(spark.createDataFrame(rows, "search_symbol string, instrument_name string, position long, description string, security_id string"), "red", "index")
    assert [r.position for r in found.collect()] == list(range(30, 50))


def test_parameters_are_numbers(spark):
    rows = [("MECHANICAL", "7 days or 07 days"), ("TIME", "cycle of 010 weeks, 10 weeks"), ("GEOMETRY", "045 degrees and 45 degrees, 400 degrees")]
    found = components.extract_parameters(spark.createDataFrame(rows, "logic_type string, definition string")).collect()
    assert sorted((r.kind, r.value, r.mentions) for r in found) == [("angle", "45", 2), ("cycle", "10 weeks", 2), ("time_period", "7", 2)]


def test_contract_candidates_use_rare_characters(spark):
    """Keys of one underlying share their beginning; each still finds the first symbol that contains it."""
    instruments = spark.createDataFrame([(f"NIFTY-Jan2024-{k}-CE-W", f"id{k}", "2024-01-25", k) for k in range(1000, 1080)], "trading_symbol string, security_id string, expiry string, position long")
    keys = [f"NIFTY-Jan2024-{k}-CE" for k in range(1000, 1090)] + ["1003", "", "NIFTY"]
    asked = spark.createDataFrame([(k,) for k in keys], "contract_key string")
    found = {r.contract_key: r.security_id for r in contracts.resolve(asked, instruments).collect()}
    assert found == {k: next((f"id{n}" for n in range(1000, 1080) if k and k in f"NIFTY-Jan2024-{n}-CE-W"), None) for k in keys}


def test_month_names(spark):
    names = ["Jan", "february", "SEP", "dec", "Foo", "Ja", ""]
    found = spark.createDataFrame([(n,) for n in names], "n string").select(F.struct("n", month_number(F.col("n")).alias("m")).alias("x")).collect()
    assert {r.x.n: r.x.m for r in found} == {"Jan": 1, "february": 2, "SEP": 9, "dec": 12, "Foo": None, "Ja": None, "": None}


def test_money_is_the_binary_value(spark):
    values = [2.675, 2.665, 0.125, 0.375, -1.005, 1234567.891, 0.0, -0.001, 1e15 / 7]
    found = [r.m for r in spark.createDataFrame([(v,) for v in values], "v double").select(money(F.col("v")).alias("m")).collect()]
    assert found == [f"{v:.2f}" for v in values]


def test_requests_equal_single_searches(spark):
    """A table of requests gives what each request gives alone; odd ones among them."""
    rows = [(f"{a} {b}{k}", "EQUITY" if k % 3 else "INDEX", (7 * k) % 60, f"{b} of {a}", f"i{k}", f"{a} {b}{k}".title(), f"X{k % 2}", "stock" if k % 3 else "index") for k, (a, b) in enumerate([("RED", "RING"), ("BLUE", "ROD"), ("OPT", "Ä")] * 20)]
    rows += [("NIFTY 50", "INDEX", 99, "reserved", "n", "Nifty 50", "X0", "index")]
    instruments = settle(spark.createDataFrame(rows, "search_symbol string, instrument_name string, position long, description string, security_id string, name string, exchange string, type string"))
    asked = [("red", "all", False), ("r", "index", False), ("ri ng", "all", True), ("ng 3", "", True), ("", "stock", False), ("   ", "all", True), ("zzz", "all", False), ("ä", "all", False), ("opt", "all", False), ("ed ring1", None, False), ("nifty", "all", False)]
    requests = spark.createDataFrame([(n, q, k, w) for n, (q, k, w) in enumerate(asked)], "request_id long, query string, kind string, all_words boolean")
    found = sorted((r.request_id, r.rank, r.security_id) for r in search.search_requests(instruments, requests, 7).collect())
    want = []
    for n, (q, k, w) in enumerate(asked):
        want += [(n, i + 1, r.security_id) for i, r in enumerate(search.search(instruments, q, k or "", 7, all_words=w).collect())]
    assert found == sorted(want)

    offered = search.favourites_requests(instruments, requests.where("NOT all_words"), 5).collect()
    want = [(n, r.symbol) for n, (q, k, w) in enumerate(asked) if not w for r in search.search_with_favourites(instruments, q, k or "", 5).collect()]
    assert sorted((r.request_id, r.symbol) for r in offered) == sorted(want)
    assert [r.symbol for r in sorted(offered, key=lambda r: r.rank) if r.request_id == 10] == ["NIFTY 50", "NIFTY OPTIONS"]
    assert [r.symbol for r in sorted(offered, key=lambda r: r.rank) if r.request_id == 8][0] == "NIFTY OPTIONS"

    asks = [("ri", "", ""), ("red", "X1", ""), ("o", "X0", "stock"), ("", "", "index"), ("of", None, None), ("zz", "", "")]
    ranked = spark.createDataFrame([(n, *a) for n, a in enumerate(asks)], "request_id long, query string, exchange string, kind string")
    found = sorted((r.request_id, r.rank, r.symbol, r.full_name, r.weight) for r in search.rank_requests(instruments, ranked, 9).collect())
    want = []
    for n, (q, e, k) in enumerate(asks):
        want += [(n, i + 1, r.symbol, r.full_name, r.weight) for i, r in enumerate(search.rank_search(instruments, q, e or "", k or "", 9).collect())]
    assert found == sorted(want)


def test_patterns_are_tried_once(spark):
    """The plan tests each of the patterns once per sentence, whatever is read from the result."""
    rows = settle(spark.createDataFrame([(1, 0, "buy at 45 degrees"), (2, 0, "nothing here"), (3, 1, "a square of 9 days")], "doc long, position int, sentence string"))
    found = components.components(rows, ["doc"])
    plan = found.where("logic_type <> 'x'").select("component_id", "logic_type", "parameters")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == sum(map(len, components.PATTERNS.values()))
    got = {r.component_id: (r.logic_type, r.parameters) for r in found.collect()}
    assert got == {"TXT_1_0": ("GEOMETRY", r"Found: ['\d+\s*degrees?', '45 deg']"), "TXT_3_1": ("MATH", "N/A")}


#: Instruments whose few names come again and again, some without a name or description.
_COPIED = "search_symbol string, instrument_name string, position long, description string, security_id string, name string, exchange string, type string"


def _copied(n: int) -> list[tuple]:
    names = ("Red Ring", "Blue Rod", "Old Ring", None)
    rows = []
    for k in range(n):
        name = names[k % 4]
        text = None if k % 10 == 9 else f"{'Ring' if k % 3 else 'Red'} maker"
        rows.append((name and name.upper(), "EQUITY" if k % 5 else "INDEX", (7 * k) % n, text, f"i{k}", name, f"X{k % 2}", "stock" if k % 5 else "index"))
    return rows


def _meetings(monkeypatch) -> list[int]:
    """How many pairs of a row and a request each search compares, noted as searches run."""
    noted, plain = [], search._candidates

    def met(*given):
        out = settle(plain(*given))
        noted.append(out.count())
        return out

    monkeypatch.setattr(search, "_candidates", met)
    return noted


def test_copies_of_a_name_meet_a_request_once(spark, monkeypatch):
    """rows that no request can tell apart are compared once, with equal requests answered once; ids that come twice get the hits of both."""
    noted, rows = _meetings(monkeypatch), _copied(400)
    asked = [(0, "ring", "all"), (1, "ring", "all"), (2, "d", "index"), (3, "", "stock"), (4, "old ring", None), (None, "blue", "all"), (5, "red", "all"), (5, "red", "all"), (5, "od", "index")]
    requests = spark.createDataFrame([(*a, False) for a in asked], "request_id long, query string, kind string, all_words boolean")
    found = search.search_requests(spark.createDataFrame(rows, _COPIED), requests, 7).collect()
    want = []
    for n in {a[0] for a in asked}:
        hits = [(r[2], r[4]) for i, q, k in asked if i == n for r in rows if r[0] is not None and q.upper() in r[0] and (k in (None, "all") or (k == "stock") == (r[1] == "EQUITY"))]
        want += [(str(n), rank, x) for rank, (_, x) in enumerate(sorted(hits)[:7], 1)]
    assert sorted((str(r.request_id), r.rank, r.security_id) for r in found) == sorted(want)
    assert noted[0] <= 7 * 6  # different requests, three names of two types


def test_long_lists_are_met_in_slices(spark, monkeypatch):
    """a run that many names share is cut into slices, and no hit is lost or doubled."""
    monkeypatch.setattr(search, "SLICE_ROWS", 8)
    rows = [(f"NAME {k:03d}", "INDEX", 300 - k, "d", f"i{k}", f"Name {k:03d}", "X", "index") for k in range(300)]
    asked = [(0, "name", 400), (1, "me 1", 400), (2, "99", 400), (3, "zz", 400)]
    requests = spark.createDataFrame([(n, q, "all", False) for n, q, _ in asked], "request_id long, query string, kind string, all_words boolean")
    found = search.search_requests(spark.createDataFrame(rows, _COPIED), requests, 400).collect()
    want = [(n, r[4]) for n, q, _ in asked for r in rows if q.upper() in r[0]]
    assert sorted((r.request_id, r.security_id) for r in found) == sorted(want)


def test_ranked_copies_meet_a_request_once(spark, monkeypatch):
    """the same for ranked requests, whose weight differs from request to request; names and descriptions may be missing."""
    noted, rows = _meetings(monkeypatch), _copied(400)
    asked = [(0, "ring", "", ""), (1, "red", "X1", None), (2, "r", None, "stock"), (3, "", "", "index"), (4, "maker", "", ""), (5, "ring", "", ""), (6, "zz", "", "")]
    requests = spark.createDataFrame(asked, "request_id long, query string, exchange string, kind string")
    found = search.rank_requests(spark.createDataFrame(rows, _COPIED), requests, 25).collect()
    want = []
    for n, q, exchange, kind in asked:
        hits = []
        for _, _, position, text, _, name, x, t in rows:
            at, below = (name or "").lower().find(q), (text or "").lower().find(q)
            if (at >= 0 and name or below >= 0 and text) and exchange in (None, "", x) and kind in (None, "", t):
                hits.append((0 if q == "" else at if at >= 0 and name else 8000 + below, position, str(name), str(text)))
        want += [(n, rank, w, name, text) for rank, (w, _, name, text) in enumerate(sorted(hits)[:25], 1)]
    assert sorted((r.request_id, r.rank, r.weight, str(r.symbol), str(r.description)) for r in found) == sorted(want)
    classes = len({(r[5], r[3], r[6], r[7]) for r in rows})
    assert noted[0] <= 6 * classes < 400


def test_favourites_beside_copies(spark, monkeypatch):
    """favourites first, then the first hits among many copies, each name compared once."""
    noted, rows = _meetings(monkeypatch), _copied(400)
    asked = [(0, "ring", "all"), (1, "opt", "all"), (2, "d", "stock"), (3, "", "index"), (4, "nifty", None), (5, "ring", "all")]
    requests = spark.createDataFrame(asked, "request_id long, query string, kind string")
    instruments = settle(spark.createDataFrame(rows, _COPIED))
    found = sorted((r.request_id, r.rank, r.symbol) for r in search.favourites_requests(instruments, requests, 6).collect())
    assert [x for n, _, x in found if n == 1] == ["NIFTY OPTIONS"] and [x for n, _, x in found if n == 4] == ["NIFTY 50", "NIFTY OPTIONS"]
    hits = {n: sorted((r[2], r[0]) for r in rows if r[0] and q.upper() in r[0] and (k in (None, "all") or (k == "stock") == (r[1] == "EQUITY")))[:6] for n, q, k in asked}
    offered = {1: ["NIFTY OPTIONS"], 3: ["NIFTY 50", "NIFTY OPTIONS"], 4: ["NIFTY 50", "NIFTY OPTIONS"]}
    assert found == sorted((n, rank, x) for n in hits for rank, x in enumerate([*offered.get(n, []), *[x for _, x in hits[n]]], 1))
    assert noted[0] <= 5 * 6


def _distinct_names(n: int) -> list[tuple]:
    return [(f"NAME {k:03d} OF MANY", "INDEX" if k % 2 else "EQUITY", (7 * k) % n, f"d{k % 3}", f"i{k}", f"Name {k:03d} of many", f"X{k % 2}", "index" if k % 2 else "stock") for k in range(n)]


def test_words_end_lists_at_their_first_names(spark, monkeypatch):
    """of names that do not repeat, a request of one word meets no more than its first rows per kind, however many share the word."""
    noted, rows = _meetings(monkeypatch), _distinct_names(300)
    instruments = settle(spark.createDataFrame(rows, _COPIED))
    asked = [(0, "name", "all"), (1, "many", "stock"), (2, "me 1", "index"), (3, "", None), (4, "name", "index"), (5, "299", "all"), (6, "opt", "all"), (7, "me 29", "")]
    requests = spark.createDataFrame(asked, "request_id long, query string, kind string")
    hits = {n: sorted((r[2], r[0]) for r in rows if q.upper() in r[0] and (k in (None, "", "all") or (k == "stock") == (r[1] == "EQUITY")))[:6] for n, q, k in asked}
    offered = {3: ["NIFTY 50", "NIFTY OPTIONS"], 6: ["NIFTY OPTIONS"]}
    want = sorted((n, rank, x) for n in hits for rank, x in enumerate([*offered.get(n, []), *[x for _, x in hits[n]]], 1))
    for words in (search.SENT_WORDS, 0):  # runs left out before and after they are ordered
        monkeypatch.setattr(search, "SENT_WORDS", words)
        found = search.favourites_requests(instruments, requests, 6).collect()
        assert sorted((r.request_id, r.rank, r.symbol) for r in found) == want
    assert max(noted) <= 8 * 2 * 6 and len(noted) == 2


def test_ranked_words_end_lists_by_weight(spark, monkeypatch):
    """ranked requests share the step; the first rows are those of the least weight, for each exchange and type asked for."""
    noted, rows = _meetings(monkeypatch), _distinct_names(300)
    asked = [(0, "of", "", ""), (1, "many", "X1", ""), (2, "0", "", "stock"), (3, "1", "X0", "stock"), (4, "1", "X0", "index"), (5, "d1", None, None), (6, "", "X1", "index")]
    requests = spark.createDataFrame(asked, "request_id long, query string, exchange string, kind string")
    found = search.rank_requests(spark.createDataFrame(rows, _COPIED), requests, 9).collect()
    want = []
    for n, q, exchange, kind in asked:
        hits = []
        for _, _, position, text, _, name, x, t in rows:
            at, below = name.lower().find(q), text.find(q)
            if (at >= 0 or below >= 0) and exchange in (None, "", x) and kind in (None, "", t):
                hits.append((at if at >= 0 else 8000 + below, position, name))
        want += [(n, rank, w, name) for rank, (w, _, name) in enumerate(sorted(hits)[:9], 1)]
    assert sorted((r.request_id, r.rank, r.weight, r.symbol) for r in found) == sorted(want)
    assert noted[0] <= 7 * 4 * 9


def test_slices_of_longer_requests(spark, monkeypatch):
    """Several words, and words longer than those looked up whole, still meet the list of their rarest run in slices."""
    monkeypatch.setattr(search, "SLICE_ROWS", 8)
    rows = _distinct_names(300)
    asked = [(0, "many name", True), (1, "name 12", True), (2, "of many", False), (3, "1 of many", False), (4, "name 299 of many", False), (5, "99 of xmany", False)]
    requests = spark.createDataFrame([(n, q, "all", w) for n, q, w in asked], "request_id long, query string, kind string, all_words boolean")
    for longest in (search.WORD, 3):
        monkeypatch.setattr(search, "WORD", longest)
        found = search.search_requests(spark.createDataFrame(rows, _COPIED), requests, 400).collect()
        want = [(n, r[4]) for n, q, w in asked for r in rows if all(x in r[0] for x in (q.upper().split() if w else [q.upper()]))]
        assert sorted((r.request_id, r.security_id) for r in found) == sorted(want)
