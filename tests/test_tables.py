import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.functions.dates import last_thursday, next_thursday, parse_expiry
from tickloom.operators import components, contracts
from tickloom.operators.bars import dedupe_bars, merge_pages, resample
from tickloom.session import settle
from tickloom.sources import files


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_ticks_to_bars_keep_gaps(spark):
    ticks = spark.createDataFrame(
        [("a", 5, 10.0, 1.0), ("a", 0, 9.0, 2.0), ("a", 59, 8.0, 1.0), ("a", 200, 7.0, 4.0)], "symbol string, epoch long, price double, volume double"
    )
    assert values(resample(ticks, 60).select("epoch", "open", "high", "low", "close", "volume")) == [
        (0, 9.0, 10.0, 8.0, 8.0, 4.0),
        (180, 7.0, 7.0, 7.0, 7.0, 4.0),
    ]


def test_pages_and_copies(spark):
    schema = "symbol string, epoch long, close double"
    old = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], schema)
    new = spark.createDataFrame([("a", 2, 9.0), ("a", 3, 3.0)], schema)
    assert values(merge_pages(old, new).select("epoch", "close")) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    both = old.withColumn("n", F.lit(1)).unionByName(new.withColumn("n", F.lit(0)))
    assert values(dedupe_bars(both, ("n",)).select("epoch", "close")) == [(1, 1.0), (2, 9.0), (3, 3.0)]


@pytest.mark.parametrize(
    "text,ref,rule,want",
    [
        ("16-Jan", "2025-12-20", "season", "2026-01-16"),
        ("30-Dec", "2026-01-05", "season", "2025-12-30"),
        ("16-Jan", "2025-12-20", "reference", "2025-01-16"),
        ("16-Jan", "2025-12-20", "half_year", "2026-01-16"),
        ("16-Oct", "2025-12-20", "half_year", "2025-10-16"),
        ("29-Feb", "2023-03-01", "half_year", "2024-02-29"),
        ("Jan2026", "2020-01-01", "season", "2026-01-29"),
        ("2026-01-16", "2020-01-01", "season", "2026-01-16"),
        ("15-Jan-2026", "2020-01-01", "season", "2026-01-15"),
        ("31-Feb", "2025-01-01", "season", None),
        ("soon", "2025-01-01", "season", None),
    ],
)
def test_expiry_texts(spark, text, ref, rule, want):
    row = spark.createDataFrame([(text, dt.date.fromisoformat(ref))], "t string, r date")
    got = row.select(parse_expiry(F.col("t"), F.col("r"), rule)).first()[0]
    assert (got.isoformat() if got else None) == want


def test_thursdays(spark):
    at = lambda s: int(dt.datetime.fromisoformat(s + "+00:00").timestamp())
    rows = spark.createDataFrame([(at("2026-01-15T15:29:59"),), (at("2026-01-15T15:30:00"),), (at("2026-01-16T09:00:00"),)], "e long")
    got = [r[0].isoformat() for r in rows.select(next_thursday(F.col("e"))).collect()]
    assert got == ["2026-01-15", "2026-01-22", "2026-01-22"]
    ends = spark.createDataFrame([(dt.date(2026, m, 5),) for m in (1, 4, 12)], "d date").select(last_thursday(F.col("d"))).collect()
    assert [r[0].isoformat() for r in ends] == ["2026-01-29", "2026-04-30", "2026-12-31"]


def test_contract_resolution_prefers_exact_then_first_partial(spark):
    master = spark.createDataFrame(
        [
            ("U-Jan2026-100-CE", "early", dt.date(2026, 1, 8), 0),
            ("U-Jan2026-100-CE", "late", dt.date(2026, 1, 29), 1),
            ("XU-Jan2026-200-CEQ", "second", dt.date(2026, 1, 29), 3),
            ("YU-Jan2026-200-CEQ", "first", dt.date(2026, 1, 29), 2),
        ],
        "trading_symbol string, security_id string, expiry date, position int",
    )
    keys = ["U-Jan2026-100-CE", "U-Jan2026-200-CE", "U-Feb2026-1-CE", "XU", None]
    asked = spark.createDataFrame([(k,) for k in keys], "contract_key string")
    got = {r["contract_key"]: (r["security_id"], r["match"]) for r in contracts.resolve(asked, master).collect()}
    assert got == {
        "U-Jan2026-100-CE": ("late", "exact"),
        "U-Jan2026-200-CE": ("first", "partial"),
        "U-Feb2026-1-CE": (None, None),
        "XU": ("second", "partial"),
        None: (None, None),
    }


def test_contract_is_used_up_by_the_first_exit(spark):
    rows = [
        (0, "Exit Long", None, None), (1, "Buy 1 CE (x)", 1, "c1"), (2, "note", None, None), (3, "Exit Long", None, None),
        (4, "Exit Long", None, None), (5, "Buy 2 CE (x)", 2, "c2"), (6, "Buy 3 CE (x)", 3, None), (7, "Exit Long", None, None),
    ]
    df = spark.createDataFrame([("a", *r) for r in rows], "symbol string, bar_index long, signal_label string, strike int, security_id string")
    got = {r["bar_index"]: r["active_contract"] for r in contracts.carry_contracts(df).collect()}
    assert got == {0: None, 1: "c1", 2: None, 3: "c1", 4: None, 5: "c2", 6: None, 7: "c2"}


def test_price_checks(spark):
    schema = "symbol string, epoch long, signal int, signal_price double, signal_label string"
    df = spark.createDataFrame([("a", 2, 1, None, "two"), ("a", 1, -1, 0.0, "one"), ("a", 0, 0, None, "hold"), ("a", 3, 1, 5.0, "ok")], schema)
    assert tuple(contracts.unpriced(df).first()) == (2, "one")
    with pytest.raises(Exception, match="without an option price"):
        contracts.assert_priced(df).collect()
    assert contracts.assert_priced(df.where("signal_price > 1")).count() == 1


def test_numbers_and_columns(spark):
    text = spark.createDataFrame([("1.5",), ("x",), (None,)], "close string")
    assert [r[0] for r in files.coerce_numeric(text).collect()] == [1.5, None, None]
    with pytest.raises(Exception, match="not a number"):
        files.coerce_numeric(text, strict=True).collect()
    with pytest.raises(ValueError, match="missing required"):
        files.validate_bars(text)
    assert files.standardize_columns(spark.range(1).selectExpr("1 O", "2 High", "3 c", "4 CLOSE")).columns == ["open", "high", "c", "close"]


def test_payload_arrays_of_other_lengths_are_ignored(spark):
    docs = [
        ("a", '{"open":[1,2],"high":[3],"close":[5,6],"timestamp":[10,20]}'),
        ("b", '{"status":"failure","close":[1],"timestamp":[1]}'),
        ("c", '{"open":[1]}'),
    ]
    rows = files.explode_payload(files.read_payloads(spark.createDataFrame(docs, "symbol string, payload string")))
    assert values(rows) == [("a", 10, 1.0, 5.0, 5.0, 5.0, 0.0), ("a", 20, 2.0, 6.0, 6.0, 6.0, 0.0)]


def test_sentences_and_categories(spark):
    text = "Buy at 45 degrees.  See e.g. Mr. Smith? The cycle is 90 days. nothing here"
    got = components.sentences(spark.createDataFrame([(1, text)], "doc long, text string"), ["doc"])
    assert [r["sentence"] for r in got.orderBy("position").collect()] == [
        "Buy at 45 degrees.", "See e.g. Mr. Smith?", "The cycle is 90 days.", "nothing here",
    ]
    found = components.components(got, ["doc"]).orderBy("component_id").collect()
    assert [(r["component_id"], r["logic_type"]) for r in found] == [("TXT_1_0", "GEOMETRY"), ("TXT_1_2", "TIME")]
    assert found[0]["parameters"].startswith("Found: ['") and "degrees" in found[0]["parameters"]


def test_settled_table_keeps_types(spark):
    df = spark.createDataFrame([(1, {"a": 1.0}, [dt.date(2020, 1, 1)])], "i int, m map<string,double>, d array<date>")
    out = settle(df.where("i > 5"))
    assert out.schema == df.schema and out.count() == 0
