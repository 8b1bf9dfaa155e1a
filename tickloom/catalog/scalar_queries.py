"""Scalar functions: labels, dates, strikes, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import inputs
from tickloom.catalog.inputs import HOURLY_SQL, table
from tickloom.catalog.registry import query, with_sql
from tickloom.functions import dates as D, labels as LB
from tickloom.operators import contracts as C


def labelled(spark, sf):
    """Orders with signal labels of four kinds."""
    i = F.col("o_orderkey") % 4
    day = F.col("o_orderdate").cast("date")
    strike = F.bround(F.col("o_totalprice") / 50).cast("long") * 50
    bought = lambda kind: LB.entry_label(
        strike.cast("string"), F.lit(kind), D.expiry_text(F.date_add(day, 7)), F.floor("o_totalprice").cast("string")
    )
    label = F.when(i == 0, bought("CE")).when(i == 1, bought("PE")).when(i == 2, "Exit Long (EMA Touch)").otherwise("Exit Short (EMA Touch)")
    return table(spark, sf, "orders").select("o_orderkey", day.alias("day"), label.alias("label"))


LABELS_SQL = """lb AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 4 WHEN 2 THEN 'Exit Long (EMA Touch)' WHEN 3 THEN 'Exit Short (EMA Touch)'
  ELSE 'Buy ' || CAST(CAST(round_even(o_totalprice / 50, 0) AS BIGINT) * 50 AS VARCHAR) || CASE o_orderkey % 4 WHEN 0 THEN ' CE (' ELSE ' PE (' END
       || strftime(CAST(o_orderdate AS DATE) + 7, '%d-%b') || ') | SL:' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS label FROM orders)"""


@query("x2_labels", with_sql(LABELS_SQL, "SELECT o_orderkey, label FROM lb"))
def x2_labels(spark, sf):
    return labelled(spark, sf).select("o_orderkey", "label")


@query(
    "x1_parse_labels",
    with_sql(
        LABELS_SQL,
        """SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(label, '(\\d+)\\s+(CE|PE)\\s+\\(([^)]+)\\)', 1), '') AS INTEGER) AS strike,
       nullif(regexp_extract(label, '(\\d+)\\s+(CE|PE)\\s+\\(([^)]+)\\)', 2), '') AS option_type,
       nullif(regexp_extract(label, '(\\d+)\\s+(CE|PE)\\s+\\(([^)]+)\\)', 3), '') AS expiry_text FROM lb""",
    ),
)
def x1_parse_labels(spark, sf):
    return labelled(spark, sf).withColumns(LB.parse_contract(F.col("label"))).drop("day", "label")


@query(
    "x3_classify_labels",
    with_sql(
        LABELS_SQL,
        """SELECT o_orderkey, o_orderkey % 4 < 2 AS is_entry, o_orderkey % 4 >= 2 AS is_exit, o_orderkey % 4 = 0 AS is_long_entry,
       o_orderkey % 4 = 1 AS is_short_entry, contains(label, 'Exit') AND contains(label, 'Long') AS is_long_exit,
       contains(label, 'Exit') AND contains(label, 'Short') AS is_short_exit FROM lb""",
    ),
)
def x3_classify_labels(spark, sf):
    return labelled(spark, sf).withColumns(LB.classify(F.col("label"))).drop("day", "label")


def expiry_texts(spark, sf):
    i = F.col("o_orderkey") % 4
    day = F.col("o_orderdate").cast("date")
    target = F.date_add(day, (F.col("o_orderkey") % 150 - 30).cast("int"))
    text = (
        F.when(i == 0, F.date_format(target, "yyyy-MM-dd"))
        .when(i == 1, F.date_format(target, "MMMyyyy"))
        .when(i == 2, F.date_format(target, "d-MMM"))
        .otherwise(F.date_format(target, "dd-MMM"))
    )
    return table(spark, sf, "orders").select("o_orderkey", day.alias("reference"), text.alias("text"))


EXPIRY_SQL = """tx AS (SELECT o_orderkey, o_orderkey % 4 AS i, CAST(o_orderdate AS DATE) AS ref, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 150 - 30 AS INTEGER) AS t FROM orders),
mo AS (SELECT *, last_day(t) - CAST((isodow(last_day(t)) + 3) % 7 AS INTEGER) AS lastthu, month(t) AS m, day(t) AS d, year(ref) AS y, month(ref) AS rm FROM tx),
ys AS (SELECT *, y + CASE WHEN rm >= 11 AND m <= 2 THEN 1 WHEN rm <= 2 AND m >= 11 THEN -1 ELSE 0 END AS ya FROM mo),
ok AS (SELECT *, TRY_CAST(lpad(CAST(ya AS VARCHAR), 4, '0') || '-' || m || '-' || d AS DATE) AS sea, TRY_CAST(y || '-' || m || '-' || d AS DATE) AS cur,
              TRY_CAST((y + 1) || '-' || m || '-' || d AS DATE) AS nxt FROM ys)"""


@query(
    "x4_expiry_dates",
    with_sql(
        EXPIRY_SQL,
        """SELECT o_orderkey,
  strftime(CASE i WHEN 0 THEN t WHEN 1 THEN lastthu ELSE sea END, '%Y-%m-%d') AS season,
  strftime(CASE i WHEN 0 THEN t WHEN 1 THEN lastthu ELSE CASE WHEN cur IS NULL OR ref - cur > 180 THEN nxt ELSE cur END END, '%Y-%m-%d') AS half_year,
  strftime(CASE i WHEN 0 THEN t WHEN 1 THEN lastthu ELSE coalesce(cur, nxt) END, '%Y-%m-%d') AS reference FROM ok""",
    ),
)
def x4_expiry_dates(spark, sf):
    rules = ("season", "half_year", "reference")
    texts = expiry_texts(spark, sf)
    return texts.select("o_orderkey", *[D.parse_expiry(F.col("text"), F.col("reference"), r).cast("string").alias(r) for r in rules])


@query(
    "x5_last_thursday",
    """SELECT o_orderkey, strftime(last_day(o_orderdate) - CAST((isodow(last_day(o_orderdate)) + 3) % 7 AS INTEGER), '%Y-%m-%d') AS last_thursday FROM orders""",
)
def x5_last_thursday(spark, sf):
    day = D.last_thursday(F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", day.cast("string").alias("last_thursday"))


@query(
    "x6_next_thursday",
    """SELECT event_id, strftime(CAST(ts AS DATE) + CAST((4 - isodow(ts) + 7) % 7 + CASE WHEN isodow(ts) = 4 AND hour(ts) * 60 + minute(ts) >= 930 THEN 7 ELSE 0 END AS INTEGER), '%d-%b') AS expiry FROM events""",
)
def x6_next_thursday(spark, sf):
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", D.expiry_text(D.next_thursday(epoch)).alias("expiry"))


@query(
    "x7_atm_strike",
    "SELECT o_orderkey, CAST(round_even(o_totalprice / 50, 0) AS BIGINT) * 50 AS strike_50, CAST(round_even(floor(o_totalprice) / 2, 0) AS BIGINT) * 2 AS strike_2 FROM orders",
)
def x7_atm_strike(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", C.atm_strike(price, 50).alias("strike_50"), C.atm_strike(F.floor(price), 2).alias("strike_2")
    )


@query(
    "t3_expiry_thursdays",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s FROM orders),
a AS (SELECT *, s - 7 + CAST((4 - isodow(s - 7) + 7) % 7 AS INTEGER) AS f FROM o),
b AS (SELECT *, s - 14 + CAST((4 - isodow(s - 14) + 7) % 7 AS INTEGER) AS g FROM a)
SELECT o_orderkey, [strftime(f, '%Y-%m-%d'), strftime(f + 7, '%Y-%m-%d')] AS nearest,
       list_transform(generate_series(CAST(g AS TIMESTAMP), CAST(s + 44 AS TIMESTAMP), INTERVAL 7 DAY), lambda x : strftime(x, '%Y-%m-%d')) AS around FROM b""",
)
def t3_expiry_thursdays(spark, sf):
    day = F.col("o_orderdate").cast("date")
    text = lambda dates: F.transform(dates, lambda d: d.cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        text(C.nearest_expiries(day)).alias("nearest"),
        text(C.thursdays(F.date_sub(day, 14), F.date_add(day, 44))).alias("around"),
    )


LADDER_SQL = (
    HOURLY_SQL
    + """, rq AS (SELECT symbol, max(close) AS price, max(CAST(make_timestamp(epoch * 1000000) AS DATE)) AS d FROM bars GROUP BY symbol),
fx AS (SELECT *, d - 7 + CAST((4 - isodow(d - 7) + 7) % 7 AS INTEGER) AS f FROM rq),
ld AS (SELECT symbol, CAST(round_even(price / 5, 0) AS BIGINT) * 5 + k * 5 AS strike, option_type, f + CAST(e AS INTEGER) AS expiry
       FROM fx, range(-6, 7) r(k), (VALUES ('CE'), ('PE')) o(option_type), (VALUES (0), (7)) x(e))"""
)


def ladder(spark, sf):
    asked = (
        inputs.hourly(spark, sf)
        .groupBy("symbol")
        .agg(F.max("close").alias("price"), F.max(D.day_of(F.col("epoch"))).alias("day"))
        .withColumn("expiries", C.nearest_expiries(F.col("day")))
    )
    return C.strike_ladder(asked, "price", 5, 30, "expiries")


@query("x8_strike_ladder", with_sql(LADDER_SQL, "SELECT symbol, strike, option_type, strftime(expiry, '%Y-%m-%d') AS expiry FROM ld"))
def x8_strike_ladder(spark, sf):
    return ladder(spark, sf).select("symbol", "strike", "option_type", F.col("expiry").cast("string").alias("expiry"))


@query(
    "x9_contract_keys",
    with_sql(
        LADDER_SQL,
        """SELECT concat_ws('-', symbol, strftime(expiry, '%b%Y'), strike, option_type) AS monthly,
       concat_ws(' ', upper(symbol), upper(strftime(expiry, '%d %b %Y')), strike, option_type) AS dated FROM ld""",
    ),
)
def x9_contract_keys(spark, sf):
    parts = (F.col("symbol"), F.col("expiry"), F.col("strike"), F.col("option_type"))
    return ladder(spark, sf).select(C.monthly_key(*parts).alias("monthly"), C.dated_key(*parts).alias("dated"))


@query(
    "x18_flatten_details",
    """SELECT event_id, strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS datetime, json_extract_string(props, '$.k') AS detail_k,
       CASE WHEN event_id % 2 = 0 THEN event_type END AS detail_kind FROM events""",
)
def x18_flatten_details(spark, sf):
    from tickloom.sources.files import flatten_details

    k = F.get_json_object("props", "$.k")
    details = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), k, F.lit("kind"), F.col("event_type"))).otherwise(F.create_map(F.lit("k"), k))
    events = table(spark, sf, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"), details.alias("details"))
    return flatten_details(events, ["k", "kind"]).select("event_id", "datetime", "detail_k", "detail_kind")


@query(
    "x19_stable_ids",
    """SELECT event_id, concat_ws('_', 'pm', CAST(floor(epoch(ts)) AS BIGINT), event_type) AS marker_id,
       concat_ws('_', CAST(floor(epoch(ts)) AS BIGINT), user_id, event_type) AS pair_id FROM events""",
)
def x19_stable_ids(spark, sf):
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(
        "event_id",
        F.concat_ws("_", F.lit("pm"), epoch, "event_type").alias("marker_id"),
        F.concat_ws("_", epoch, "user_id", "event_type").alias("pair_id"),
    )
