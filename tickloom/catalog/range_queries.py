"""Range filters, request rules, search and symbol rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import inputs
from tickloom.catalog.inputs import HOURLY_SQL, INDEXED_SQL, table
from tickloom.catalog.join_queries import INSTRUMENTS_SQL, NATION_SQL, order_trades, part_instruments
from tickloom.catalog.registry import query, with_sql
from tickloom.functions import tickers as T
from tickloom.operators import ranges as R, search as S
from tickloom.session import settle

TODAY = "1999-06-30"


def requests(spark, sf):
    """Orders as data requests: a day range, a resolution and a look-back."""
    names = F.array(*[F.lit(r) for r in ("1", "5", "15", "60", "D", "1W")])
    start = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        start.alias("start_day"),
        F.date_add(start, (F.col("o_orderkey") % 200).cast("int")).alias("end_day"),
        F.get(names, (F.col("o_orderkey") % 6).cast("int")).alias("resolution"),
        (F.col("o_orderkey") % 5000).alias("lookback_bars"),
    )


REQUESTS_SQL = """rq AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start_day, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INTEGER) AS end_day,
  ['1', '5', '15', '60', 'D', '1W'][CAST(o_orderkey % 6 AS INTEGER) + 1] AS resolution, o_orderkey % 5000 AS lookback_bars FROM orders)"""


def dates_as_text(df, *names):
    return df.withColumns({n: F.col(n).cast("string") for n in names})


@query(
    "f1_bars_between",
    with_sql(HOURLY_SQL, "SELECT symbol, epoch, close FROM bars WHERE epoch BETWEEN 1704844800 - 43200 AND 1705708800"),
)
def f1_bars_between(spark, sf):
    return R.bars_between(inputs.hourly(spark, sf), 1704844800, 1705708800, "D").select("symbol", "epoch", "close")


@query(
    "f2_bars_between_relaxed",
    with_sql(
        inputs.DAILY_SQL + ", mx AS (SELECT symbol, max(epoch) AS last, count(*) FILTER (epoch BETWEEN 1030000000 AND 1040000000) AS hits FROM bars GROUP BY 1)",
        """SELECT b.symbol, b.epoch, b.close FROM bars b JOIN mx ON mx.symbol = b.symbol
WHERE b.epoch BETWEEN 1030000000 AND 1040000000 OR (hits = 0 AND 1030000000 > last AND b.epoch <= 1040000000)""",
    ),
)
def f2_bars_between_relaxed(spark, sf):
    return R.bars_between_relaxed(settle(inputs.daily(spark, sf)), 1030000000, 1040000000).select("symbol", "epoch", "close")


@query(
    "f3_range_status",
    with_sql(
        NATION_SQL + ", rqs AS (SELECT o_orderkey, symbol, epoch - 400000 AS start, epoch AS stop FROM tr)",
        """SELECT r.o_orderkey, r.symbol, count(b.epoch) AS bars,
       CASE WHEN count(b.epoch) = 0 AND r.stop < 1262304000 THEN 'no_data' ELSE 'ok' END AS status
FROM rqs r LEFT JOIN bars b ON b.symbol = r.symbol AND b.epoch BETWEEN r.start AND r.stop GROUP BY r.o_orderkey, r.symbol, r.stop""",
    ),
)
def f3_range_status(spark, sf):
    from tickloom.catalog.join_queries import nation_bars

    asked = order_trades(spark, sf).select("o_orderkey", "symbol", (F.col("epoch") - 400000).alias("start"), F.col("epoch").alias("end"))
    return R.range_status(asked, settle(nation_bars(spark, sf))).select("o_orderkey", "symbol", "bars", "status")


@query(
    "f4_local_days",
    with_sql(
        HOURLY_SQL,
        "SELECT symbol, epoch, close FROM bars WHERE epoch BETWEEN 1704844800 - 19800 AND 1704844800 - 19800 + 3 * 86400 - 1",
    ),
)
def f4_local_days(spark, sf):
    return R.filter_local_days(inputs.hourly(spark, sf), "2024-01-10", "2024-01-12").select("symbol", "epoch", "close")


@query(
    "f5_normalize_range",
    with_sql(
        REQUESTS_SQL
        + """, a AS (SELECT *, end_day - CAST(greatest(isodow(end_day) - 5, 0) AS INTEGER) AS e0, start_day - CAST(greatest(isodow(start_day) - 5, 0) AS INTEGER) AS s0 FROM rq),
b AS (SELECT *, CASE WHEN e0 > DATE '1999-06-30' THEN DATE '1999-06-30' ELSE e0 END AS e1 FROM a)""",
        """SELECT o_orderkey, strftime(CASE WHEN s0 = e1 AND DATE '1999-06-30' - e1 <= 3 THEN s0 - 2 ELSE s0 END, '%Y-%m-%d') AS start_day,
       strftime(e1, '%Y-%m-%d') AS end_day FROM b""",
    ),
)
def f5_normalize_range(spark, sf):
    out = R.normalize_range(requests(spark, sf), F.lit(TODAY).cast("date"))
    return dates_as_text(out.select("o_orderkey", "start_day", "end_day"), "start_day", "end_day")


@query(
    "f6_expand_lookback",
    with_sql(
        REQUESTS_SQL
        + """, a AS (SELECT *, CASE resolution WHEN 'D' THEN lookback_bars WHEN '60' THEN greatest(1, lookback_bars // 6) WHEN '15' THEN greatest(1, lookback_bars // 25)
   WHEN '5' THEN greatest(1, lookback_bars // 75) ELSE greatest(1, lookback_bars // 375) END AS d FROM rq),
b AS (SELECT *, CAST(CASE WHEN lookback_bars > 0 THEN least(d * 4 + 30, 3650) ELSE 0 END AS INTEGER) AS lookback_days FROM a)""",
        "SELECT o_orderkey, lookback_days, strftime(start_day - lookback_days, '%Y-%m-%d') AS start_day FROM b",
    ),
)
def f6_expand_lookback(spark, sf):
    out = R.expand_lookback(requests(spark, sf)).select("o_orderkey", "lookback_days", "start_day")
    return dates_as_text(out, "start_day")


@query(
    "f7_chunk_ranges",
    with_sql(
        REQUESTS_SQL
        + """, ck AS (SELECT o_orderkey, end_day, unnest(generate_series(CAST(start_day AS TIMESTAMP), CAST(end_day AS TIMESTAMP), INTERVAL 81 DAY)) AS cs FROM rq)""",
        """SELECT o_orderkey, strftime(cs, '%Y-%m-%d %H:%M:%S') AS chunk_start,
       strftime(least(cs + INTERVAL 80 DAY, CAST(end_day AS TIMESTAMP)) + INTERVAL 930 MINUTE, '%Y-%m-%d %H:%M:%S') AS chunk_end FROM ck""",
    ),
)
def f7_chunk_ranges(spark, sf):
    asked = requests(spark, sf).select(
        "o_orderkey", F.col("start_day").cast("timestamp").alias("start_ts"), F.col("end_day").cast("timestamp").alias("end_ts")
    )
    out = R.chunk_ranges(asked).select("o_orderkey", "chunk_start", "chunk_end")
    return dates_as_text(out, "chunk_start", "chunk_end")


@query(
    "f8_clamp_history",
    with_sql(
        REQUESTS_SQL
        + """, a AS (SELECT *, CASE resolution WHEN '1' THEN 7 WHEN '5' THEN 60 WHEN '15' THEN 60 WHEN '60' THEN 700 ELSE 10000 END AS cap FROM rq),
b AS (SELECT *, CASE WHEN end_day - start_day > cap THEN end_day - CAST(cap AS INTEGER) ELSE start_day END AS s1 FROM a),
c AS (SELECT *, DATE '1999-06-30' - s1 AS age, CASE resolution WHEN '1' THEN 7 WHEN '5' THEN 60 WHEN '15' THEN 60 WHEN '60' THEN 700 ELSE 36500 END AS lim FROM b),
d AS (SELECT *, resolution = '1' AND age > lim AS coarser FROM c),
e AS (SELECT *, CASE WHEN coarser THEN 700 ELSE lim END AS lim2 FROM d)""",
        """SELECT o_orderkey, CASE WHEN coarser THEN '60' ELSE resolution END AS resolution,
       CASE CASE WHEN coarser THEN '60' ELSE resolution END WHEN '1' THEN '1m' WHEN '2' THEN '2m' WHEN '5' THEN '5m' WHEN '15' THEN '15m' WHEN '30' THEN '30m' WHEN '60' THEN '1h' WHEN '1H' THEN '1h'
         WHEN 'W' THEN '1wk' WHEN '1W' THEN '1wk' WHEN 'M' THEN '1mo' WHEN '1M' THEN '1mo' ELSE '1d' END AS interval,
       strftime(CASE WHEN age > lim2 THEN DATE '1999-06-30' - CAST(lim2 - 1 AS INTEGER) ELSE s1 END, '%Y-%m-%d') AS start_day FROM e""",
    ),
)
def f8_clamp_history(spark, sf):
    out = R.clamp_history(requests(spark, sf), F.lit(TODAY).cast("date")).select("o_orderkey", "resolution", "interval", "start_day")
    return dates_as_text(out, "start_day")


@query(
    "f9_substring_search",
    with_sql(
        INSTRUMENTS_SQL,
        """SELECT security_id, search_symbol FROM ins WHERE contains(search_symbol, 'RED') AND contains(search_symbol, 'RING')
  AND instrument_name <> 'EQUITY' ORDER BY position LIMIT 20""",
    ),
)
def f9_substring_search(spark, sf):
    out = S.search(part_instruments(spark, sf), "red ring", "index", all_words=True)
    return out.select("security_id", "search_symbol")


@query(
    "f10_t2_ranked_search",
    with_sql(
        INSTRUMENTS_SQL
        + ", w AS (SELECT *, instr(upper(name), 'RI') - 1 AS pn, instr(upper(description), 'RI') - 1 AS pd FROM ins)",
        """SELECT name AS symbol, exchange || ':' || name AS full_name, description, CASE WHEN pn >= 0 THEN pn ELSE 8000 + pd END AS weight
FROM w WHERE pn >= 0 OR pd >= 0 ORDER BY weight, position LIMIT 30""",
    ),
)
def f10_t2_ranked_search(spark, sf):
    return S.rank_search(part_instruments(spark, sf), "ri").select("symbol", "full_name", "description", "weight")


@query(
    "f11_instrument_lookup",
    with_sql(
        INSTRUMENTS_SQL,
        """SELECT security_id, CASE WHEN instrument_name = 'INDEX' THEN 'IDX_I' ELSE 'NSE_EQ' END AS segment, instrument_name AS instrument
FROM ins WHERE search_symbol = 'RED RING' ORDER BY position LIMIT 1""",
    ),
)
def f11_instrument_lookup(spark, sf):
    return S.lookup_instrument(part_instruments(spark, sf), "red ring").select("security_id", "segment", "instrument")


@query(
    "f12_visible_bars",
    with_sql(INDEXED_SQL, "SELECT symbol, epoch, close FROM ib WHERE epoch BETWEEN 1704844800 AND 1705708800 AND bar_index <= 300"),
)
def f12_visible_bars(spark, sf):
    return R.visible_bars(inputs.hourly_indexed(spark, sf), 1704844800, 1705708800, 300).select("symbol", "epoch", "close")


@query(
    "a5_expiries",
    with_sql(
        INSTRUMENTS_SQL,
        """SELECT DISTINCT strftime(expiry, '%Y-%m-%d') AS expiry FROM ins
WHERE starts_with(search_symbol, 'RED') AND NOT contains(search_symbol, 'BOLT') AND instrument_name = 'INDEX'""",
    ),
)
def a5_expiries(spark, sf):
    return S.expiries(part_instruments(spark, sf), "RED", ("BOLT",), "INDEX")


def symbols(spark, sf):
    """Part and customer names dressed as tickers of several markets."""
    i = F.col("p_partkey") % 6
    name = F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("")))
    ticker = (
        F.when(i == 0, F.concat(name, F.lit(".NS")))
        .when(i == 1, F.concat(name, F.lit(".BO")))
        .when(i == 2, F.concat(F.lit("^NSE"), name))
        .when(i == 3, F.concat(name, F.lit(":YF")))
        .when(i == 4, F.concat(F.lit("^"), name))
        .otherwise(name)
    )
    return table(spark, sf, "part").select("p_partkey", ticker.alias("symbol"))


SYMBOLS_SQL = """sy AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN n || '.NS' WHEN 1 THEN n || '.BO' WHEN 2 THEN '^NSE' || n WHEN 3 THEN n || ':YF'
   WHEN 4 THEN '^' || n ELSE n END AS symbol FROM (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS n FROM part)),
si AS (SELECT *, contains(symbol, '.NS') OR contains(symbol, '.BO') OR starts_with(symbol, '^NSE') AS home FROM sy)"""


@query(
    "p8_symbol_info",
    with_sql(
        SYMBOLS_SQL,
        """SELECT p_partkey, CASE WHEN home THEN 'Asia/Kolkata' ELSE 'America/New_York' END AS timezone,
  CASE WHEN home THEN '0915-1530' ELSE '0930-1600' END AS session,
  CASE WHEN starts_with(symbol, '^') THEN 'index' ELSE 'stock' END AS type,
  CASE WHEN contains(symbol, '.BO') THEN 'BSE' WHEN home THEN 'NSE' ELSE 'US' END AS exchange FROM si""",
    ),
)
def p8_symbol_info(spark, sf):
    info = T.symbol_info(F.col("symbol"))
    return symbols(spark, sf).withColumns(info).select("p_partkey", "timezone", "session", "type", "exchange")


@query(
    "f14_route_source",
    with_sql(
        SYMBOLS_SQL,
        """SELECT p_partkey, CASE WHEN p_partkey % 6 < 5 THEN 'yahoo' ELSE 'broker' END AS source, replace(symbol, ':YF', '') AS clean_symbol FROM si""",
    ),
)
def f14_route_source(spark, sf):
    return symbols(spark, sf).withColumns(T.route_source(F.col("symbol"))).select("p_partkey", "source", "clean_symbol")


@query(
    "p3_localize",
    """SELECT o_orderkey, CAST(epoch(timezone(CASE WHEN o_orderkey % 2 = 0 THEN 'Asia/Kolkata' ELSE 'America/New_York' END, o_orderdate + INTERVAL 10 HOUR)) AS BIGINT) AS epoch FROM orders""",
)
def p3_localize(spark, sf):
    zone = F.when(F.col("o_orderkey") % 2 == 0, T.INDIA).otherwise(T.NEW_YORK)
    local = F.col("o_orderdate").cast("timestamp") + F.expr("interval 10 hours")
    return table(spark, sf, "orders").select("o_orderkey", T.localize(local, zone).alias("epoch"))


@query(
    "p4_seconds_millis",
    """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS millis FROM events""",
)
def p4_seconds_millis(spark, sf):
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    mixed = F.when(F.col("event_id") % 2 == 0, epoch).otherwise(epoch * 1000 + F.col("event_id") % 1000)
    seconds = T.to_seconds(F.col("t"))
    return (
        table(spark, sf, "events")
        .select("event_id", mixed.alias("t"))
        .select("event_id", seconds.alias("seconds"), (T.to_seconds(T.to_millis(F.col("t"))) * 1000).alias("millis"))
    )


@query(
    "p5_validate_epochs",
    with_sql(
        "o AS (SELECT o_orderkey, o_custkey AS batch, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS epoch FROM orders)",
        """SELECT o_orderkey, batch, epoch FROM o WHERE batch IN (SELECT batch FROM o GROUP BY batch
  HAVING max(epoch) > 946684800 AND abs(max(epoch) - 1000000000) <= 31536000)""",
    ),
)
def p5_validate_epochs(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("batch"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("epoch")
    )
    return R.validate_epochs(rows, "batch", F.lit(1000000000)).select("o_orderkey", "batch", "epoch")


@query(
    "p7_align_daily",
    "SELECT event_id, CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS day_epoch FROM events",
)
def p7_align_daily(spark, sf):
    return inputs.table(spark, sf, "events").select(
        "event_id", T.align_daily(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("day_epoch")
    )


RESOLUTIONS = ("1", "3", "5", "15", "60", "240", "D", "1D", "W", "1W", "M", "30S", "4H", "2W", "abc")
RES_SQL = f"""rs AS (SELECT p_partkey, [{", ".join(f"'{r}'" for r in RESOLUTIONS)}][CAST(p_partkey % 15 AS INTEGER) + 1] AS r FROM part),
rn AS (SELECT *, TRY_CAST(nullif(regexp_extract(r, '^(\\d+)', 1), '') AS INTEGER) AS n, right(r, 1) AS u FROM rs)"""


@query(
    "x16_resolution_tables",
    with_sql(
        RES_SQL,
        """SELECT p_partkey, r AS resolution, CASE WHEN r IN ('D', '1D') THEN 1440 WHEN r IN ('W', '1W') THEN 10080 WHEN r = 'M' THEN 21600
    WHEN n IN (1, 5, 15, 30, 60, 240, 1440, 10080, 21600) THEN n WHEN n IS NOT NULL THEN 60 ELSE 1440 END AS minutes,
  CASE WHEN r IN ('D', '1D') THEN 86400 WHEN u = 'S' THEN n WHEN u = 'M' THEN n * 60 WHEN u = 'H' THEN n * 3600 WHEN u = 'D' THEN n * 86400
    WHEN u = 'W' THEN n * 604800 ELSE n * 60 END AS seconds FROM rn""",
    ),
)
def x16_resolution_tables(spark, sf):
    names = F.array(*[F.lit(r) for r in RESOLUTIONS])
    res = F.get(names, (F.col("p_partkey") % 15).cast("int"))
    return table(spark, sf, "part").select("p_partkey", res.alias("resolution")).select(
        "p_partkey", "resolution", T.offered_minutes(F.col("resolution")).alias("minutes"), T.resolution_seconds(F.col("resolution")).alias("seconds")
    )


@query(
    "x17_pair_aliases",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'BTC/' WHEN o_orderkey % 3 = 1 THEN 'DOGE/' ELSE 'ETH/' END || o_orderstatus AS pair FROM orders""",
)
def x17_pair_aliases(spark, sf):
    base = F.when(F.col("o_orderkey") % 3 == 0, "XBT/").when(F.col("o_orderkey") % 3 == 1, "XDG/").otherwise("ETH/")
    return table(spark, sf, "orders").select("o_orderkey", T.pair_alias(F.concat(base, "o_orderstatus")).alias("pair"))
