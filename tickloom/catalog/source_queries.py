"""Sources, sinks and normalisation, round-tripped over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import inputs
from tickloom.catalog.inputs import DAILY_SQL, HOURLY_SQL, TICKS_SQL, table
from tickloom.catalog.join_queries import CHAIN_SQL, part_chain
from tickloom.catalog.registry import query, with_sql
from tickloom.operators.bars import bars_to_arrays, resample, to_candles
from tickloom.session import scratch_path, settle
from tickloom.sources import files as S

BARS_SELECT = "SELECT symbol, epoch, open, high, low, close, volume FROM bars"


@query(
    "s1_candle_csv",
    with_sql(
        TICKS_SQL,
        """SELECT 'market' AS symbol, CAST(floor(epoch / 3600.0) * 3600 AS BIGINT) AS epoch, arg_min(price, ts) AS open, max(price) AS high,
       min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume FROM ticks GROUP BY 2""",
    ),
)
def s1_candle_csv(spark, sf):
    path = scratch_path(spark, "candles")
    market = resample(inputs.ticks(spark, sf).withColumn("symbol", F.lit("market")), 3600, ("ts",))
    market.select("open", "high", "low", "close", "volume", F.col("epoch").alias("timestamp")).write.option("header", True).csv(path)
    return S.read_bars(spark, path, "market", "60").drop("resolution")


@query("s2_bars_export", with_sql(HOURLY_SQL, "SELECT symbol, epoch, open, high, low, close, volume, '60' AS resolution FROM bars"))
def s2_bars_export(spark, sf):
    path = scratch_path(spark, "bars")
    S.write_bars(inputs.hourly(spark, sf).withColumn("resolution", F.lit("60")), path)
    return S.scan_bars(spark, path).drop("month")


def payload_documents(spark, sf):
    """Supplier bars as JSON documents of parallel arrays; some failed, some with a short array."""
    chunks = bars_to_arrays(inputs.daily(spark, sf), 365 * 86400)
    i = F.pmod(F.col("chunk"), F.lit(4))
    failed = i == 0
    volume = F.when(i == 1, F.slice("v", 1, 1)).otherwise(F.col("v"))
    body = F.struct(
        F.when(failed, "failure").otherwise("success").alias("status"),
        F.col("t").alias("timestamp"), F.col("o").alias("open"), F.col("h").alias("high"),
        F.col("c").alias("close"), volume.alias("volume"),
    )
    return chunks.select("symbol", "chunk", F.to_json(body).alias("payload"))


@query(
    "s3_explode_payload",
    with_sql(
        DAILY_SQL + ", c AS (SELECT *, epoch // 31536000 AS chunk, count(*) OVER (PARTITION BY symbol, epoch // 31536000) AS n FROM bars)",
        """SELECT symbol, epoch, open, high, close AS low, close, CASE WHEN chunk % 4 = 1 AND n > 1 THEN 0.0 ELSE volume END AS volume FROM c WHERE chunk % 4 <> 0""",
    ),
)
def s3_explode_payload(spark, sf):
    rows = S.explode_payload(S.read_payloads(payload_documents(spark, sf)))
    return rows.select("symbol", "epoch", "open", "high", "low", "close", "volume")


@query(
    "s4_instrument_master",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, upper(p_name) AS search_symbol, p_type AS instrument FROM part WHERE p_brand = 'Brand#2'""",
)
def s4_instrument_master(spark, sf):
    path = scratch_path(spark, "master")
    table(spark, sf, "part").select(
        F.col("p_brand").alias(" SEM_EXM_EXCH_ID"),
        F.col("p_partkey").alias("SEM_SMST_SECURITY_ID "),
        F.col("p_name").alias("SEM_TRADING_SYMBOL"),
        F.lit(None).cast("string").alias("SM_SYMBOL_NAME"),
        F.col("p_type").alias(" SEM_INSTRUMENT_NAME "),
    ).write.option("header", True).csv(path)
    out = S.read_instruments(spark, path, "Brand#2")
    return out.select(F.col("SEM_SMST_SECURITY_ID").alias("id"), "search_symbol", F.col("SEM_INSTRUMENT_NAME").alias("instrument"))


@query(
    "s5_option_chain",
    with_sql(
        CHAIN_SQL,
        """SELECT underlying, strftime(expiry, '%Y-%m-%d') AS expiry, strike, option_type, last_price, oi, oi / 100.0::DOUBLE AS delta
FROM ch, (VALUES ('CE'), ('PE')) o(option_type) WHERE option_type = 'CE' OR oi > 1""",
    ),
)
def s5_option_chain(spark, sf):
    chain = part_chain(spark, sf).where("option_type = 'CE'")
    quote = F.struct("last_price", "oi", F.struct((F.col("oi") / 100).alias("delta")).alias("greeks"))
    sides = F.struct(quote.alias("ce"), F.when(F.col("oi") > 1, quote).alias("pe"))
    documents = (
        chain.groupBy("underlying", "expiry")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.format_string("%.6f", "strike"), sides))).alias("oc"))
        .select("underlying", "expiry", F.to_json(F.struct(F.struct("oc").alias("data"))).alias("payload"))
    )
    out = S.read_option_chain(documents)
    return out.select("underlying", F.col("expiry").cast("string").alias("expiry"), "strike", "option_type", "last_price", "oi", "delta")


@query(
    "s6_bars_to_arrays",
    with_sql(
        DAILY_SQL,
        """SELECT symbol, epoch // 2592000 AS chunk, 'ok' AS s, list(epoch ORDER BY epoch) AS t, list(open ORDER BY epoch) AS o, list(high ORDER BY epoch) AS h,
       list(low ORDER BY epoch) AS l, list(close ORDER BY epoch) AS c, list(volume ORDER BY epoch) AS v FROM bars GROUP BY 1, 2""",
    ),
)
def s6_bars_to_arrays(spark, sf):
    return bars_to_arrays(inputs.daily(spark, sf)).select("symbol", "chunk", "s", "t", "o", "h", "l", "c", "v")


@query(
    "s7_event_log",
    """SELECT event_id, event_type, price, json_extract_string(props, '$.k') AS detail_k FROM (SELECT *, value AS price FROM events)""",
)
def s7_event_log(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"),
        "event_type",
        F.col("value").alias("price"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("details"),
    )
    path = scratch_path(spark, "log")
    S.write_events(events, path + "-json")
    S.write_events(events, path + "-csv", "csv", ["k"])
    from_json = spark.read.schema("event_id long, event_type string, details map<string,string>").json(path + "-json")
    from_csv = spark.read.csv(path + "-csv", header=True).select(F.col("event_id").cast("long").alias("event_id"), F.col("price").cast("double").alias("price"))
    return from_json.join(from_csv, "event_id").select("event_id", "event_type", "price", F.col("details.k").alias("detail_k"))


@query("s9_candles", with_sql(HOURLY_SQL, "SELECT symbol, epoch AS time, open, high, low, close, volume FROM bars"))
def s9_candles(spark, sf):
    return to_candles(inputs.hourly(spark, sf))


@query("p1_standard_columns", with_sql(HOURLY_SQL, BARS_SELECT))
def p1_standard_columns(spark, sf):
    bars = inputs.hourly(spark, sf).toDF("Symbol", "Epoch", "O", "High", "l", "CLOSE", "V")
    return S.standardize_columns(bars)


@query(
    "p2_coerce_numeric",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS close FROM events""",
)
def p2_coerce_numeric(spark, sf):
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return S.coerce_numeric(table(spark, sf, "events").select("event_id", text.alias("close")))


@query("p6_validated_bars", with_sql(HOURLY_SQL, "SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol"))
def p6_validated_bars(spark, sf):
    return S.validate_bars(settle(inputs.hourly(spark, sf))).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


@query(
    "p9_symbol_info_rows",
    """SELECT n_name AS name, r_name || ':' || n_name AS full_name, 'nation ' || n_nationkey AS description, n_name AS ticker, false AS has_intraday, true AS has_daily
FROM nation JOIN region ON r_regionkey = n_regionkey""",
)
def p9_symbol_info_rows(spark, sf):
    nations = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("n"))
    payload = nations.join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.transform("n", lambda x: x["n_name"]).alias("symbol"),
        F.transform("n", lambda x: F.concat(F.lit("nation "), x["n_nationkey"].cast("string"))).alias("description"),
        F.col("r_name").alias("exchange_traded"),
    )
    return S.explode_symbol_info(payload).select("name", "full_name", "description", "ticker", "has_intraday", "has_daily")
