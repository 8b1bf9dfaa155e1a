"""File sources and sinks: candle files, payload documents, instrument masters, option chains, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.schemas import BARS, CANDLE_CSV

PRICES = ("open", "high", "low", "close", "volume")
ALIASES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}


def read_bars(spark: SparkSession, path: str, symbol: str, resolution: str) -> DataFrame:
    """Candle CSV with header ``open,high,low,close,volume,timestamp``."""
    raw = spark.read.schema(CANDLE_CSV).csv(path, header=True)
    return raw.select(
        F.lit(symbol).alias("symbol"), F.lit(resolution).alias("resolution"), F.col("timestamp").alias("epoch"), *PRICES
    )


def write_bars(bars: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Bars laid out by resolution and day, so range scans prune files and a hot symbol is split by day.

    Rows are hashed by symbol and month before the write: few files per folder, none of unbounded size.
    """
    spread = bars.withColumn("month", F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM"))
    writer = spread.repartition("resolution", "month", "symbol").write.mode("error").partitionBy("resolution", "month")
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)


def scan_bars(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Bars written by ``write_bars``."""
    schema = T.StructType(
        [*BARS.fields, T.StructField("resolution", T.StringType()), T.StructField("month", T.StringType())]
    )
    reader = spark.read.schema(schema).format(file_format)
    return (reader.option("header", True) if file_format == "csv" else reader).load(path)


PAYLOAD = T.StructType(
    [
        T.StructField("status", T.StringType()),
        *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in (*PRICES, "open_interest")],
        T.StructField("timestamp", T.ArrayType(T.LongType())),
    ]
)


def read_payloads(documents: DataFrame, column: str = "payload") -> DataFrame:
    """JSON text documents of parallel arrays as typed columns."""
    parsed = documents.withColumn("_p", F.from_json(column, PAYLOAD))
    return parsed.select(*[c for c in documents.columns if c != column], "_p.*")


def explode_payload(payloads: DataFrame) -> DataFrame:
    """Parallel arrays to rows. Arrays not as long as ``close`` are ignored; failures give no rows.

    Missing open, high and low become the close; missing volume becomes 0.
    """
    n = F.size("close")
    usable = lambda c: F.when(F.size(c) == n, F.col(c))
    value = lambda name, i, other: F.coalesce(F.get(usable(name), i), other)
    close = lambda i: F.get(F.col("close"), i)
    rows = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.get(usable("timestamp"), i).alias("epoch"),
            *[value(p, i, close(i)).alias(p) for p in ("open", "high", "low")],
            close(i).alias("close"),
            value("volume", i, F.lit(0.0)).alias("volume"),
        ),
    )
    ok = (n > 0) & (F.coalesce("status", F.lit("")) != "failure")
    keep = [c for c in payloads.columns if c not in {*PAYLOAD.fieldNames()}]
    return payloads.where(ok).select(*keep, F.inline(rows))


def read_instruments(spark: SparkSession, path: str, exchange: str | None = "NSE") -> DataFrame:
    """Instrument master CSV: trimmed headers, one exchange, upper-case search key, file order."""
    raw = spark.read.csv(path, header=True)
    named = raw.toDF(*[c.strip() for c in raw.columns])
    if exchange is not None:
        named = named.where(F.col("SEM_EXM_EXCH_ID") == exchange)
    key = F.coalesce("SEM_TRADING_SYMBOL", "SM_SYMBOL_NAME")
    return named.withColumn("search_symbol", F.upper(key))


QUOTE = T.StructType(
    [
        T.StructField("greeks", T.StructType([T.StructField(g, T.DoubleType()) for g in ("delta", "theta", "gamma", "vega")])),
        *[
            T.StructField(c, T.DoubleType())
            for c in ("implied_volatility", "last_price", "previous_close_price", "top_ask_price", "top_bid_price")
        ],
        *[
            T.StructField(c, T.LongType())
            for c in ("oi", "previous_oi", "previous_volume", "top_ask_quantity", "top_bid_quantity", "volume")
        ],
    ]
)
CHAIN = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("last_price", T.DoubleType()),
                    T.StructField(
                        "oc",
                        T.MapType(T.StringType(), T.StructType([T.StructField("ce", QUOTE), T.StructField("pe", QUOTE)])),
                    ),
                ]
            ),
        )
    ]
)


def read_option_chain(documents: DataFrame, column: str = "payload") -> DataFrame:
    """Option-chain JSON to one row per strike and side with quotes and greeks."""
    keep = [c for c in documents.columns if c != column]
    parsed = documents.select(*keep, F.from_json(column, CHAIN).alias("_c"))
    strikes = parsed.select(*keep, F.col("_c.data.last_price").alias("underlying_price"), F.explode("_c.data.oc").alias("_k", "_s"))
    side = lambda name: F.when(
        F.col(f"_s.{name}").isNotNull(), F.struct(F.lit(name.upper()).alias("option_type"), F.col(f"_s.{name}").alias("q"))
    )
    flat = strikes.select(
        *keep, "underlying_price", F.col("_k").cast("double").alias("strike"), F.inline(F.array_compact(F.array(side("ce"), side("pe"))))
    )
    quotes = [F.col(f"q.{f.name}").alias(f.name) for f in QUOTE.fields if f.name != "greeks"]
    greeks = [F.col(f"q.greeks.{g}").alias(g) for g in ("delta", "theta", "gamma", "vega")]
    return flat.select(*keep, "underlying_price", "strike", "option_type", *quotes, *greeks)


def standardize_columns(df: DataFrame) -> DataFrame:
    """Lower-case names, ``o/h/l/c/v`` to full names unless those exist already."""
    lower = [c.lower() for c in df.columns]
    names = [ALIASES[c] if c in ALIASES and ALIASES[c] not in lower else c for c in lower]
    return df.toDF(*names)


def coerce_numeric(df: DataFrame, columns: tuple[str, ...] = PRICES, strict: bool = False) -> DataFrame:
    """Text to doubles: bad values become null, or fail the query when ``strict``."""
    present = [c for c in columns if c in df.columns]

    def convert(name: str) -> Column:
        value = F.col(name).try_cast("double")
        if not strict:
            return value
        bad = F.col(name).isNotNull() & value.isNull()
        return F.when(bad, F.raise_error(F.concat(F.lit(f"not a number in {name}: "), F.col(name).cast("string"))).cast("double")).otherwise(value)

    return df.withColumns({c: convert(c) for c in present})


def validate_bars(df: DataFrame, required: tuple[str, ...] = ("epoch", "open", "high", "low", "close")) -> DataFrame:
    """``df`` unchanged; missing columns or no rows are errors."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if df.isEmpty():
        raise ValueError("no bars")
    return df


def explode_symbol_info(payload: DataFrame, resolutions: tuple[str, ...] = ("1", "5", "15", "60", "D")) -> DataFrame:
    """Symbol-info documents whose fields are scalars or arrays to one row per symbol.

    Every column of ``payload`` but ``symbol`` may be an array (one value per symbol) or a scalar (the
    same for all); absent columns get defaults.
    """
    kinds = {f.name: f.dataType for f in payload.schema.fields}
    defaults = {
        "ticker": None,
        "description": F.lit(None).cast("string"),
        "exchange_traded": F.lit(None).cast("string"),
        "type": F.lit(None).cast("string"),
        "timezone": F.lit(None).cast("string"),
        "has_intraday": F.lit(False),
        "has_daily": F.lit(True),
        "volume_precision": F.lit(0),
    }

    def pick(name, i, default):
        if name not in kinds:
            return default
        value = F.get(F.col(name), i) if isinstance(kinds[name], T.ArrayType) else F.col(name)
        return value if default is None else F.coalesce(value, default)

    rows = F.transform(
        F.sequence(F.lit(0), F.size("symbol") - 1),
        lambda i: F.struct(
            F.get(F.col("symbol"), i).alias("name"),
            pick("ticker", i, F.get(F.col("symbol"), i)).alias("ticker"),
            *[pick(n, i, d).alias(n) for n, d in defaults.items() if n != "ticker"],
        ),
    )
    out = payload.where(F.size("symbol") > 0).select(F.inline(rows))
    return out.withColumn("full_name", F.concat_ws(":", "exchange_traded", "name")).withColumn(
        "supported_resolutions", F.array(*[F.lit(r) for r in resolutions])
    )


def flatten_details(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``details`` map to a ``detail_*`` column for each of ``keys``, and the time as ISO text; without keys the map stays."""
    iso = F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss")
    return events.select(
        *[c for c in events.columns if c != "details" or keys is None],
        iso.alias("datetime"),
        *[F.try_element_at("details", F.lit(k)).alias(f"detail_{k}") for k in keys or ()],
    )


def detail_keys(events: DataFrame) -> list[str]:
    """The names that occur in ``details``, sorted: as many as there are kinds of details, not events."""
    return [r[0] for r in events.select(F.explode(F.map_keys("details"))).distinct().orderBy("col").collect()]


def write_events(events: DataFrame, path: str, file_format: str = "json", keys: list[str] | None = None) -> None:
    """Event log as JSON lines with nested details, or CSV with a column for each of ``keys``: without them, for every name that occurs in the details."""
    if file_format == "json":
        iso = F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss")
        events.withColumn("datetime", iso).write.mode("error").json(path)
    elif file_format == "csv":
        flatten_details(events, detail_keys(events) if keys is None else keys).write.mode("error").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {file_format!r}; use json or csv")


SESSION_PARTS = ("session", "events", "indicator_snapshots")


def write_session(path: str, name: str, events: DataFrame, snapshots: DataFrame, statistics: DataFrame) -> None:
    """A study session as JSON lines in three folders: one line per symbol with name, event count and statistics, then its events and its snapshots.

    A line never grows with the length of the session: what a single document would nest lies beside it, keyed by symbol.
    """
    iso = F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss")
    nested = F.struct(*[c for c in statistics.columns if c not in ("symbol", "event_count")])
    statistics.select("symbol", F.lit(name).alias("session_name"), "event_count", nested.alias("statistics")).write.mode("error").json(f"{path}/session")
    write_events(events, f"{path}/events")
    snapshots.withColumn("datetime", iso).write.mode("error").json(f"{path}/indicator_snapshots")


def read_session(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """One part of a session that ``write_session`` wrote."""
    if part not in SESSION_PARTS:
        raise ValueError(f"unknown part {part!r}; available: {', '.join(SESSION_PARTS)}")
    return spark.read.schema(schema).json(f"{path}/{part}")
