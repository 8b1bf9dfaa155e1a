"""Fixed column layouts shared by the operators (the reference data model, typed)."""

from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

# header order of a candle file: prices first, epoch seconds last
CANDLE_CSV = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
    + [T.StructField("timestamp", T.LongType())]
)

TICKS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

TRADES = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("pnl", T.DoubleType()),
    ]
)
