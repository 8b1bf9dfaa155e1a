"""Streaming bars, quotes and de-duplication with built-in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tickloom.schemas import TICKS


def read_ticks(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Tick files arriving in a folder (``symbol, ts, price, volume``)."""
    reader = spark.readStream.schema(TICKS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def tick_bars(ticks: DataFrame, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Tumbling OHLCV bars. Ticks later than ``delay`` are dropped; earlier late ones still update a bar."""
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(
            F.min_by("price", "ts").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.unix_seconds("w.start").alias("epoch"), "open", "high", "low", "close", "volume")
    )


def latest_bars(updates: DataFrame, known: DataFrame) -> DataFrame:
    """Of one micro-batch's bar updates, each symbol's newest bar, and the one before it when time moved on.

    ``known`` has the newest ``epoch`` of each symbol before the batch. Bars older than that are ignored; while the newest bar stays the
    same only its update is passed on.
    """
    newest = Window.partitionBy("symbol").orderBy(F.col("epoch").desc())
    fresh = updates.join(known.withColumnRenamed("epoch", "_known"), "symbol", "left").where("_known IS NULL OR epoch >= _known")
    aged = fresh.withColumns({"age": F.row_number().over(newest) - 1, "_newest": F.max("epoch").over(Window.partitionBy("symbol"))})
    return aged.where("age = 0 OR age = 1 AND (_known IS NULL OR _newest > _known)").drop("_known", "_newest")


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append every micro-batch's updated rows with their ``batch_id``; a replayed batch replaces itself.

    The batch id is the folder, so a batch that is run again after a failure overwrites its own output.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)


def write_latest(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append each micro-batch's ``latest_bars``; one row per symbol, its newest epoch, is kept from batch to batch beside them.

    Every batch reads what the one before it left and writes its own folders, so a batch that is run again gives the same rows.
    """
    memory = f"{path}-newest"

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kind = "symbol string, epoch long"
        known = spark.read.schema(kind).parquet(f"{memory}/batch_id={batch_id - 1}") if batch_id else spark.createDataFrame([], kind)
        # two writes read the batch; its stateful part must run once
        batch.persist()
        try:
            latest_bars(batch, known).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            seen = batch.select("symbol", "epoch").union(known).groupBy("symbol").agg(F.max("epoch").alias("epoch"))
            seen.write.mode("overwrite").parquet(f"{memory}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)


def current_rows(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last written version of each key from a folder of ``write_updates``."""
    rest = [c for c in updates.columns if c not in {*keys, "batch_id"}]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")


def latest_quotes(ticks: DataFrame) -> DataFrame:
    """Latest tick per symbol; run it with ``trigger(processingTime=...)`` at the wanted cadence."""
    return ticks.groupBy("symbol").agg(F.max_by(F.struct("ts", "price", "volume"), "ts").alias("q")).select("symbol", "q.*")


def distinct_trades(trades: DataFrame, delay: str = "1 day") -> DataFrame:
    """First of equal trades (symbol, time, type, price) within the watermark."""
    return trades.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts", "type", "price"])
