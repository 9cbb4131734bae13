"""A near-real-time radar over a stream of ticks: running daily bars, screened again with every batch.

An extension, not part of the batch inventory. Ticks have ts, symbol, price and volume.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.screens import factors, resonance, volume_breakout
from ..operators.universe import at_latest


def ticks_of_events(events: DataFrame) -> DataFrame:
    """Ticks from an event stream: a user is an instrument, an event's value its price, each event one unit of volume."""
    return events.where(F.col("value").isNotNull()).select(
        F.col("ts").cast("timestamp").alias("ts"), F.format_string("sh60%04d", F.col("user_id") % 10000).alias("symbol"), F.col("value").cast("double").alias("price"), F.lit(1).cast("long").alias("volume")
    )


def running_bars(ticks: DataFrame, late: str = "2 hours", width: str = "1 day") -> DataFrame:
    """Tumbling bars of a stream with a watermark: symbol, date, open, high, low, close, amount, volume. Ticks later than ``late`` are left out."""
    bars = ticks.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "symbol").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"),
        F.sum(F.col("price") * F.col("volume")).alias("amount"), F.sum("volume").alias("volume"),
    )
    return bars.select("symbol", F.to_date("w.start").alias("date"), "open", "high", "low", "close", "amount", "volume")


def radar(history: DataFrame, today: DataFrame, blocks: DataFrame, mult: float = 1.5, alert: int = 8) -> DataFrame:
    """Breakouts of the running bars on top of history, in blocks where ``alert`` or more break out."""
    columns = ["symbol", "date", "close_adj", "volume"]
    both = history.select(*columns).unionByName(today.select("symbol", "date", F.col("close").alias("close_adj"), "volume"))
    return resonance(at_latest(factors(both, (20,))).where(volume_breakout(mult)), blocks, alert)


def start_radar(bars: DataFrame, history: DataFrame, blocks: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mult: float = 1.5, alert: int = 8, every: str | None = None) -> StreamingQuery:
    """Runs the screen on each batch of running bars and hands the result to ``sink`` (frame, batch number).

    A batch brings the bars that have changed, so the stream's state shrinks with the watermark. They are merged with the
    bars so far, a table beside the checkpoint in two turns: a batch reads the turn of the one before
    and writes its own, so a batch that is run again reads the same.
    """
    spark = bars.sparkSession

    def screen(batch: DataFrame, number: int) -> None:
        new = batch.select(F.col("symbol").alias("_s"), F.col("date").alias("_d"))
        today = batch
        if number > 0:
            before = spark.read.schema(batch.schema).parquet(f"{checkpoint}/bars/{(number - 1) % 2}")
            today = batch.unionByName(before.join(new, (F.col("symbol") == F.col("_s")) & (F.col("date") == F.col("_d")), "left_anti"))
        path = f"{checkpoint}/bars/{number % 2}"
        today.write.mode("overwrite").parquet(path)
        sink(radar(history, spark.read.schema(batch.schema).parquet(path), blocks, mult, alert), number)

    writer = bars.writeStream.outputMode("update").foreachBatch(screen).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
