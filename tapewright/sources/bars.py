"""Bars on disk: schemas, reading, calendars and snapshots; ``store`` has the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PRICES = ("open", "high", "low", "close")
BARS_RAW = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in (*_PRICES, "amount")]
    + [T.StructField("volume", T.LongType())]
)
BARS = T.StructType([*BARS_RAW.fields, *(T.StructField(c, T.DoubleType()) for c in ("factor", *(f"{p}_adj" for p in _PRICES), "volume_adj"))])


def load_bars(spark: SparkSession, path: str) -> DataFrame:
    """The bars of a Parquet dataset with a symbol column."""
    return spark.read.parquet(path)


def load_bars_by_file(spark: SparkSession, path: str) -> DataFrame:
    """A folder with one Parquet file or folder an instrument, named by its id: the symbol comes from the name."""
    files = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return files.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_path"), r"([a-z]{2}[0-9]+)[.]parquet", 1))


def trading_calendar(bars: DataFrame, index: str | None = None) -> DataFrame:
    """The distinct dates, in order, of one index or of all bars."""
    return (bars if index is None else bars.where(F.col("symbol") == index)).select("date").distinct().orderBy("date")


def latest_snapshot(df: DataFrame, date: str, days: int = 8, column: str = "date") -> DataFrame:
    """Rows of the latest date on or before ``date``, looking at ``days`` days at most."""
    end = F.to_date(F.lit(date))
    near = df.where(F.col(column).between(F.date_sub(end, days - 1), end))
    last = F.broadcast(near.agg(F.max(column).alias("_last")))
    return near.crossJoin(last).where(F.col(column) == F.col("_last")).drop("_last")
