"""A store of bars as a catalogue table, bucketed by instrument and sorted by date within a bucket.

Windows and joins on ``symbol`` over the table need no exchange (joins on more columns neither, where
spark.sql.requireAllClusterKeysForCoPartition is off), and one instrument is read from one bucket. An instrument's
history is replaced by appending its new bars under a new version and noting that version in a second, small
table; bars of older versions are passed over when the store is read, and go when it is compacted. Writers only ever
append, so two at once lose nothing, and a writer that is lost before its note leaves the store as it was.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of Parquet that a bucket should hold, and what a bar takes, about
BUCKET_BYTES, BAR_BYTES = 256 << 20, 40
#: replaced instruments that may be broadcast, about 40 bytes each
BROADCAST_NOTES = 500_000
VERSION = "_version"


def buckets_for(rows: int, least: int) -> int:
    """Buckets for so many bars: as many as their bytes ask for, ``least`` at any rate."""
    return max(least, -(-rows * BAR_BYTES // BUCKET_BYTES))


def _notes(table: str) -> str:
    return f"{table}_replaced"


def _write(bars: DataFrame, table: str, buckets: int, mode: str, path: str | None) -> None:
    # dealt as the table is, so that a bucket becomes one file
    writer = bars.repartition(buckets, "symbol").write.mode(mode).format("parquet").bucketBy(buckets, "symbol").sortBy("symbol", "date")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def write_store(bars: DataFrame, table: str, buckets: int | None = None, path: str | None = None) -> None:
    """Writes a whole store; what the table held before goes. Without ``buckets`` the bars are counted first, to have them by size.

    path: where the files go, if not in the warehouse.
    """
    spark = bars.sparkSession
    if buckets is None:
        buckets = buckets_for(bars.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    _write(bars.withColumn(VERSION, F.lit(0).cast("long")), table, buckets, "overwrite", path)
    spark.sql(f"drop table if exists {_notes(table)}")
    notes = spark.sql(f"select cast(null as string) as symbol, cast(null as bigint) as {VERSION} where false").write.format("parquet").mode("overwrite")
    (notes if path is None else notes.option("path", f"{path}-replaced")).saveAsTable(_notes(table))


def load_store(spark: SparkSession, table: str) -> DataFrame:
    """The bars of a store, each instrument's in its last version."""
    every = spark.table(table)
    latest = spark.table(_notes(table)).groupBy(F.col("symbol").alias("_noted")).agg(F.max(VERSION).alias("_latest"))
    noted = latest.count()
    if not noted:
        return every.drop(VERSION)
    if noted <= BROADCAST_NOTES:  # size checked just now
        latest = F.broadcast(latest)
    met = every.join(latest, F.col("symbol") == F.col("_noted"), "left")
    return met.where(F.col(VERSION) >= F.coalesce("_latest", F.lit(0))).drop(VERSION, "_noted", "_latest")


def current_sql(table: str) -> str:
    """The bars of a store, each instrument's in its last version, as a subquery for SQL."""
    latest = f"(select symbol as _noted, max({VERSION}) as _latest from {_notes(table)} group by symbol)"
    return f"(select * except ({VERSION}, _noted, _latest) from {table} left join {latest} on symbol = _noted where {VERSION} >= coalesce(_latest, 0))"


def _buckets_of(spark: SparkSession, table: str) -> int:
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"describe formatted {table}").collect()}
    return int(told["Num Buckets"])


def replace_instruments(bars: DataFrame, table: str) -> None:
    """Replaces the whole history of the instruments in ``bars``; all others in the store stay as they are.

    What is written grows with ``bars`` alone. The new bars count from the moment their instruments are noted. Of two
    writers that replace one instrument at the same time the later version wins, whole.
    """
    spark = bars.sparkSession
    version = time.time_ns()
    _write(bars.withColumn(VERSION, F.lit(version)), table, _buckets_of(spark, table), "append", None)
    own = spark.table(table).where(F.col(VERSION) == version)  # what was written, not ``bars`` computed once more
    own.select("symbol", VERSION).distinct().write.mode("append").format("parquet").saveAsTable(_notes(table))


def compact(spark: SparkSession, table: str, into: str, path: str | None = None) -> None:
    """Writes the bars that count into a new store ``into``, its buckets by their number; the old one stays for its readers."""
    write_store(load_store(spark, table), into, None, path)


def load_symbol(spark: SparkSession, table: str, symbol: str, columns: list[str]) -> DataFrame:
    """Some columns of one instrument: one bucket is read."""
    return load_store(spark, table).where(F.col("symbol") == symbol).select(*columns)
