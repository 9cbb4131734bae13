"""Small helpers that every operator of this subpackage uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import on_workers, shared_path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder, deleted when the driver ends unless ``remove`` comes first."""
    path = shared_path(spark, f"tapewright/{name}")
    where, store = _located(spark, path)
    store.mkdirs(where)
    store.deleteOnExit(where)
    return path


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet and reads it again: cuts the lineage, survives lost executors."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Spark's own file system."""
    where, store = _located(spark, path)
    store.delete(where, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Readies the session for functions that run in Python workers.

    Arrow batches get ``rows`` rows at most, so that a worker never sees many long texts at
    once; and workers find this package where the driver found it.
    """
    on_workers(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(docs: DataFrame, name: str) -> str:
    """``name`` with as many ``_`` before it as it takes to differ from all columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: ids of eight bytes that may be broadcast, about 40 MB
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is not in the one column of ``gone``; null ids stay.

    The ids are written first. Up to BROADCAST_IDS of them are broadcast, so that no text is moved; more meet the texts in a shuffle.
    """
    name = fresh(docs, "_gone")
    ids = stored(gone.toDF(name).where(F.col(name).isNotNull()).distinct(), scratch(docs.sparkSession, "gone"))
    if ids.count() <= BROADCAST_IDS:  # size checked just now
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == F.col(name), "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_of(id_column: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: the fold of a row."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % divisor if isinstance(id_column, str) else F.crc32(id_column.cast("string").cast("binary")) % divisor


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
