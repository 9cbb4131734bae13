"""Incremental re-ingestion: what changed, and how it went."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_sources(spark: SparkSession, glob: str) -> DataFrame:
    """path and mtime of the files of a glob, without their content."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("modificationTime").alias("mtime"))


def changed_sources(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources (path, mtime) that the manifest lacks or has an older time of."""
    done = manifest.select(F.col("path").alias("_p"), F.col("mtime").alias("_m"))
    return sources.join(done, F.col("path") == F.col("_p"), "left").where(F.col("_p").isNull() | (F.col("mtime") > F.col("_m"))).select("path", "mtime")


def ingest_summary(results: DataFrame, examples: int = 5) -> DataFrame:
    """status, sources and examples (the first paths of those that failed) of rows (path, status)."""
    counts = results.groupBy("status").agg(F.count(F.lit(1)).alias("sources"))
    first = results.where(F.col("status") != "success").select("path").orderBy("path").limit(examples)
    failed = F.broadcast(first.agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("_failed")))
    return counts.crossJoin(failed).select("status", "sources", F.when(F.col("status") != "success", F.col("_failed")).otherwise("").alias("examples"))
