"""A corpus pipeline of five stages, each one operator of ``tapewright.llm``.

Quality classifier, near duplicates, benchmark decontamination, mixing, sharding. A stage gets all that
the one before it kept, written as Parquet in the shared folder and read again, so a lost
executor costs no more than its own tasks. All stages but the last return the columns of
``documents``, whatever they are called. Null or empty texts go where the quality classifier
sends them. Decisions after the first stage are by doc_id: rows repeated with one id share their
fate, and rows with a null id stay. An empty table stays empty through all stages.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import decontaminate, jaccard_join, mixing, quality, sharding
from tapewright.llm._common import remove, scratch, stored, table, without

#: weights of the domains after mixing; rates stay at or below 1, as copies were just taken out
TARGETS = {"clean": 0.985, "low": 0.01, "toxic": 0.005}
SHARDS = 24
#: a share of all tokens by which a target may be missed in silence
MISS = 1e-3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents of the whole table and drops what scores below the threshold."""
    trees = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, trees)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as their rate says: with rates of at most 1, once or not at all.

    Targets that the bounds on the rates put out of reach are told in a warning, with the share by which they are missed.
    """
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), TARGETS, most=1.0)
    first = mixed.select("residual").first()
    if first is not None and (first["residual"] or 0.0) > MISS:
        warnings.warn(f"mixing misses a target by {first['residual']:.4f} of all tokens", stacklevel=2)
    return without(docs, mixed.where(F.col("copies") < 1).select("doc_id"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard, as ``sharding.assign`` tells; the columns are that operator's."""
    return sharding.assign(docs, SHARDS)


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix), ("sharding", shard)]

#: classifiers have no SQL; tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for nth, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if nth + 1 < len(STAGES):
            path = scratch(spark, f"pipeline-{name}")
            docs = stored(docs, path)
            if before is not None:
                remove(spark, before)
            before = path
    return docs
