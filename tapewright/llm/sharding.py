"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2**ring_bits`` cells. A row's cell is the top bits of a hash of its
id and text; a cell belongs to the first virtual node clockwise. No shard may
hold more than ``(1 + slack)`` times the mean: a cell whose shard is full goes on
clockwise to the next shard with room. Only cells that overflow move, so balance
is guaranteed and movement is limited.

The rows are read twice: once for the bytes and rows of each cell (a histogram of
at most ``2**ring_bits`` rows, whatever the input), once to label each row. The
ring walk runs over that histogram on the driver; its answer, one row a cell, is
what gets broadcast.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAW = "bytes"


def ring(shards: int, virtual_nodes: int, ring_bits: int) -> list[tuple[int, int]]:
    """Sorted (cell, shard) points; a shard's points don't depend on how many shards there are."""
    points: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            at = zlib.crc32(f"shard {shard} node {node}".encode()) >> (32 - ring_bits)
            points.setdefault(at, shard)
    return sorted(points.items())


def walk(cells: list[tuple[int, int]], points: list[tuple[int, int]], shards: int, slack: float) -> dict[int, int]:
    """Shard of each cell. cells: (cell, bytes); heavy cells are placed first, ties by cell.

    A cell goes to the first shard clockwise that stays within the bound; if it
    fits in none (one text larger than the slack that is left), to the emptiest.
    """
    total = sum(weight for _, weight in cells)
    bound = (1 + slack) * total / shards
    load, where, out = [0] * shards, [at for at, _ in points], {}
    for cell, weight in sorted(cells, key=lambda x: (-x[1], x[0])):
        first, tried = bisect_left(where, cell), set()
        for step in range(len(points)):
            shard = points[(first + step) % len(points)][1]
            if shard in tried:
                continue
            if load[shard] + weight <= bound:
                break
            tried.add(shard)
            if len(tried) == shards:
                shard = min(range(shards), key=lambda s: (load[s], s))
                break
        load[shard] += weight
        out[cell] = shard
    return out


def assign(docs: DataFrame, shards: int = 24, virtual_nodes: int = 64, slack: float = 0.0005, ring_bits: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text (none for a null) plus 8; slot counts a
    shard's rows from 0 in ring order without gaps. Rows with equal id and equal
    text share a ring cell and are numbered one after the other. A null id is a key like any
    other; an empty table gives no rows; other columns are ignored. grown_shard is
    null: under a bound on bytes the shard depends on all rows, not on the key alone.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(
        F.col("doc_id"),
        (F.length(raw).cast("long") + 8).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("_at"),
    ).withColumn("_cell", F.shiftrightunsigned("_at", 64 - ring_bits).cast("int"))
    counted = rows.groupBy("_cell").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    shard_of = walk([(r["_cell"], r["b"]) for r in counted], ring(shards, virtual_nodes, ring_bits), shards, slack)
    start, plan = [0] * shards, []
    for r in sorted(counted):
        s = shard_of[r["_cell"]]
        plan.append((r["_cell"], s, start[s]))
        start[s] += r["n"]
    # at most 2**ring_bits rows, so it may be broadcast whatever the input
    placed = F.broadcast(spark.createDataFrame(plan, "_cell int, shard int, _start long"))
    within = Window.partitionBy("_cell").orderBy("_at", "doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_nth", F.row_number().over(within))
        .join(placed, "_cell")
        .select(
            "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
            (F.col("_start") + F.col("_nth") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
