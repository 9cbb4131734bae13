"""Merkle manifest of a dataset: a digest and a proof for each row, from trees of fan-out three.

The rows of a source, in order of doc_id, are the leaves of its tree, and the sources' roots are
the leaves of the top tree. Texts are hashed where they are read; only digests are shuffled. Leaves get their
places by ranges: a task numbers what it holds of each source, and the ranges' counts, summed
up, tell where its numbers start.

A tree is cut into superblocks of ``FAN ** LEVELS`` consecutive nodes. A superblock reduces to one node in one
task; these nodes are the next tier's, until every tree has one node. Then the tiers are walked from the top
down: the nodes of a tier and the outer nodes that their superblocks need (the siblings on the way from a
superblock's own node to the root) are cogrouped by superblock, so a task has all it takes to finish the local
levels, join the proofs and fold them. What a group holds is bounded by the superblock, whatever the sizes
of the sources.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, scratch, small_batches, stored

FAN, LEVELS = 3, 7
#: rows (range, source, first place) that may be broadcast, about 60 bytes each
BROADCAST_RANGES = 200_000
#: the key of the top tree; a source's key starts with a letter
TOP = ""
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


def joined(nodes: list[bytes]) -> bytes:
    """A run's node: the hash of its digests as hex text."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def field(value) -> bytes:
    """A value of a leaf: its UTF-8 byte count, a colon and itself; a null is a hyphen."""
    if value is None:
        return b"-"
    raw = value if isinstance(value, bytes) else str(value).encode()
    return b"%d:%b" % (len(raw), raw)


def height(n: int) -> int:
    """Levels from n leaves to one node."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def levels_of(nodes: list[bytes], most: int) -> list[list[bytes]]:
    """The nodes of a superblock level by level, the given ones first, ``most`` levels at most."""
    out = [nodes]
    for _ in range(most):
        below = out[-1]
        out.append([joined(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    return out


def siblings(levels: list[list[bytes]], at: int) -> list[tuple[list[bytes], list[bytes]]]:
    """Those to the left and right of the ``at``-th node on its way up, a pair a level."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % FAN
        out.append((nodes[first:at], nodes[at + 1 : first + FAN]))
        at //= FAN
    return out


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the rows as they are and, where tampering changes them, as it leaves them, with a number that tells equal rows apart."""
    nth = TaskContext.get().partitionId() << 40
    for batch in batches:
        doc_id, source, lang, n_chars, text = (c.to_pylist() for c in (*batch.columns[:4], batch.columns[4].cast(pa.binary())))
        leaves, others = [], []
        for *before, t, tampered in zip(doc_id, source, lang, n_chars, text, batch.column(5).to_pylist(), strict=True):
            head = b"".join(map(field, before))
            leaves.append(digest(head, field(t)))
            others.append(digest(head, field(t.replace(b"\n", b""))) if tampered and t and b"\n" in t else None)
        keys = ["n" if s is None else f"s{s}" for s in source]
        numbers = range(nth, nth + batch.num_rows)
        nth += batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(numbers, pa.int64()), pa.array(leaves, pa.binary()), pa.array(others, pa.binary())], names=["doc_id", "tree", "_row", "leaf", "other"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and, from 0 for each tree, the row's place within the task; rows come by tree."""
    part, last, nth = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for tree in batch.column("tree").to_pylist():
            nth = nth + 1 if tree == last else 0
            last = tree
            places.append(nth)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "_part", "_nth"])


def placed(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """``rows`` (with ``tree``) with ``pos``, the place within the tree in order of ``order``, and ``size``, the tree's nodes.

    Rows are dealt by ranges of (tree, order...), so a tree may spread over any number of tasks; they are
    written once below ``path``, since their places hold for that deal only.
    """
    spark = rows.sparkSession
    small_batches(spark)
    schema = rows.schema.simpleString()[len("struct<") : -1] + ",_part:int,_nth:bigint"
    dealt = rows.repartitionByRange(partitions(spark), "tree", *order).sortWithinPartitions("tree", *order)
    kept = stored(dealt.mapInArrow(_numbered, schema), path)
    counts = kept.groupBy(F.col("tree").alias("_tree"), F.col("_part").alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_tree")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = stored(counts.select("_tree", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(whole).alias("size")), f"{path}-ranges")
    if ranges.count() <= BROADCAST_RANGES:  # size checked just now
        ranges = F.broadcast(ranges)
    met = kept.join(ranges, (F.col("tree") == F.col("_tree")) & (F.col("_part") == F.col("_range")))
    return met.withColumn("pos", F.col("_first") + F.col("_nth")).drop("_tree", "_range", "_first", "_part", "_nth")


def _block(levels: int = LEVELS):
    return F.expr(f"pos div {FAN**levels}")


NODES = "tree string, pos long, size long, node binary"


def reduce_tier(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The nodes ``levels`` levels further up: a superblock becomes one node; a tree of one node stays."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        size, tree = int(group["size"].iloc[0]), group["tree"].iloc[0]
        top = levels_of(group["node"].tolist(), min(levels, height(size)))[-1]
        return pd.DataFrame({"tree": [tree], "pos": [int(group["pos"].iloc[0]) // FAN**levels], "size": [-(-size // FAN**levels)], "node": [top[0]]})

    return nodes.select("tree", "pos", "size", "node").groupBy("tree", _block(levels).alias("block")).applyInPandas(run, NODES)


#: one row a superblock and level above it: siblings to the left and to the right of the way up
OUTER = "tree string, block long, level int, before array<binary>, after array<binary>"
PROVED = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _pairs(outer: pd.DataFrame) -> list[tuple[list[bytes], list[bytes]]]:
    outer = outer.sort_values("level")
    return [(list(b), list(a)) for b, a in zip(outer["before"], outer["after"], strict=True)]


def _local(group: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[list[bytes]]]:
    group = group.sort_values("pos")
    size = int(group["size"].iloc[0]) if len(group) else 0
    return group, levels_of(group["node"].tolist(), min(levels, height(size)))


def outer_of(nodes: DataFrame, outer: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The outer nodes of each node of a tier, which stands for a superblock of the tier below.

    ``nodes`` and the ``outer`` nodes of their own superblocks are cogrouped by superblock.
    """

    def run(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, local = _local(group, levels)
        rest, out = _pairs(above), []
        for at, (tree, pos) in enumerate(zip(group["tree"], group["pos"], strict=True)):
            for level, (before, after) in enumerate(siblings(local, at) + rest):
                out.append((tree, int(pos), level, before, after))
        return pd.DataFrame(out, columns=["tree", "block", "level", "before", "after"])

    own = nodes.select("tree", "pos", "size", "node").withColumn("block", _block(levels)).groupBy("tree", "block")
    return own.cogroup(outer.groupBy("tree", "block")).applyInPandas(run, OUTER)


def prove(leaves: DataFrame, outer: DataFrame, subroots: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The leaves' rows: local levels are finished, proofs joined and folded in one task a superblock.

    leaves: tree, pos, size, node (the leaf), doc_id, other (the tampered leaf or null). outer: OUTER rows of
    the leaves' superblocks, the top tree's levels among them. subroots: tree, subroot and root.
    """

    def run(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, local = _local(group, levels)
        rest, out = _pairs(above), []
        for at, (doc_id, leaf, other, subroot, root) in enumerate(zip(group["doc_id"], group["node"], group["other"], group["subroot"], group["root"], strict=True)):
            path = siblings(local, at) + rest
            proof = hashlib.sha256("".join(n.hex() for pair in path for side in pair for n in side).encode()).hexdigest()
            folded = leaf if other is None else other
            for before, after in path:
                folded = joined([*before, folded, *after])
            out.append((doc_id, leaf.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PROVED.split(", ")])

    # ids as text: pandas makes floats of whole numbers with nulls
    own = leaves.join(subroots, "tree").withColumns({"block": _block(levels), "doc_id": F.col("doc_id").cast("string")}).groupBy("tree", "block")
    found = own.cogroup(outer.groupBy("tree", "block")).applyInPandas(run, PROVED)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _tiers(nodes: DataFrame, path: str, levels: int) -> list[DataFrame]:
    """A tree's tiers of superblock nodes, the given nodes first, the roots last; each is written."""
    out, largest = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        out.append(stored(reduce_tier(out[-1], levels), f"{path}-{len(out)}"))
        largest = -(-largest // FAN**levels)
    return out


def manifest(docs: DataFrame, tamper_every: int | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    A leaf is the SHA-256 of doc_id, source, lang, n_chars and text. proof_sha256 is that of the siblings on
    the way to the root, left to right, level by level; folded_root is what leaf and siblings fold to.
    tamper_every: rows whose crc32 of doc_id it divides are folded from a leaf whose text has lost its line breaks, so
    those that had any fail; null texts and null ids are left alone. Null ids come first within a source, rows of
    equal id stand in order of their leaves, and a null source is one of its own, before all others; an empty
    source is not a null one. A table of one row has its leaf as root and an empty proof. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = scratch(spark, "merkle")
    is_other = F.lit(False) if tamper_every is None else F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_every == 0, F.lit(False))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text", is_other.alias("_other"))
    hashed = read.mapInArrow(_leaves, "doc_id long, tree string, _row long, leaf binary, other binary")
    leaves = placed(hashed, ["doc_id", "leaf", "_row"], f"{path}/leaves").withColumnRenamed("leaf", "node").drop("_row")
    tiers = _tiers(leaves, f"{path}/tier", levels)
    subroots = tiers[-1].select(F.col("tree").alias("own"), "node")
    tops = placed(subroots.withColumn("tree", F.lit(TOP)), ["own"], f"{path}/sources")
    top_tiers = _tiers(tops, f"{path}/top", levels)
    outer = spark.createDataFrame([], OUTER)
    for nth, tier in enumerate(reversed(top_tiers[:-1])):
        outer = stored(outer_of(tier, outer, levels), f"{path}/top-outer-{nth}")
    # what lies above a source in the top tree lies above the superblock that its whole tree ends in
    named = tops.select(F.col("own"), F.col("pos").alias("_pos"))
    outer = outer.join(named, F.col("block") == F.col("_pos")).select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("block"), "level", "before", "after")
    for nth, tier in enumerate(reversed(tiers[1:])):
        outer = stored(outer_of(tier, outer, levels), f"{path}/outer-{nth}")
    root = top_tiers[-1].select(F.col("node").alias("root"))
    known = tops.select(F.col("own").alias("tree"), F.col("node").alias("subroot")).crossJoin(F.broadcast(root))  # one row
    return prove(leaves, outer, known, levels)
