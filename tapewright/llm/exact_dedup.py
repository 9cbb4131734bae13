"""Exact duplicates by an extendible-hash index on shared files.

Key ranges (the top bits of a text's hash) are dealt to owner tasks, which get the texts of a range
in the order of their hashes, so an owner holds the texts of one hash at a time. Entries with
one hash form a chain and are told apart by comparing the bytes of the normalised texts. An
owner keeps one extendible-hash directory a range: a bucket that grows over its capacity
is split by one more bit of the hash, and where its depth reaches the directory's, the
directory doubles. Directories and buckets are written to the shared folder by Spark's Parquet writer
(so a task that is lost and run again leaves one copy).

Every document is then looked up in that index: owner tasks read the directory and the
buckets of a range again and answer each key by its slot, its bucket and its chain. A chain's
entries carry the SHA-256 of their text; that no two different texts of a chain share it was
seen when their bytes were compared.

Before the texts are dealt out each task merges the equal texts it has read, so a
text that a third of all rows share reaches its owner once a task, not once a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import partitions, scratch, small_batches

SPACE = b" \t\n\x0b\x0c\r"
#: a row with a directory has the directory's depth and its slots' bucket numbers; the others are entries
ENTRY = "key_range int, bucket long, depth int, hash long, chain int, text_sha256 string, keep_id long, group_size long, directory binary"
_ENTRY = pa.schema([("key_range", pa.int32()), ("bucket", pa.int64()), ("depth", pa.int32()), ("hash", pa.int64()), ("chain", pa.int32()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("directory", pa.binary())])
MERGED = pa.schema([("key_range", pa.int32()), ("hash", pa.int64()), ("text", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
FLUSH_BYTES = 24 << 20


def normal(text: bytes | None) -> bytes:
    """Each run of the six ASCII white-space characters becomes one space; a null is empty."""
    if not text:
        return b""
    out = b" ".join(text.split())
    if text[0] in SPACE:
        out = b" " + out if out else b" "
    if out != b" " and text[-1] in SPACE:
        out += b" "
    return out


def hash_of(digest: bytes, hash_bits: int) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - hash_bits)


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Chain:
    """The different texts of one hash."""

    def __init__(self):
        self.entries: list[list] = []  # text, SHA-256, keep_id, group_size

    def add(self, text: bytes, keep: int | None, n: int) -> None:
        for entry in self.entries:
            if entry[0] == text:
                entry[2] = smaller(entry[2], keep)
                entry[3] += n
                return
        digest = hashlib.sha256(text).hexdigest()
        if any(entry[1] == digest for entry in self.entries):
            raise ValueError("two different texts share a SHA-256")
        self.entries.append([text, digest, keep, n])


class KeyRange:
    """An extendible-hash directory for one range of hashes of ``bits`` bits; entries are (SHA-256, keep_id, group_size)."""

    def __init__(self, bits: int, capacity: int):
        self.bits, self.capacity, self.depth = bits, capacity, 0
        self.directory = [{"depth": 0, "size": 0, "chains": {}}]

    def slot(self, h: int) -> int:
        return h >> (self.bits - self.depth)

    def add(self, h: int, entries: list[tuple]) -> None:
        """Adds a whole chain."""
        bucket = self.directory[self.slot(h)]
        bucket["chains"][h] = entries
        bucket["size"] += len(entries)
        while bucket["size"] > self.capacity and len(bucket["chains"]) > 1 and bucket["depth"] < self.bits:
            bucket = self.split(bucket, h)

    def split(self, bucket: dict, h: int) -> dict:
        if bucket["depth"] == self.depth:
            self.directory = [b for b in self.directory for _ in range(2)]
            self.depth += 1
        depth = bucket["depth"] + 1
        halves = [{"depth": depth, "size": 0, "chains": {}} for _ in range(2)]
        for key, chain in bucket["chains"].items():
            half = halves[key >> (self.bits - depth) & 1]
            half["chains"][key] = chain
            half["size"] += len(chain)
        width = 1 << (self.depth - depth)
        first = (h >> (self.bits - depth) >> 1 << 1) * width
        for at in range(2 * width):
            self.directory[first + at] = halves[at // width]
        return self.directory[self.slot(h)]

    def numbers(self) -> list[int]:
        """The bucket of each slot: the first slot that has it."""
        first: dict[int, int] = {}
        return [first.setdefault(id(bucket), slot) for slot, bucket in enumerate(self.directory)]

    def entries(self) -> Iterator[tuple]:
        for slot, number in enumerate(self.numbers()):
            if slot == number:
                bucket = self.directory[slot]
                for h, chain in bucket["chains"].items():
                    for at, (digest, keep, n) in enumerate(chain):
                        yield slot, bucket["depth"], h, at, digest, keep, n

    def rows(self, key_range: int) -> pa.RecordBatch:
        own = [(key_range, *e, None) for e in self.entries()]
        own.append((key_range, -1, self.depth, None, None, None, None, None, np.array(self.numbers(), "<i8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own, strict=True), _ENTRY, strict=True)], schema=_ENTRY)


class Stored:
    """A key range's index as it was read from the shared folder."""

    def __init__(self, bits: int, depth: int, directory: bytes):
        self.bits, self.depth, self.numbers = bits, depth, np.frombuffer(directory, "<i8").tolist()
        self.buckets: dict[int, dict[int, list[tuple]]] = {}

    def add(self, bucket: int, h: int, digest: str, keep: int | None, n: int) -> None:
        self.buckets.setdefault(bucket, {}).setdefault(h, []).append((digest, keep, n))

    def find(self, h: int, digest: str) -> tuple[int | None, int | None]:
        """keep_id and group_size: directory, bucket, chain."""
        for own, keep, n in self.buckets.get(self.numbers[h >> (self.bits - self.depth)], {}).get(h, ()):
            if own == digest:
                return keep, n
        return None, None


def _merge(range_bits: int, hash_bits: int):
    def run(batches):
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            hashes = [hash_of(hashlib.sha256(t).digest(), hash_bits) for t in held]
            columns = ([h >> (hash_bits - range_bits) for h in hashes], [h & ((1 << (hash_bits - range_bits)) - 1) for h in hashes], list(held), *zip(*held.values(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MERGED, strict=True)], schema=MERGED)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = normal(text)
                seen = held.get(text)
                if seen is None:
                    held[text] = [doc_id, 1]
                    size += len(text) + 100
                    if size > FLUSH_BYTES:
                        yield flush()
                        held, size = {}, 0
                else:
                    seen[0] = smaller(seen[0], doc_id)
                    seen[1] += 1
        if held:
            yield flush()

    return run


def _own(range_bits: int, hash_bits: int, capacity: int):
    """Rows of MERGED by key range and hash: a directory and entries a range. Only one chain's texts are held."""

    def run(batches):
        key, own, h, chain = None, None, None, Chain()
        for batch in batches:
            for key_range, now, text, keep, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chain.entries and (key_range, now) != (key, h):
                    own.add(h, [tuple(e[1:]) for e in chain.entries])
                    chain = Chain()
                if key_range != key:
                    if own is not None:
                        yield own.rows(key)
                    key, own = key_range, KeyRange(hash_bits - range_bits, capacity)
                h = now
                chain.add(text, keep, n)
        if own is not None:
            own.add(h, [tuple(e[1:]) for e in chain.entries])
            yield own.rows(key)

    return run


def build_index(docs: DataFrame, path: str | None = None, capacity: int = 256, hash_bits: int = 63, range_bits: int | None = None) -> DataFrame:
    """Writes the index of ``docs`` (doc_id, text) and returns its rows: an entry per distinct normalised text, and a directory per key range.

    range_bits: log2 of the number of key ranges; by default four ranges or more a
    shuffle partition, 256 at least. hash_bits is lowered only in tests, to force collisions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    range_bits = _range_bits(spark, hash_bits) if range_bits is None else range_bits
    merged = docs.select("doc_id", "text").mapInArrow(_merge(range_bits, hash_bits), "key_range int, hash long, text binary, keep_id long, group_size long")
    rows = merged.repartition("key_range").sortWithinPartitions("key_range", "hash").mapInArrow(_own(range_bits, hash_bits, capacity), ENTRY)
    path = path or scratch(spark, "exact-index")
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(ENTRY).parquet(path)


def _range_bits(spark, hash_bits: int) -> int:
    return min(hash_bits, max(8, (4 * partitions(spark) - 1).bit_length()))


def _keys(range_bits: int, hash_bits: int):
    def run(batches):
        for batch in batches:
            digests = [hashlib.sha256(normal(t)).digest() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            hashes = [hash_of(d, hash_bits) for d in digests]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h >> (hash_bits - range_bits) for h in hashes], pa.int32()), pa.array([h & ((1 << (hash_bits - range_bits)) - 1) for h in hashes], pa.int64()), pa.array([d.hex() for d in digests], pa.string())],
                names=["doc_id", "key_range", "hash", "text_sha256"],
            )

    return run


FOUND = "doc_id long, keep_id long, group_size long, text_sha256 string"


def _answer(bits: int):
    """Rows by key range: its directory (kind 0), its entries (1), the keys that are looked up (2), and rows that have their answer (3)."""

    def run(batches):
        key, own = None, None
        for batch in batches:
            out: list[tuple] = []
            for key_range, kind, doc_id, h, digest, bucket, depth, keep, n, directory in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key_range != key:
                    key, own = key_range, None
                if kind == 0:
                    own = Stored(bits, depth, directory)
                elif kind == 1:
                    own.add(bucket, h, digest, keep, n)
                elif kind == 2:
                    out.append((doc_id, *(own.find(h, digest) if own is not None else (None, None)), digest))
                else:
                    out.append((doc_id, keep, n, digest))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "keep_id", "group_size", "text_sha256"])

    return run


def look_up(docs: DataFrame, index: DataFrame, hash_bits: int = 63, range_bits: int | None = None, hot_share: int = 500) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``; a text that is not in the index has no keep_id.

    Groups that hold more than one row in ``hot_share`` are at most hot_share many; those entries
    are broadcast, so their rows stay where they are. All other keys go to the owner tasks of
    their ranges. hash_bits and range_bits are those the index was built with.
    """
    spark = docs.sparkSession
    small_batches(spark)
    range_bits = _range_bits(spark, hash_bits) if range_bits is None else range_bits
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_keys(range_bits, hash_bits), "doc_id long, key_range int, hash long, text_sha256 string")
    total = index.agg(F.sum("group_size")).first()[0] or 0
    hot = index.where(F.col("group_size") > max(1000, total // hot_share)).select(F.col("text_sha256").alias("_sha"), "keep_id", "group_size")
    met = keyed.join(F.broadcast(hot), F.col("text_sha256") == F.col("_sha"), "left")
    none = lambda kind: F.lit(None).cast(kind)
    is_hot = F.col("_sha").isNotNull()
    asked = met.select(
        F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(1 << range_bits)).cast("int")).otherwise(F.col("key_range")).alias("key_range"),
        F.when(is_hot, 3).otherwise(2).alias("kind"), "doc_id", "hash", "text_sha256",
        none("long").alias("bucket"), none("int").alias("depth"), "keep_id", "group_size", none("binary").alias("directory"),
    )
    kind = F.when(F.col("directory").isNotNull(), 0).otherwise(1)
    held = index.select("key_range", kind.alias("kind"), none("long").alias("doc_id"), "hash", "text_sha256", "bucket", "depth", "keep_id", "group_size", "directory")
    found = held.unionByName(asked).repartition("key_range").sortWithinPartitions("key_range", "kind").mapInArrow(_answer(hash_bits - range_bits), FOUND)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, capacity: int = 256) -> DataFrame:
    """One row per row of ``docs``, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and all empty texts are one group. Of equal texts
    the smallest doc_id stays; a null id stays only if no other id has the text. Rows
    repeated with the same id are one document and share their verdict. Other
    columns are ignored; an empty table gives no rows.
    """
    return look_up(docs, build_index(docs, capacity=capacity))


__all__ = ["build_index", "dedup", "look_up", "normal", "KeyRange", "Stored"]
