"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every
id, level 1 the next chunk of the ids that have one, and so on. Each level but the
last has a bitmap that marks the ids that go on, and a rank directory with the
ones before every 512th bit; the rank of a bit is the place of its id on the next
level. Any token is found by a few reads at computed places, and no block is decoded.

File, all little-endian::

    magic "TWDC", version u32, documents u64, tokens u64, levels u32, 0 u32
    per level: entries u64, offset of chunks u64, of the bitmap u64, of the directory u64
    document ids i64 * documents, first token of each u64 * (documents + 1)
    the levels' chunks u8, bitmaps u8, directories u64

Documents are dealt to files by ranges of doc_id, so file order and order within the
files are the order of doc_id. A file is written under a name of its attempt and
then renamed, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, scratch, small_batches

MAGIC, VERSION, HEAD, LEVEL, STEP = b"TWDC", 1, "<4sIQQII", "<QQQQ", 512
FILE_TOKENS = 8_000_000
ENCODE_CHARS = 1 << 20
MANIFEST = "file string, part int, nth int, documents long, tokens long"


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes."""
    ids = ids.astype(np.uint32)
    levels, rest = [], ids
    while True:
        more = rest > 0xFF
        levels.append(((rest & 0xFF).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    first = np.zeros(len(doc_ids) + 1, "<u8")
    np.cumsum(lengths, out=first[1:])
    parts = [doc_ids.astype("<i8").tobytes(), first.tobytes()]
    at = struct.calcsize(HEAD) + struct.calcsize(LEVEL) * len(levels) + sum(map(len, parts))
    table = []
    for n, (chunks, more) in enumerate(levels):
        bits = np.packbits(more, bitorder="little") if n + 1 < len(levels) else np.zeros(0, np.uint8)
        ones = np.add.reduceat(more, np.arange(0, len(more), STEP), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)])[:-1].astype("<u8") if len(bits) else np.zeros(0, "<u8")
        own = [chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
        places = np.cumsum([at, *map(len, own)])
        table.append(struct.pack(LEVEL, len(chunks), *map(int, places[:3])))
        parts += own
        at = int(places[3])
    return b"".join([struct.pack(HEAD, MAGIC, VERSION, len(doc_ids), len(ids), len(levels), 0), *table, *parts])


class Reader:
    """Random access to one file; ``source`` has seek() and read()."""

    def __init__(self, source):
        self.source = source
        magic, version, self.documents, self.tokens, levels, _ = struct.unpack(HEAD, self._at(0, struct.calcsize(HEAD)))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a file of token codes")
        size = struct.calcsize(LEVEL)
        self.levels = [struct.unpack(LEVEL, self._at(struct.calcsize(HEAD) + size * k, size)) for k in range(levels)]
        self.table = struct.calcsize(HEAD) + size * levels

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def rank(self, level: int, i: int) -> int:
        """Ids before the i-th of a level that go on to the next."""
        entries, _, bitmap, ranks = self.levels[level]
        if i >= entries and i % STEP == 0:
            return self.levels[level + 1][0]
        block = i // STEP
        before = int.from_bytes(self._at(ranks + 8 * block, 8), "little")
        bits = int.from_bytes(self._at(bitmap + block * STEP // 8, (i % STEP + 7) // 8), "little")
        return before + (bits & ((1 << i % STEP) - 1)).bit_count()

    def token(self, i: int) -> int:
        """The i-th id of the file."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            value |= self._at(chunks + i, 1)[0] << 8 * level
            if level + 1 == len(self.levels) or not self._at(bitmap + i // 8, 1)[0] >> i % 8 & 1:
                break
            i = self.rank(level, i)
        return value

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end - 1, level by level."""
        out = np.zeros(end - begin, np.uint32)
        where = np.arange(end - begin)
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            if begin == end:
                break
            out[where] |= np.frombuffer(self._at(chunks + begin, end - begin), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            if level + 1 == len(self.levels):
                break
            bits = np.unpackbits(np.frombuffer(self._at(bitmap + begin // 8, (end + 7) // 8 - begin // 8), np.uint8), bitorder="little")
            more = bits[begin % 8 : begin % 8 + end - begin].astype(bool)
            begin = self.rank(level, begin)
            end, where = begin + int(more.sum()), where[more]
        return out

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """The documents' ids, and the first token of each and of the end."""
        n = self.documents
        raw = self._at(self.table, 8 * (2 * n + 1))
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n + 1, 8 * n).astype(np.int64)


class Encoder:
    """Ids of whole texts, each encoded by one call's batch of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        own = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *own]), np.fromiter(map(len, own), np.int64, len(own))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> DataFrame:
    """Encodes every whole text and writes the files below ``path``; one row per file: file, part, nth, documents, tokens.

    Null texts are empty. Every document ends with ``end_id``. Ties of doc_id stand in the
    order of their texts; null ids come first and are stored as -2**63. Other columns are
    ignored; an empty table writes no file.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store.create_dir(base, recursive=True)
        held: list[tuple[list[int], np.ndarray, np.ndarray]] = []  # document ids, tokens, tokens of each document
        size = nth = 0

        def flush():
            nonlocal held, size, nth
            doc_ids, ids, lengths = (np.concatenate(c) for c in zip(*held, strict=True))
            packed = pack(doc_ids.astype("<i8"), lengths, ids)
            name = f"{base}/codes-{part:06d}-{nth:04d}"
            with store.open_output_stream(f"{name}.attempt-{attempt}") as out:
                out.write(packed)
            store.move(f"{name}.attempt-{attempt}", name)
            row = [[f"{path}/codes-{part:06d}-{nth:04d}"], [part], [nth], [len(doc_ids)], [len(ids)]]
            held, size, nth = [], 0, nth + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["file", "part", "nth", "documents", "tokens"])

        doc_ids: list[int] = []
        texts: list[str] = []

        def encode():
            nonlocal doc_ids, texts, size
            ids, lengths = _encoder(tokenizer).encode(texts)
            ends = np.cumsum(lengths)
            held.append((doc_ids, np.insert(ids, ends, end_id), lengths + 1))  # the end id after each document
            size += len(ids) + len(lengths)
            doc_ids, texts = [], []

        chars = 0
        for batch in batches:
            doc_ids += [-(2**63) if d is None else d for d in batch.column(0).to_pylist()]
            texts += [t or "" for t in batch.column(1).to_pylist()]
            chars += sum(map(len, texts[-batch.num_rows :])) if batch.num_rows else 0
            if chars >= ENCODE_CHARS:
                encode()
                chars = 0
                if size >= FILE_TOKENS:
                    yield flush()
        if texts:
            encode()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = dealt.mapInArrow(run, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files of a manifest."""
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as source:
                    reader = Reader(source)
                    doc_ids, first = reader.index()
                    crcs = []
                    for low in range(0, len(doc_ids), 1000):  # a run of documents at a time
                        high = min(low + 1000, len(doc_ids))
                        ids = reader.slice(int(first[low]), int(first[high])).astype("<u4")
                        crcs += [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first[low:high] - first[low], first[low + 1 : high + 1] - first[low], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if d == -(2**63) else d for d in doc_ids.tolist()], pa.int64()), pa.array(first[:-1] + start, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # an explicit number: one row a file is little data, but each row stands for a whole file
    return files.select("file", "start").repartition(partitions(manifest.sparkSession), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    return read_files(write_files(docs, tokenizer, scratch(docs.sparkSession, "token-codes"), end_id))
