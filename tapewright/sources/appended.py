"""Bar files that grow: a data source over ranges of records, and a store of adjusted bars that follows it.

``bar_files`` reads a folder of fixed-width bar files as a table or as a stream. A partition is a set of ranges of records, large
files are split and small ones put together, and the stream's offset is the number of records of each file, so a
file that has grown is read from its old end on. Offsets name each file, about 50 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..operators.adjust import adjusted_bars
from .fixed_width import BAR_RECORD, BARS_LAYOUT
from .shared import on_workers
from .store import replace_instruments

SCHEMA = f"{BARS_LAYOUT.schema}, record long"
#: records a partition, and records that are decoded at once
PARTITION_RECORDS, CHUNK_RECORDS = 4_000_000, 500_000


@dataclass
class Ranges(InputPartition):
    """(path, first record, end) of some files."""

    parts: list[tuple[str, int, int]]


def sizes(folder: str, suffix: str) -> dict[str, int]:
    """Whole records of each file of a folder; a record that is still being written doesn't count."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(base))
    return {f.path: f.size // BAR_RECORD.itemsize for f in found if f.is_file and f.path.endswith(suffix) and not f.base_name.startswith(".")}


def ranges(start: dict[str, int], end: dict[str, int], most: int) -> list[Ranges]:
    """The records that ``end`` has beyond ``start``, in partitions of about ``most`` records."""
    out: list[Ranges] = []
    left = 0
    for path in sorted(end):
        at = start.get(path, 0)
        if end[path] < at:
            raise ValueError(f"{path} has fewer records than were read from it; read it from the beginning with a new checkpoint")
        while at < end[path]:
            if not left:
                out.append(Ranges([]))
                left = most
            upto = min(end[path], at + left)
            out[-1].parts.append((path, at, upto))
            left -= upto - at
            at = upto
    return out


def _decoded(folder: str, parts: list[tuple[str, int, int]]) -> Iterator:
    import pyarrow as pa
    from pyarrow import fs

    kinds = {"date": pa.date32(), "symbol": pa.string(), "volume": pa.int64(), "record": pa.int64()}
    store, _ = fs.FileSystem.from_uri(folder)
    for path, first, end in parts:
        with store.open_input_file(path) as file:
            for at in range(first, end, CHUNK_RECORDS):
                upto = min(end, at + CHUNK_RECORDS)
                file.seek(at * BAR_RECORD.itemsize)
                rows = BARS_LAYOUT.decode(path, file.read((upto - at) * BAR_RECORD.itemsize))
                rows["record"] = rows.index + at
                schema = pa.schema([(c, kinds.get(c, pa.float64())) for c in rows.columns])
                yield pa.RecordBatch.from_pandas(rows, schema, preserve_index=False)


class _Batch(DataSourceReader):
    def __init__(self, folder: str, suffix: str, most: int):
        self.folder, self.suffix, self.most = folder, suffix, most

    def partitions(self) -> list[Ranges]:
        return ranges({}, sizes(self.folder, self.suffix), self.most) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator:
        return _decoded(self.folder, partition.parts)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str, most: int):
        self.folder, self.suffix, self.most = folder, suffix, most

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return sizes(self.folder, self.suffix)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return ranges(start, end, self.most)

    def read(self, partition: Ranges) -> Iterator:
        return _decoded(self.folder, partition.parts)

    def commit(self, end: dict) -> None:
        """Nothing is kept but the offset."""


class BarFiles(DataSource):
    """Options: path (a folder's address), suffix (.day) and records (a partition)."""

    @classmethod
    def name(cls) -> str:
        return "bar_files"

    def schema(self) -> str:
        return SCHEMA

    def _settings(self) -> tuple[str, str, int]:
        return self.options["path"], self.options.get("suffix", ".day"), int(self.options.get("records", PARTITION_RECORDS))

    def reader(self, schema) -> _Batch:
        return _Batch(*self._settings())

    def streamReader(self, schema) -> _Stream:
        return _Stream(*self._settings())


def register(spark: SparkSession) -> None:
    """Makes ``bar_files`` known to a session."""
    on_workers(spark)
    spark.dataSource.register(BarFiles)


def latest_records(bars: DataFrame) -> DataFrame:
    """One bar a day of an instrument: a day that comes again counts in its last record."""
    rest = [c for c in bars.columns if c not in ("symbol", "date", "record")]
    last = bars.groupBy("symbol", "date").agg(F.max_by(F.struct(*rest), "record").alias("_x"))
    return last.select("symbol", "date", *(F.col(f"_x.{c}").alias(c) for c in rest))


def readjust(symbols: DataFrame, raw: DataFrame, actions: DataFrame, table: str) -> None:
    """Adjusts the whole history of some instruments (symbol) again and replaces it in the store ``table``."""
    wanted = symbols.select(F.col("symbol").alias("_k")).distinct()
    own = raw.join(wanted, F.col("symbol") == F.col("_k"), "left_semi")
    replace_instruments(adjusted_bars(latest_records(own), actions), table)


def follow(spark: SparkSession, folder: str, raw: str, actions: DataFrame, table: str, checkpoint: str, every: str | None = None, **options: str) -> StreamingQuery:
    """Reads what the bar files of ``folder`` have gained, keeps it below ``raw`` and replaces the instruments concerned in ``table``.

    The store ``table`` exists. Each batch has its own folder below ``raw`` and overwrites it, and replacing an instrument twice is the same as
    once, so a batch that is run again does no harm. Without ``every`` it stops when all there is has been read.
    """
    register(spark)

    def take(batch: DataFrame, number: int) -> None:
        own = f"{raw}/batch={number}"
        batch.write.mode("overwrite").parquet(own)
        session = batch.sparkSession
        new = session.read.schema(batch.schema).parquet(own)
        readjust(new, session.read.schema(batch.schema).parquet(raw).drop("batch"), actions, table)

    stream = spark.readStream.format("bar_files").options(**options).load(folder)
    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
