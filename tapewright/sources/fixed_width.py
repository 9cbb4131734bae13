"""Fixed-width binary files: bars, instrument names, block memberships. One task decodes a group of files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import on_workers

# fixed values: record formats of the three kinds of files
BAR_RECORD = np.dtype([("date", "<i4"), ("open", "<i4"), ("high", "<i4"), ("low", "<i4"), ("close", "<i4"), ("amount", "<f4"), ("volume", "<i4"), ("reserved", "<i4")])
NAMES_HEADER, NAMES_RECORD = 50, np.dtype([("code", "S6"), ("gap", "V25"), ("name", "S20"), ("rest", "V309")])
BLOCKS_HEADER, BLOCK_SIZE, BLOCK_CODES = 384, 2813, 400
BLOCK_RECORD = np.dtype([("name", "S9"), ("n", "<u2"), ("type", "<u2"), ("codes", "S7", BLOCK_CODES)])


@dataclass(frozen=True)
class Layout:
    """How a file's bytes become rows: ``decode`` gets the path and the content."""

    schema: str
    decode: Callable[[str, bytes], pd.DataFrame]


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("gbk", "ignore").strip()


def _bars(path: str, content: bytes) -> pd.DataFrame:
    rows = np.frombuffer(content, BAR_RECORD, len(content) // BAR_RECORD.itemsize)
    dates = pd.to_datetime(pd.Series(rows["date"].astype(str)), format="%Y%m%d", errors="coerce").dt.date
    out = pd.DataFrame({"symbol": re.sub(r"\..*$", "", path.rsplit("/", 1)[-1]).lower(), "date": dates})
    for c in ("open", "high", "low", "close"):
        out[c] = rows[c] / 100.0
    out["amount"] = rows["amount"].astype("float64")
    out["volume"] = rows["volume"].astype("int64")
    return out[out["date"].notna()]


def _names(path: str, content: bytes) -> pd.DataFrame:
    rows = np.frombuffer(content, NAMES_RECORD, (len(content) - NAMES_HEADER) // NAMES_RECORD.itemsize, NAMES_HEADER)
    market = path.rsplit("/", 1)[-1][:2].lower()
    pairs = [(c.decode("ascii", "ignore"), _text(n)) for c, n in zip(rows["code"].tolist(), rows["name"].tolist(), strict=True)]
    return pd.DataFrame([(market + c, n) for c, n in pairs if len(c) == 6], columns=["symbol", "name"])


def _blocks(path: str, content: bytes) -> pd.DataFrame:
    count = int.from_bytes(content[BLOCKS_HEADER : BLOCKS_HEADER + 2], "little")
    found = []
    for k in range(count):
        at = BLOCKS_HEADER + 2 + k * BLOCK_SIZE
        if at + BLOCK_RECORD.itemsize > len(content):
            break
        row = np.frombuffer(content, BLOCK_RECORD, 1, at)[0]
        name = _text(bytes(row["name"]))
        if name:
            found += [(name, int(row["type"]), c.decode("ascii", "ignore")) for c in row["codes"][: int(row["n"])].tolist() if c]
    return pd.DataFrame(found, columns=["block_name", "block_type_id", "raw_code"])


BARS_LAYOUT = Layout("symbol string, date date, open double, high double, low double, close double, amount double, volume long", _bars)
NAMES_LAYOUT = Layout("symbol string, name string", _names)
BLOCKS_LAYOUT = Layout("block_name string, block_type_id int, raw_code string", _blocks)


def read_fixed_width(spark: SparkSession, glob: str, layout: Layout) -> DataFrame:
    """Rows of all files of a glob; records with an invalid date or code are left out."""
    on_workers(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield layout.decode(path, content)

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, layout.schema)


def encode_bars(rows: pd.DataFrame) -> bytes:
    """The bytes of a bar file of one instrument (date, prices, amount, volume), in date order."""
    rows = rows.sort_values("date")
    out = np.zeros(len(rows), BAR_RECORD)
    days = rows["date"].to_numpy().astype("datetime64[D]")
    months = days.astype("datetime64[M]")
    out["date"] = (months.astype(int) // 12 + 1970) * 10_000 + (months.astype(int) % 12 + 1) * 100 + (days - months).astype(int) + 1
    for c in ("open", "high", "low", "close"):
        out[c] = np.rint(rows[c].to_numpy() * 100).astype("i4")
    out["amount"], out["volume"] = rows["amount"], rows["volume"]
    return out.tobytes()


def encode_names(rows: list[tuple[str, str]]) -> bytes:
    out = np.zeros(len(rows), NAMES_RECORD)
    out["code"], out["name"] = [c.encode() for c, _ in rows], [n.encode("gbk") for _, n in rows]
    return bytes(NAMES_HEADER) + out.tobytes()


def encode_blocks(blocks: list[tuple[str, int, list[str]]]) -> bytes:
    """The bytes of a block file; a block of more than BLOCK_CODES codes takes several records of its name."""
    records = [(name, kind, codes[k : k + BLOCK_CODES]) for name, kind, codes in blocks for k in range(0, max(len(codes), 1), BLOCK_CODES)]
    parts = [bytes(BLOCKS_HEADER), len(records).to_bytes(2, "little")]
    for name, kind, codes in records:
        row = np.zeros(1, BLOCK_RECORD)
        row["name"], row["n"], row["type"] = name.encode("gbk"), len(codes), kind
        row["codes"][0, : len(codes)] = [c.encode() for c in codes]
        parts.append(row.tobytes().ljust(BLOCK_SIZE, b"\0"))
    return b"".join(parts)


def in_parts(rows: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """``rows`` with ``-`` and a part's number added to ``key``, so that a part, dealt by the hash of ``by``, has about ``most`` rows."""
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts"))
    part = F.pmod(F.xxhash64(by), F.col("_parts")).cast("string")
    return rows.join(counts, F.col(key) == F.col("_key")).withColumn(key, F.concat_ws("-", key, part)).drop("_key", "_parts")


def write_files(rows: DataFrame, key: str, encode: Callable[[pd.DataFrame], bytes], folder: str, suffix: str) -> DataFrame:
    """Writes one file a value of ``key`` (its rows are one group) through pyarrow's file systems; returns the key and the bytes.

    A file is written under the name of its attempt and then renamed, so a repeated task leaves one whole file.
    """

    on_workers(rows.sparkSession)

    def write(group: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, content = group[key].iloc[0], encode(group)
        attempt = f"{base}/.{name}-{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(attempt) as out:
            out.write(content)
        target = f"{base}/{name}{suffix}"
        if store.get_file_info(target).type != fs.FileType.NotFound:  # not all file systems rename onto a file
            store.delete_file(target)
        store.move(attempt, target)
        return pd.DataFrame({key: [name], "bytes": [len(content)]})

    return rows.groupBy(key).applyInPandas(write, f"{key} string, bytes long")
