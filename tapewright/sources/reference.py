"""Reference data: block and industry memberships, sections of dictionary files, corporate actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.symbols import normalize_code

OTHER_INDUSTRY = "other"


def build_block_mappings(parts: dict[str, DataFrame]) -> DataFrame:
    """One membership table from raw ones (block_name, block_type_id, raw_code) by category."""
    rows = [df.select("block_name", "block_type_id", F.lit(category).alias("block_category"), normalize_code(F.col("raw_code")).alias("_c")) for category, df in parts.items()]
    return reduce(DataFrame.unionByName, rows).select("block_name", "block_type_id", "block_category", F.col("_c.code").alias("code"), F.col("_c.market").alias("market"))


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """file, line_no (in order within the file) and value of text files."""
    lines = spark.read.option("encoding", encoding).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    return lines.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def read_section(lines: DataFrame, name: str) -> DataFrame:
    """The lines (file, line_no, value) between ``#name`` and the next line that begins with #."""
    header = F.when(F.col("value").startswith("#"), F.trim(F.substring("value", 2, 1000)))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_section", F.last(header, ignorenulls=True).over(w))
    return marked.where((F.col("_section") == name) & ~F.col("value").startswith("#") & (F.trim("value") != "")).drop("_section")


def build_industry_mappings(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """symbol, industry_code and industry_name from lines "market|code|industry" and a dictionary (industry_code, industry_name).

    Market 0 is sz, 1 sh, others bj; an industry code counts by its first five characters; codes the dictionary
    lacks get the name ``other``.
    """
    parts = F.split("value", "\\|")
    market = F.when(parts[0] == "0", "sz").when(parts[0] == "1", "sh").otherwise("bj")
    rows = lines.where(F.size(parts) >= 3).select(F.concat(market, parts[1]).alias("symbol"), F.substring(parts[2], 1, 5).alias("industry_code"))
    named = dictionary.select(F.col("industry_code").alias("_c"), "industry_name")
    return rows.join(named, F.col("industry_code") == F.col("_c"), "left").select("symbol", "industry_code", F.coalesce("industry_name", F.lit(OTHER_INDUSTRY)).alias("industry_name"))


def clean_actions(raw: DataFrame) -> DataFrame:
    """Corporate actions with a valid yyyymmdd date, in order of (code, date)."""
    text = F.col("date").cast("string")
    parsed = raw.withColumn("date", F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd")))
    return parsed.where(F.col("date").isNotNull()).orderBy("code", "date")
