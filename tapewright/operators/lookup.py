"""Searches over blocks, industries and instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .universe import latest_n


def list_blocks(blocks: DataFrame, category: str) -> DataFrame:
    return blocks.where(F.col("block_category") == category).select("block_name").distinct()


def search_blocks(blocks: DataFrame, keyword: str) -> DataFrame:
    """block_name, block_category, members, exact and single of the blocks whose name holds the keyword, in any case.

    exact: the name is the keyword. single: it is the only hit. Either means that a
    caller may go on to the block's members.
    """
    held = blocks.where(F.contains(F.lower("block_name"), F.lit(keyword.lower())))
    found = held.groupBy("block_name", "block_category").agg(F.count_distinct("market", "code").alias("members"))
    hits = F.broadcast(held.agg(F.count_distinct("block_name").alias("_hits")))
    return found.crossJoin(hits).select("block_name", "block_category", "members", (F.lower("block_name") == keyword.lower()).alias("exact"), (F.col("_hits") == 1).alias("single"))


def block_members(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.where(F.col("block_name") == name).select(F.concat(F.upper("market"), F.col("code")).alias("symbol")).distinct()


def instrument_blocks(blocks: DataFrame, industries: DataFrame, symbol: str) -> DataFrame:
    """category and names (sorted, comma-joined) of what an instrument belongs to, industries included."""
    own = blocks.where(F.concat("market", "code") == symbol).select(F.col("block_category").alias("category"), F.col("block_name").alias("name"))
    both = own.unionByName(industries.where(F.col("symbol") == symbol).select(F.lit("industry").alias("category"), F.col("industry_name").alias("name")))
    return both.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))


def keyword_members(blocks: DataFrame, industries: DataFrame, names: DataFrame, keyword: str) -> DataFrame:
    """symbol, name and origin of the members of industries, then blocks, whose name holds the keyword; each symbol once."""
    by_industry = industries.where(F.contains("industry_name", F.lit(keyword))).select(F.lower("symbol").alias("_s"), F.lit(0).alias("_rank"), F.lit("industry").alias("origin"))
    by_block = blocks.where(F.contains("block_name", F.lit(keyword))).select(F.lower(F.concat("market", "code")).alias("_s"), F.lit(1).alias("_rank"), F.lit("block").alias("origin"))
    first = by_industry.unionByName(by_block).withColumn("_nth", F.row_number().over(Window.partitionBy("_s").orderBy("_rank"))).where("_nth = 1")
    return first.join(names, F.col("_s") == F.col("symbol"), "left").select(F.upper("_s").alias("symbol"), F.coalesce("name", F.lit("")).alias("name"), "origin")


def initials_of(names: DataFrame, letters: DataFrame) -> DataFrame:
    """names (symbol, name, ...) with initials from a lookup table (char, initial); characters it lacks stand for themselves. A symbol may have several names."""
    chars = names.select("symbol", "name").distinct().select("symbol", "name", F.posexplode(F.split("name", "")).alias("_at", "_char")).where("_char != ''")
    known = chars.join(letters, F.col("_char") == F.col("char"), "left").withColumn("_i", F.coalesce("initial", F.lower("_char")))
    joined = known.groupBy(F.col("symbol").alias("_s"), F.col("name").alias("_n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_i"))), lambda x: x["_i"]), "").alias("initials"))
    return names.join(joined, (F.col("symbol") == F.col("_s")) & (F.col("name") == F.col("_n")), "left").drop("_s", "_n")


def search_instruments(names: DataFrame, q: str, limit: int = 15) -> DataFrame:
    """The first hits of a query by id, name, or initials (initials_alt where there is such a column)."""
    q = q.strip().lower()

    def by_initials(col: str):
        c = F.coalesce(F.col(col), F.lit(""))
        longer = (F.length(c) >= 3) & F.startswith(F.lit(q), c) & (F.lit(len(q)) - F.length(c) <= 1)
        return (F.length(c) > 0) & (c.startswith(q) | longer)

    hit = F.substring("symbol", 3, 6).startswith(q) | F.col("symbol").startswith(q) | F.contains(F.lower("name"), F.lit(q)) | by_initials("initials")
    if "initials_alt" in names.columns:
        hit = hit | by_initials("initials_alt")
    found = names.where(hit if q else F.lit(False))
    return found.orderBy("symbol").limit(limit).select(F.upper("symbol").alias("symbol"), "name", "initials")


def recent_bars(bars: DataFrame, symbol: str, n: int = 10) -> DataFrame:
    """The latest n bars of an instrument, with the number and the span of all its bars on every row."""
    own = bars.where(F.col("symbol") == symbol)
    whole = Window.partitionBy("symbol")
    spanned = own.withColumns({"bars": F.count(F.lit(1)).over(whole), "first_date": F.min("date").over(whole), "last_date": F.max("date").over(whole)})
    return latest_n(spanned, n).drop("rn")
