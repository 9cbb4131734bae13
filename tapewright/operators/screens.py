"""Factor screens with sector resonance, their combination, and a catalogue of named strategies."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators as I  # noqa: E741
from .market import WARMUP_DAYS
from .universe import at_latest, latest_window

REQUIRED = ("symbol", "Close", "Vol_Ratio")


def factors(bars: DataFrame, mas: tuple[int, ...] = I.MA_LENGTHS) -> DataFrame:
    """Bars with ma<n>, vol_ma5, Vol_Ratio and Dev_MA20_Pct, in one window pass."""
    rated = I.with_means(I.with_means(bars, "close_adj", {f"ma{n}": n for n in sorted({*mas, 20})}), "volume", {"vol_ma5": 5}, scale=1)
    return rated.withColumns({"Vol_Ratio": I.ratio(F.col("volume"), F.col("vol_ma5")), "Dev_MA20_Pct": I.deviation_pct("close_adj", "ma20")})


def volume_breakout(mult: float = 1.5) -> Column:
    """Close above its 20-row average on more than ``mult`` times the 5-row average volume."""
    return (F.col("close_adj") > F.col("ma20")) & (F.col("volume") > mult * F.col("vol_ma5"))


def long_sequence(mult: float = 1.2, mas: tuple[int, ...] = I.MA_LENGTHS) -> Column:
    """All averages in order, the shortest highest, on at least ``mult`` times the 5-row average volume."""
    return I.bull_aligned([f"ma{n}" for n in mas]) & (F.col("volume") >= mult * F.col("vol_ma5"))


def resonance(picked: DataFrame, blocks: DataFrame, min_count: int = 3) -> DataFrame:
    """Picked rows (symbol, date, close_adj, Vol_Ratio, Dev_MA20_Pct) that share a concept block with enough others that date.

    Only picked rows meet the memberships. Output: date, symbol, Close, Vol_Ratio, Dev_MA20_Pct and
    Resonance_Sectors, the sorted list of "block(n/pct%)" with pct the share of the block's members.
    """
    members = blocks.where(F.col("block_category") == "concept").select(F.concat("market", "code").alias("_s"), "block_name").distinct()
    sizes = members.groupBy(F.col("block_name").alias("_b")).agg(F.count(F.lit(1)).alias("_size"))
    hits = picked.join(members, F.col("symbol") == F.col("_s")).select("date", "symbol", "block_name")
    strong = hits.groupBy(F.col("date").alias("_d"), F.col("block_name").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count)
    pct = F.format_string("%.1f", F.round(F.col("_n") * 100.0 / F.col("_size"), 1))
    labels = (
        hits.join(strong, (F.col("date") == F.col("_d")) & (F.col("block_name") == F.col("_k")))
        .join(sizes, F.col("block_name") == F.col("_b"))
        .groupBy(F.col("date").alias("_date"), F.col("symbol").alias("_symbol"))
        .agg(F.array_join(F.array_sort(F.collect_list(F.concat("block_name", F.lit("("), F.col("_n").cast("string"), F.lit("/"), pct, F.lit("%)")))), ", ").alias("Resonance_Sectors"))
    )
    return picked.join(labels, (F.col("date") == F.col("_date")) & (F.col("symbol") == F.col("_symbol"))).select(
        "date", "symbol", F.col("close_adj").alias("Close"), "Vol_Ratio", "Dev_MA20_Pct", "Resonance_Sectors"
    )


def _screen(bars: DataFrame, blocks: DataFrame, condition: Column, mas: tuple[int, ...], min_count: int, date: str | None, warmup_days: int) -> DataFrame:
    """One date's screen: only the ``warmup_days`` days up to it are read, and averages see no rows before them."""
    recent, day = latest_window(bars, warmup_days, date=date)
    today = at_latest(factors(recent, mas), date=day)
    return resonance(today.where(condition), blocks, min_count).drop("date").orderBy(F.desc("Vol_Ratio"), "symbol")


def resonance_breakout(bars: DataFrame, blocks: DataFrame, mult: float = 1.5, min_count: int = 3, date: str | None = None, warmup_days: int = WARMUP_DAYS) -> DataFrame:
    return _screen(bars, blocks, volume_breakout(mult), (20,), min_count, date, warmup_days)


def ma_long_sequence(bars: DataFrame, blocks: DataFrame, mult: float = 1.2, mas: tuple[int, ...] = I.MA_LENGTHS, min_count: int = 3, date: str | None = None, warmup_days: int = WARMUP_DAYS) -> DataFrame:
    return _screen(bars, blocks, long_sequence(mult, mas), mas, min_count, date, warmup_days)


def dual_resonance(bars: DataFrame, blocks: DataFrame, mult: float = 1.5, mas: tuple[int, ...] = I.MA_LENGTHS, min_count: int = 3, date: str | None = None, warmup_days: int = WARMUP_DAYS) -> DataFrame:
    return _screen(bars, blocks, volume_breakout(mult) & I.bull_aligned([f"ma{n}" for n in mas]), mas, min_count, date, warmup_days)


def intersect(*results: DataFrame) -> DataFrame:
    """Symbols in all results; the first one's columns win, later ones get the suffix _other (then _other2, ...)."""
    out = results[0]
    for nth, other in enumerate(results[1:], 1):
        suffix = "_other" if nth == 1 else f"_other{nth}"
        renamed = other.select(F.col("symbol").alias("_s"), *(F.col(c).alias(c + suffix if c in out.columns else c) for c in other.columns if c != "symbol"))
        out = out.join(renamed, F.col("symbol") == F.col("_s")).drop("_s")
    return out


def merge_sectors(df: DataFrame, cols: list[str], name: str = "Sectors") -> DataFrame:
    """Adds the sorted distinct union of comma-joined lists."""
    lists = [F.when(F.length(F.coalesce(F.col(c), F.lit(""))) > 0, F.split(c, ", ")).otherwise(F.array().cast("array<string>")) for c in cols]
    return df.withColumn(name, F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*lists)))), ", "))


def with_slopes(result: DataFrame, bars: DataFrame, lengths: tuple[int, ...] = (20, 30), k: int = 5, warmup_days: int = WARMUP_DAYS) -> DataFrame:
    """Adds slope_ma<n> of the latest bar of each selected symbol within ``warmup_days`` days; 0 where there is none."""
    recent, _ = latest_window(bars, warmup_days)
    picked = recent.join(result.select(F.col("symbol").alias("_p")).distinct(), F.col("symbol") == F.col("_p"), "left_semi")
    averaged = I.with_means(picked, "close_adj", {f"_ma{n}": n for n in lengths})
    sloped = averaged.withColumns({f"slope_ma{n}": I.slope_pct(f"_ma{n}", k) for n in lengths} | {"_rn": I.recency_rank()}).where("_rn = 1")
    own = sloped.select(F.col("symbol").alias("_s"), *(F.col(f"slope_ma{n}").alias(f"_sl{n}") for n in lengths))
    return result.join(own, F.col("symbol") == F.col("_s"), "left").select(*result.columns, *(F.coalesce(f"_sl{n}", F.lit(0.0)).alias(f"slope_ma{n}") for n in lengths))


def rebalance_dates(calendar: DataFrame, start: str, end: str, period: str = "weekly") -> DataFrame:
    """The Mondays (or, with daily, all days) of a calendar within a range, plus its first day there."""
    days = calendar.select("date").distinct().where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if period == "daily":
        return days
    first = F.broadcast(days.agg(F.min("date").alias("_first")))
    return days.crossJoin(first).where((F.weekday("date") == 0) | (F.col("date") == F.col("_first"))).select("date")


def select_all_dates(bars: DataFrame, blocks: DataFrame, dates: DataFrame, condition: Column | None = None, mas: tuple[int, ...] = (20,), min_count: int = 3) -> DataFrame:
    """A screen on every rebalance date in one plan: factors once, then resonance by date and block."""
    wanted = dates.select(F.col("date").alias("_w")).distinct()
    rated = factors(bars, mas).join(wanted, F.col("date") == F.col("_w"), "left_semi")
    return resonance(rated.where(volume_breakout() if condition is None else condition), blocks, min_count)


def validate_screen(df: DataFrame) -> DataFrame:
    """The result itself, or an error that names the columns that a screen must have."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"a screen needs the columns {', '.join(missing)}")
    return df


class Catalogue:
    """Named strategies: functions of (inputs, **params), or SQL over temporary views with bound arguments."""

    def __init__(self, hidden: tuple[str, ...] = ()):
        self.entries: dict[str, tuple[str, str, Callable[..., DataFrame] | str]] = {}
        self.hidden = hidden

    def register(self, key: str, name: str, description: str, strategy: Callable[..., DataFrame] | str) -> None:
        """Adds or replaces a strategy."""
        self.entries[key] = (name, description, strategy)

    def list_strategies(self, spark: SparkSession) -> DataFrame:
        rows = [(k, n, d) for k, (n, d, _) in sorted(self.entries.items()) if k not in self.hidden]
        return spark.createDataFrame(rows, "key string, name string, description string")

    def run(self, spark: SparkSession, key: str, inputs: dict[str, DataFrame], **params) -> DataFrame:
        strategy = self.entries[key][2]
        if callable(strategy):
            return strategy(**inputs, **params)
        before = {name: spark.table(name) for name in inputs if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary}
        try:
            for name, df in inputs.items():
                df.createOrReplaceTempView(name)
            return spark.sql(strategy, args=params)
        finally:  # the result is analysed by now; the session's own views come back
            for name in inputs:
                spark.catalog.dropTempView(name)
            for name, df in before.items():
                df.createOrReplaceTempView(name)


    def as_table_function(self, spark: SparkSession, key: str, arguments: dict[str, str], returns: str, tables: dict[str, str]) -> str:
        """Makes an SQL strategy a temporary table function of its key's name, to be called in FROM with arguments and joined like a table.

        arguments: type of each ``:argument`` of the strategy, in order. returns: the result's columns as DDL. tables: the catalogue
        table (such as a store's) or the query that stands behind each name the strategy reads; no view is made.
        """
        strategy = self.entries[key][2]
        if callable(strategy):
            raise ValueError(f"{key} is a function, not SQL")
        if not key.isidentifier():
            raise ValueError(f"{key} can't be a function's name")
        # an argument is named with its function, so that no column hides it
        body = re.sub(r"(?<!:):([A-Za-z_]\w*)", lambda m: f"{key}.{m.group(1)}" if m.group(1) in arguments else m.group(0), strategy)
        read = ", ".join(f"{name} as (select * from {table})" for name, table in tables.items())
        declared = ", ".join(f"{name} {kind}" for name, kind in arguments.items())
        spark.sql(f"create or replace temporary function {key}({declared}) returns table ({returns}) return with {read} select * from ({body})")
        return key


def default_catalogue() -> Catalogue:
    own = Catalogue(hidden=("market_temperature", "limit_up_streaks", "sector_breadth", "index_support", "industry_breadth", "industry_flow_30d", "concept_flow_30d"))
    own.register("resonance_breakout", "Resonance breakout", "Breakouts on volume whose concept blocks break out together", resonance_breakout)
    own.register("ma_long_sequence", "Long sequence", "All averages in bull order, with block resonance", ma_long_sequence)
    own.register("dual_resonance", "Dual resonance", "Breakout and bull order at once, with block resonance", dual_resonance)
    return own


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
