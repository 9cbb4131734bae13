"""Universe filters, predicates and output projections."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I  # noqa: E741
from ..functions import symbols as S


def by_category(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Rows whose symbol is of one of the categories (stock, index, sector, fund, bond); default stock."""
    return df.where(S.in_categories(F.col("symbol"), categories))


def with_board(df: DataFrame) -> DataFrame:
    return df.withColumn("board", S.board(F.col("symbol")))


def latest_date(calendar: DataFrame) -> DataFrame:
    """One row with the market's latest date, to be cross-joined."""
    return F.broadcast(calendar.agg(F.max("date").alias("latest")))


def at_latest(df: DataFrame, calendar: DataFrame | None = None, date: str | None = None) -> DataFrame:
    """Rows of a given date, or of the latest date of ``calendar`` (default: of ``df`` itself)."""
    if date is not None:
        return df.where(F.col("date") == F.to_date(F.lit(date)))
    return df.crossJoin(latest_date(df if calendar is None else calendar)).where(F.col("date") == F.col("latest")).drop("latest")


def latest_window(bars: DataFrame, days: int, calendar: DataFrame | None = None, date: str | None = None) -> tuple[DataFrame, str]:
    """Bars of the ``days`` calendar days up to a date, and the date: the one given, or the calendar's (default: the bars') latest.

    The range is a literal, so it reaches the scan before any window; the driver sees one date.
    Windows over the result see the rows of these days only.
    """
    last = datetime.date.fromisoformat(date) if date is not None else (bars if calendar is None else calendar).agg(F.max("date")).first()[0]
    if last is None:
        return bars.where(F.lit(False)), "1970-01-01"
    return bars.where(F.col("date").between(F.lit(last - datetime.timedelta(days)), F.lit(last))), last.isoformat()


def traded_today(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars of the calendar's latest date with a volume."""
    return at_latest(bars, calendar).where(F.col("volume") > 0)


def date_range(bars: DataFrame, start: str, end: str, warmup_days: int = 380) -> DataFrame:
    """Bars from ``start`` less the warm-up to ``end``: filter before windows, then ``in_range`` after them."""
    return bars.where((F.col("date") >= F.date_sub(F.to_date(F.lit(start)), warmup_days)) & (F.col("date") <= F.to_date(F.lit(end))))


def in_range(df: DataFrame, start: str) -> DataFrame:
    return df.where(F.col("date") >= F.to_date(F.lit(start)))


def min_listing_age(bars: DataFrame, days: int = 390) -> DataFrame:
    """Bars at least so many days after their instrument's first."""
    return bars.withColumn("_first", I.first_date()).where(F.datediff("date", "_first") >= days).drop("_first")


def valid_prices(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("close_adj").isNotNull() & (F.col("volume") > 0))


def latest_n(bars: DataFrame, n: int) -> DataFrame:
    """The latest n bars of each instrument; adds rn, 1 for the latest."""
    return bars.withColumn("rn", I.recency_rank()).where(F.col("rn") <= n)


def price_position(signals: DataFrame, upper: float = 1.3, lower: float = 0.7) -> DataFrame:
    """Signals near their history: highest high at most close * upper and lowest low at least close * lower. A high of 0 (no history) passes."""
    high, low, close = F.col("hist_max_high_adj"), F.col("hist_min_low_adj"), F.col("close_adj")
    return signals.where((high == 0) | ((high <= close * upper) & (low >= close * lower)))


def resolve_symbol(ids: DataFrame, names: DataFrame, bars: DataFrame) -> DataFrame:
    """ids (query) with ``symbol``: six digits are looked up in names, then in bars, then get a market by prefix; other text is an id already."""
    asked = ids.withColumn("_q", F.lower(F.trim("query")))
    code = F.substring("symbol", 3, 6)
    in_names = names.groupBy(code.alias("_n_code")).agg(F.min("symbol").alias("_n"))
    in_bars = bars.select("symbol").distinct().groupBy(code.alias("_b_code")).agg(F.min("symbol").alias("_b"))
    six = F.col("_q").rlike("^[0-9]{6}$")
    return (
        asked.join(in_names, F.col("_q") == F.col("_n_code"), "left")
        .join(in_bars, F.col("_q") == F.col("_b_code"), "left")
        .select(*ids.columns, F.when(six, F.coalesce("_n", "_b", F.concat(S.guess_market(F.col("_q")), F.col("_q")))).otherwise(F.col("_q")).alias("symbol"))
    )


def present(df: DataFrame, names: DataFrame, digits: int = 2) -> DataFrame:
    """Upper-case symbols, names (cleaned, default empty) and rounded doubles."""
    named = names.select(F.col("symbol").alias("_s"), S.clean_name(F.col("name")).alias("_name"))
    shown = [F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes if c != "symbol"]
    return df.join(named, F.col("symbol") == F.col("_s"), "left").select(F.upper("symbol").alias("symbol"), F.coalesce("_name", F.lit("")).alias("name"), *shown)


def signal_range(signals: DataFrame, start: str, end: str, ranks: tuple[int, ...] = (1, 2)) -> DataFrame:
    return signals.where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))) & F.col("limit_up_rank").isin(*ranks))


def nth_in_month(df: DataFrame, name: str = "nth") -> DataFrame:
    """Numbers an instrument's rows within each calendar month by date."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("symbol", F.trunc("date", "month")).orderBy("date")))
