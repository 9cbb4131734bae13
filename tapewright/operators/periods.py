"""Monthly and weekly roll-ups, trend columns, and the regime of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import indicators as I  # noqa: E741

def by_month() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("month")


def monthly_bars(bars: DataFrame) -> DataFrame:
    """symbol, month (its first day), amount, max_high_adj and min_low_adj."""
    return bars.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(
        F.sum("amount").alias("amount"), F.max("high_adj").alias("max_high_adj"), F.min("low_adj").alias("min_low_adj")
    )


def mom_ratio(col: str = "amount") -> Column:
    """A month's value over that of the existing month before it."""
    return I.ratio(F.col(col), F.lag(col).over(by_month()))


def abnormal_count(monthly: DataFrame, ratio: float | Column = 3.0, lookback: int = 12) -> DataFrame:
    """Adds mom_ratio and abnormal_months_count: of the ``lookback`` months before, those whose ratio reached ``ratio``."""
    least = F.lit(ratio) if isinstance(ratio, float | int) else ratio
    rated = monthly.withColumn("mom_ratio", mom_ratio())
    return rated.withColumn("abnormal_months_count", F.coalesce(F.sum(F.when(F.col("mom_ratio") >= least, 1).otherwise(0)).over(by_month().rowsBetween(-lookback, -1)), F.lit(0)))


def hist_range(monthly: DataFrame, lookback: int = 12) -> DataFrame:
    """Adds hist_max_high_adj and hist_min_low_adj of the ``lookback`` months before (0 where there are none)."""
    w = by_month()
    rated = I.with_extremes(monthly, {"_high": ("max_high_adj", lookback)}, {"_low": ("min_low_adj", lookback)}, w)
    before = {"hist_max_high_adj": F.coalesce(F.lag("_high").over(w), F.lit(0.0)), "hist_min_low_adj": F.coalesce(F.lag("_low").over(w), F.lit(0.0))}
    return rated.withColumns(before).drop("_high", "_low")


def resample_ma(bars: DataFrame, unit: str, n: int = 30, lookahead: bool = True, col: str = "close") -> DataFrame:
    """Bars with ma_<unit>: the n-period average of week or month closes (unadjusted unless ``col`` says so; whole cents), in order of time.

    With ``lookahead`` every day of a period has the average that the period's last close completes;
    without it, that of the period before.
    """
    period = F.date_trunc(unit, "date").cast("date")
    closes = bars.groupBy("symbol", period.alias("_period")).agg(F.max_by(col, "date").alias("_close"))
    w = Window.partitionBy("symbol").orderBy("_period")
    averaged = I.with_means(closes, "_close", {"_ma": n}, full=True, w=w)
    if not lookahead:
        averaged = averaged.withColumn("_ma", F.lag("_ma").over(w))
    averaged = averaged.select(F.col("symbol").alias("_symbol"), "_period", F.col("_ma").alias(f"ma_{unit}"))
    return bars.join(averaged, (F.col("symbol") == F.col("_symbol")) & (period == F.col("_period")), "left").drop("_symbol", "_period")


def daily_ma_slope(bars: DataFrame, n: int = 30, col: str = "close") -> DataFrame:
    """Bars with ma_day of the unadjusted close or of ``col`` (whole cents; null until n rows) and its change on the row before."""
    return I.with_means(bars, col, {"ma_day": n}, full=True).withColumn("ma_day_slope", F.col("ma_day") - F.lag("ma_day").over(I.by_date()))


# fixed values: slope and position of the index that each preset asks for
REGIMES = {"resonance": ("up", "above"), "pullback": ("up", "below"), "reversal": ("down", "below"), "custom": (None, None)}


def regime(index_bars: DataFrame, n: int = 250, k: int = 5, preset: str = "resonance", slope: str | None = None, position: str | None = None) -> DataFrame:
    """date, ma and ok of an index: whether its average's slope over k bars and its close's side of the average are as asked.

    slope: up, down or any; position: above, below or any; both override the preset. Undefined
    values pass.
    """
    wanted_slope, wanted_side = REGIMES[preset]
    wanted_slope, wanted_side = slope or wanted_slope or "any", position or wanted_side or "any"
    rows = index_bars.withColumn("ma", I.sma_full("close", n)).withColumn("_before", F.lag("ma", k).over(I.by_date()))
    rising = {"up": F.col("ma") > F.col("_before"), "down": F.col("ma") < F.col("_before"), "any": F.lit(True)}[wanted_slope]
    side = {"above": F.col("close") > F.col("ma"), "below": F.col("close") < F.col("ma"), "any": F.lit(True)}[wanted_side]
    return rows.select("date", "ma", F.when(F.col("ma").isNull() | F.col("_before").isNull(), True).otherwise(rising & side).alias("ok"))


def drift_vol(bars: DataFrame, n: int = 60) -> DataFrame:
    """Per instrument: last close, and mean and deviation of its last n bars' returns.

    Without returns the mean is 0.0005; a deviation that is missing or 0 becomes 0.02.
    """
    before = F.lag("close_adj").over(Window.partitionBy("symbol").orderBy("date"))
    returns = bars.withColumns({"_r": I.ratio(F.col("close_adj") - before, before), "_rn": I.recency_rank()}).where(F.col("_rn") <= n)
    return returns.groupBy("symbol").agg(
        F.max_by("close_adj", "date").alias("close"), F.max("date").alias("date"),
        F.coalesce(F.avg("_r"), F.lit(0.0005)).alias("drift"), F.when(F.stddev_samp("_r") > 0, F.stddev_samp("_r")).otherwise(F.lit(0.02)).alias("vol"),
    )
