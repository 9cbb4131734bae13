"""Metrics of an equity curve and of closed trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I  # noqa: E741

# one curve has one row a trading day, so a window over all of it is small; ``by`` adds a key for many curves


def _by(by: list[str] | None):
    return Window.partitionBy(*(by or [])).orderBy("date")


def curve_with_drawdown(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    w = _by(by)
    return curve.withColumns({"ret": I.pct_change0("total_value", w), "peak": I.running_peak("total_value", w), "drawdown": I.drawdown("total_value", w)})


def curve_metrics(curve: DataFrame, convention: str = "242", initial: float | None = None, by: list[str] | None = None) -> DataFrame:
    """total_return, annualized, max_drawdown, sharpe and calmar, as parts of one, of a curve (date, total_value).

    ``242``: 242 days a year counted in rows, sample deviation. ``250``: calendar years of 365 days, 250
    days a year for Sharpe, population deviation. Both with 2 percent a year free of risk.
    """
    days = float(convention)
    moved = curve_with_drawdown(curve, by)
    deviation = F.stddev_samp("ret") if convention == "242" else F.stddev_pop("ret")
    sums = (moved.groupBy(*by) if by else moved.groupBy()).agg(
        F.min_by("total_value", "date").alias("first"), F.max_by("total_value", "date").alias("last"), F.count(F.lit(1)).alias("n"),
        F.datediff(F.max("date"), F.min("date")).alias("span"), F.min("drawdown").alias("max_drawdown"), F.avg("ret").alias("mean"), deviation.alias("dev"),
    )
    start = F.lit(float(initial)) if initial is not None else F.col("first")
    years = F.col("n") / days if convention == "242" else F.col("span") / 365.0
    growth = I.ratio(F.col("last"), start)
    annual = F.pow(growth, F.lit(1.0) / F.nullif(years, F.lit(0.0))) - 1
    return sums.select(
        *(by or []), (growth - 1).alias("total_return"), annual.alias("annualized"), "max_drawdown",
        F.when(F.col("dev") > 0, (F.col("mean") - 0.02 / days) / F.nullif(F.col("dev"), F.lit(0.0)) * F.sqrt(F.lit(days))).otherwise(F.lit(0.0)).alias("sharpe"),
        F.when(F.col("max_drawdown") != 0, annual / F.nullif(F.abs("max_drawdown"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("calmar"),
    )


def benchmark_nav(index_bars: DataFrame, start_value: float = 1.0) -> DataFrame:
    """date and nav: the close scaled so that the first one is start_value."""
    first = F.broadcast(index_bars.agg(F.min_by("close", "date").alias("_first")))
    return index_bars.crossJoin(first).select("date", (I.ratio(F.col("close"), F.col("_first")) * start_value).alias("nav"))


def trade_ratios(closed: DataFrame, pnl: str = "pnl") -> DataFrame:
    """sells, win_rate (percent) and profit_loss_ratio (99 without losses, 0 without trades)."""
    x = F.col(pnl)
    sums = closed.agg(F.count(F.lit(1)).alias("sells"), F.count_if(x > 0).alias("_w"), F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("_g"), F.coalesce(F.avg(F.when(x <= 0, F.abs(x))), F.lit(0.0)).alias("_l"))
    return sums.select(
        "sells", F.coalesce(I.ratio(F.col("_w") * 100.0, F.col("sells")), F.lit(0.0)).alias("win_rate"),
        F.when(F.col("sells") == 0, F.lit(0.0)).when(F.col("_l") > 0, F.col("_g") / F.nullif(F.col("_l"), F.lit(0.0))).otherwise(F.lit(99.0)).alias("profit_loss_ratio"),
    )
