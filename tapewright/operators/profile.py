"""Per-instrument features, pattern statistics, outlook and price bands, for all instruments in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I  # noqa: E741
from .universe import latest_n


def risk_level(volatility: Column) -> Column:
    return F.when(volatility > 45, "very high").when(volatility > 30, "high").when(volatility > 18, "medium").otherwise("low")


def feature_snapshot(bars: DataFrame, lookback: int = 260) -> DataFrame:
    """One row per instrument: price, averages, slopes, volume and volatility of its latest bar, from its last ``lookback`` bars."""
    recent = latest_n(bars, lookback).withColumn("ret", I.pct_return())
    means = I.with_means(I.with_means(recent, "close_adj", {f"ma{n}": n for n in I.MA_LENGTHS}), "volume", {"_v5": 5, "_v20": 20}, scale=1)
    rated = I.with_extremes(means, {"high_250": ("close_adj", 250)}, {"low_250": ("close_adj", 250)}).withColumns(
        {
            "dist_high_pct": I.ratio(F.col("high_250") - F.col("close_adj"), F.col("high_250")) * 100,
            "vol_ratio_5": I.over_mean("_v5"), "vol_ratio_20": I.over_mean("_v20"), "volatility": I.rolling_std("ret", 20, annualize=250),
        }
    )
    sloped = rated.withColumns({"slope_ma20": I.slope_pct("ma20"), "slope_ma30": I.slope_pct("ma30"), "dev_ma20": I.deviation_pct("close_adj", "ma20")})
    return sloped.where("rn = 1").select(
        "symbol", "date", F.col("close_adj").alias("close"), F.coalesce("ret", F.lit(0.0)).alias("ret"), *(f"ma{n}" for n in I.MA_LENGTHS),
        "high_250", "low_250", "dist_high_pct", "dev_ma20", "slope_ma20", "slope_ma30", "volume", "vol_ratio_5", "vol_ratio_20",
        F.coalesce("volatility", F.lit(0.0)).alias("volatility"), risk_level(F.coalesce("volatility", F.lit(0.0))).alias("risk_level"),
    )


def pattern_stats(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """symbol, pattern, samples, win_rate and avg_return of four patterns over the whole history.

    breakout; support (low <= MA20 <= close); rebound (more than 12 % below MA20, up 3 % or more); dry_up (a rise of
    7 % or more within the 15 rows up to now, on under 0.65 of the 20-row volume). Rates
    default to 50, returns to 0.
    """
    rated = bars.withColumns({"ret": I.pct_return(), "fwd": I.forward_return(horizon)})
    rated = I.with_means(I.with_means(rated, "close_adj", {"ma20": 20}), "volume", {"v5": 5, "v20": 20}, scale=1)
    rated = rated.withColumns({"dev": I.deviation_pct("close_adj", "ma20"), "top": I.trailing_max("ret", 14, 1)}).where(F.col("fwd").isNotNull())
    # fixed values: the thresholds of the patterns
    patterns = {
        "breakout": (F.col("close_adj") > F.col("ma20")) & (F.col("volume") > 1.5 * F.col("v5")),
        "support": (F.col("low_adj") <= F.col("ma20")) & (F.col("ma20") <= F.col("close_adj")),
        "rebound": (F.col("dev") < -12) & (F.col("ret") >= 3),
        "dry_up": (F.col("top") >= 7) & (F.col("volume") < 0.65 * F.col("v20")),
    }
    sums = []
    for name, holds in patterns.items():
        sums += [F.count_if(holds).alias(f"{name}_n"), F.count_if(holds & (F.col("fwd") > 0)).alias(f"{name}_w"), F.avg(F.when(holds, F.col("fwd"))).alias(f"{name}_r")]
    wide = rated.groupBy("symbol").agg(*sums)
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("pattern"), F.col(f"{p}_n").alias("samples"), F.col(f"{p}_w").alias("wins"), F.col(f"{p}_r").alias("r")) for p in patterns)))
    return wide.select("symbol", rows.alias("p")).select(
        "symbol", "p.pattern", "p.samples",
        F.when(F.col("p.samples") > 0, F.col("p.wins") * 100.0 / F.nullif(F.col("p.samples"), F.lit(0))).otherwise(F.lit(50.0)).alias("win_rate"),
        F.coalesce("p.r", F.lit(0.0)).alias("avg_return"),
    )


def forward_stats(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """symbol, samples, wins, avg_gain and avg_loss of the returns over the next rows; a return of 0 is neither gain nor loss."""
    fwd = bars.withColumn("fwd", I.forward_return(horizon)).where(F.col("fwd").isNotNull())
    up = F.col("fwd") > 0
    return fwd.groupBy("symbol").agg(F.count(F.lit(1)).alias("samples"), F.count_if(up).alias("wins"), F.avg(F.when(up, F.col("fwd"))).alias("avg_gain"), F.avg(F.when(F.col("fwd") < 0, F.col("fwd"))).alias("avg_loss"))


def outlook(stats: DataFrame, features: DataFrame, env: DataFrame) -> DataFrame:
    """symbol, win_rate, expected_return and risk_reward.

    With more than 100 samples the win rate is moved by the mean slope and by a tenth of the market
    temperature's distance from 50, within 18 and 92; otherwise 52.4, 1.85 and 1.35 stand. Rates and the
    temperature have one digit, all else two, before they are used any further.
    """
    shown = lambda c, digits: F.round(F.round(c, 6), digits)  # noqa: E731  a last binary digit doesn't decide
    own = features.select(F.col("symbol").alias("_s"), *(shown(F.col(c), 2).alias(c) for c in ("slope_ma20", "slope_ma30", "dev_ma20", "vol_ratio_5")))
    joined = own.join(stats, F.col("_s") == F.col("symbol"), "left").crossJoin(F.broadcast(env.select(shown(F.col("temperature_index"), 1).alias("temperature_index"))))
    enough = F.coalesce(F.col("samples"), F.lit(0)) > 100
    gain, loss = F.coalesce("avg_gain", F.lit(2.5)), F.abs(F.coalesce("avg_loss", F.lit(-2.0)))
    moved = shown(F.col("wins") * 100.0 / F.nullif(F.col("samples"), F.lit(0)), 1) + (F.col("slope_ma20") + F.col("slope_ma30")) / 2 + (F.col("temperature_index") - 50) / 10
    win = F.when(enough, F.least(F.lit(92.0), F.greatest(F.lit(18.0), shown(moved, 1)))).otherwise(F.lit(52.4))
    return joined.select(
        F.col("_s").alias("symbol"), win.alias("win_rate"),
        F.when(enough, shown(win / 100 * gain - (1 - win / 100) * loss, 2)).otherwise(F.lit(1.85)).alias("expected_return"),
        F.when(enough, F.when(loss > 0, shown(gain / F.nullif(loss, F.lit(0.0)), 2)).otherwise(F.lit(1.5))).otherwise(F.lit(1.35)).alias("risk_reward"),
        "dev_ma20", "vol_ratio_5",
    )


def advice(df: DataFrame) -> DataFrame:
    """Adds one of five labels by win rate, risk/reward, distance from MA20 and volume."""
    # fixed values: the thresholds of the labels
    win, dev = F.col("win_rate"), F.col("dev_ma20")
    label = (
        F.when((win >= 62) & (F.col("risk_reward") >= 1.5), "accumulate")
        .when((win >= 54) & (dev > 0), "hold")
        .when((win >= 45) & (F.col("vol_ratio_5") < 0.7), "wait")
        .when((win < 45) & (dev < -8), "oversold")
        .otherwise("reduce")
    )
    return df.withColumn("advice", label)


# fixed values: quantiles of the bands and the standard normal values that belong to them
BAND_QUANTILES = {5: -1.6448536269514722, 16: -0.994457883209753, 50: 0.0, 84: 0.994457883209753, 95: 1.6448536269514722}


def next_business_days(date: Column, n: int = 10) -> Column:
    """The next n days after ``date`` that are no Saturday or Sunday, as an array."""
    days = F.sequence(F.date_add(date, 1), F.date_add(date, n // 5 * 7 + 7))
    return F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, n)


def price_bands(last: DataFrame, horizon: int = 10, quantiles: dict[int, float] = BAND_QUANTILES) -> DataFrame:
    """Log-normal quantiles of the price for each of the next business days.

    last: symbol, date, close, drift and vol. Band at z after t days: close * exp((drift - vol^2/2) t + z vol sqrt(t)).
    """
    rows = last.select("symbol", "close", "drift", "vol", F.posexplode(next_business_days(F.col("date"), horizon)).alias("_at", "day"))
    t = (F.col("_at") + 1).cast("double")
    middle = (F.col("drift") - F.col("vol") * F.col("vol") / 2) * t
    return rows.select("symbol", "day", *((F.col("close") * F.exp(middle + z * F.col("vol") * F.sqrt(t))).alias(f"p{q}") for q, z in quantiles.items()))


def chart_slice(bars: DataFrame, n: int = 90) -> DataFrame:
    """symbol, date, close, ma20 and ma30 of each instrument's last n bars; averages over the whole history."""
    rated = I.with_means(bars, "close_adj", {"ma20": 20, "ma30": 30})
    return latest_n(rated, n).select("symbol", "date", F.col("close_adj").alias("close"), "ma20", "ma30")
