"""Market overview: temperature, streaks, breadth, volume profile and money flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I  # noqa: E741
from ..functions import symbols as S
from .universe import at_latest, latest_window

# fixed values: columns of the temperature table, from the lowest return to the highest
BINS = ("limit_down", "n7_10", "n5_7", "n3_5", "n0_3", "p0_3", "p3_5", "p5_7", "p7_10", "limit_up")


def return_bins(r: Column) -> dict[str, Column]:
    """A condition for each bin of a return in percent; the outer bins lie beyond 9.9."""
    up = {"limit_up": r > 9.9, "p7_10": (r >= 7) & (r <= 9.9), "p5_7": (r >= 5) & (r < 7), "p3_5": (r >= 3) & (r < 5), "p0_3": (r > 0) & (r < 3)}
    down = {"limit_down": r < -9.9, "n7_10": (r <= -7) & (r >= -9.9), "n5_7": (r <= -5) & (r > -7), "n3_5": (r <= -3) & (r > -5), "n0_3": (r < 0) & (r > -3)}
    both = up | down
    return {b: both[b] for b in BINS}


#: calendar days that the screens of one date look back: enough for 250 daily bars
WARMUP_DAYS = 400


def market_temperature(bars: DataFrame, date: str | None = None, warmup_days: int = WARMUP_DAYS) -> DataFrame:
    """One row: trade_date, total_stocks, median_return, flat_count and the count of each return bin.

    A return needs a bar before within ``warmup_days`` days.
    """
    r = F.col("ret")
    recent, day = latest_window(bars, warmup_days, date=date)
    today = at_latest(recent.withColumn("ret", I.pct_return()), date=day).where(r.isNotNull())
    return today.agg(
        F.max("date").alias("trade_date"), F.count(F.lit(1)).alias("total_stocks"), F.median("ret").alias("median_return"),
        F.count_if(r == 0).alias("flat_count"), *(F.count_if(c).alias(b) for b, c in return_bins(r).items()),
    )


def rise_fall(temperature: DataFrame) -> DataFrame:
    """Adds rising, falling, their shares in percent and the advance/decline ratio."""
    rising = sum((F.col(b) for b in BINS[6:]), F.col(BINS[5]))
    falling = sum((F.col(b) for b in BINS[1:5]), F.col(BINS[0]))
    counted = temperature.withColumns({"rising": rising, "falling": falling})
    total = F.nullif(F.col("total_stocks"), F.lit(0))
    return counted.withColumns(
        {"rising_pct": F.col("rising") * 100.0 / total, "falling_pct": F.col("falling") * 100.0 / total, "advance_decline": F.col("rising") * 1.0 / F.greatest(F.col("falling"), F.lit(1))}
    )


def market_env(counted: DataFrame) -> DataFrame:
    """Adds temperature_index (50 where nothing moves) and market_env (bull, defensive or balanced)."""
    moved = F.col("rising") + F.col("falling")
    index = F.when(moved > 0, F.col("rising") * 100.0 / F.nullif(moved, F.lit(0))).otherwise(F.lit(50.0))
    out = counted.withColumn("temperature_index", index)
    return out.withColumn("market_env", F.when(F.col("temperature_index") > 65, "bull").when(F.col("temperature_index") < 35, "defensive").otherwise("balanced"))


def limit_of(symbol: Column) -> Column:
    """The return in percent that counts as the limit of the symbol's board; null for boards without one."""
    return F.when(S.starts_with_any(symbol, ("sh60", "sz00")), 9.91).when(S.starts_with_any(symbol, ("sh68", "sz30")), 19.91)


def limit_up(ret: Column, symbol: Column) -> Column:
    """Whether an unadjusted return in percent reaches the limit of the symbol's board."""
    return F.coalesce(ret >= limit_of(symbol), F.lit(False))


def limit_up_flag(bars: DataFrame) -> DataFrame:
    """Bars with ret (unadjusted, percent) and limit_up."""
    return bars.withColumn("ret", I.pct_return("close")).withColumn("limit_up", limit_up(F.col("ret"), F.col("symbol")))


def limit_up_streaks(bars: DataFrame, date: str | None = None, warmup_days: int = WARMUP_DAYS) -> DataFrame:
    """symbol, close, ret and streak of the instruments at their limit on the market's latest date; streaks within ``warmup_days`` days."""
    recent, day = latest_window(bars, warmup_days, date=date)
    flagged = limit_up_flag(recent)
    # a run gets the number of misses before it; its last bar counts its length
    island = F.sum(F.when(F.col("limit_up"), 0).otherwise(1)).over(I.by_date().rowsBetween(Window.unboundedPreceding, 0))
    runs = flagged.withColumn("_island", island).withColumn("streak", F.sum(F.when(F.col("limit_up"), 1).otherwise(0)).over(Window.partitionBy("symbol", "_island")))
    return at_latest(runs, date=day).where("limit_up").select("symbol", "close", "ret", "streak")


def streak_ladder(streaks: DataFrame, names: DataFrame) -> DataFrame:
    """streak, stocks and symbols (name or id, sorted, comma-joined) per height, the highest first."""
    named = streaks.join(names.select(F.col("symbol").alias("_s"), "name"), F.col("symbol") == F.col("_s"), "left")
    return named.groupBy("streak").agg(F.count(F.lit(1)).alias("stocks"), F.array_join(F.array_sort(F.collect_list(F.coalesce("name", "symbol"))), ",").alias("symbols")).orderBy(F.desc("streak"))


def latest_flags(bars: DataFrame, mult: float = 1.5, mas: tuple[int, ...] = (5, 10, 20, 60), date: str | None = None, warmup_days: int = WARMUP_DAYS) -> DataFrame:
    """symbol, above_ma20, bull and breakout at the latest date: one window pass over the last ``warmup_days`` days, then one row an instrument."""
    recent, day = latest_window(bars, warmup_days, date=date)
    priced = I.with_means(recent, "close_adj", {f"_ma{n}": n for n in sorted({*mas, 20})})
    today = at_latest(I.with_means(priced, "volume", {"_v5": 5}, scale=1), date=day)
    return today.select(
        "symbol",
        (F.col("close_adj") > F.col("_ma20")).alias("above_ma20"),
        I.bull_aligned([f"_ma{n}" for n in mas]).alias("bull"),
        ((F.col("close_adj") > F.col("_ma20")) & (F.col("volume") > mult * F.col("_v5"))).alias("breakout"),
    )


def breadth(flags: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Per group of members (symbol, key): total, counts and shares above the average and aligned, breakouts with their symbols."""
    own = members.select(F.col("symbol").alias("_s"), key).distinct()
    return (
        flags.join(own, F.col("symbol") == F.col("_s"))
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("above_ma20").alias("above_ma20_count"),
            F.count_if("bull").alias("bull_count"),
            F.count_if("breakout").alias("breakout_count"),
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("breakout"), F.col("symbol")))), ",").alias("breakout_symbols"),
        )
        .withColumns({"above_ma20_ratio": F.col("above_ma20_count") * 100.0 / F.col("total"), "bull_ratio": F.col("bull_count") * 100.0 / F.col("total")})
        .orderBy(F.desc("bull_ratio"), key)
    )


def concept_breadth(bars: DataFrame, blocks: DataFrame, mult: float = 1.5, warmup_days: int = WARMUP_DAYS, date: str | None = None) -> DataFrame:
    """Breadth of each concept block at ``date``, or at the latest one."""
    concept = blocks.where(F.col("block_category") == "concept").select(F.concat("market", "code").alias("symbol"), "block_name")
    return breadth(latest_flags(bars, mult, date=date, warmup_days=warmup_days), concept, "block_name")


def industry_breadth(bars: DataFrame, industries: DataFrame, mult: float = 1.5, warmup_days: int = WARMUP_DAYS, date: str | None = None) -> DataFrame:
    """Breadth of each industry at ``date``, or at the latest one."""
    return breadth(latest_flags(bars, mult, date=date, warmup_days=warmup_days), industries, "industry_name")


def breadth_label(ratio: Column) -> Column:
    return F.when(ratio >= 40, "main line").when(ratio >= 25, "medium-term bull").otherwise("local")


def volume_profile(index_bars: DataFrame, days: int = 120, buckets: int = 10) -> DataFrame:
    """bucket, min_close, max_close, amount and days of equal-width buckets of the last closes of one index; empty ones are absent."""
    last = index_bars.orderBy(F.desc("date")).limit(days)
    span = F.broadcast(last.agg(F.min("close").alias("_lo"), F.max("close").alias("_hi")))
    bucket = F.least(F.coalesce(F.width_bucket("close", "_lo", "_hi", F.lit(buckets)), F.lit(1)), F.lit(buckets))
    return last.crossJoin(span).groupBy(bucket.cast("int").alias("bucket")).agg(F.min("close").alias("min_close"), F.max("close").alias("max_close"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("days"))


def share_of_total(df: DataFrame, col: str) -> DataFrame:
    """Adds <col>_share, in percent; the total is one aggregated row."""
    total = F.broadcast(df.agg(F.sum(col).alias("_total")))
    return df.crossJoin(total).withColumn(f"{col}_share", F.col(col) * 100.0 / F.nullif(F.col("_total"), F.lit(0.0))).drop("_total")


def last_dates(bars: DataFrame, days: int) -> DataFrame:
    """The latest distinct dates; at most ``days`` rows."""
    return F.broadcast(bars.select(F.col("date").alias("_d")).distinct().orderBy(F.desc("_d")).limit(days))


def sector_flow(bars: DataFrame, members: DataFrame, key: str, days: int = 30) -> DataFrame:
    """date, group, sector_amount and sector_ratio (percent of the market's amount that date) for the latest dates."""
    recent = bars.join(last_dates(bars, days), F.col("date") == F.col("_d"), "left_semi")
    market = F.broadcast(recent.groupBy(F.col("date").alias("_d")).agg(F.sum("amount").alias("_all")))
    own = members.select(F.col("symbol").alias("_s"), key).distinct()
    flow = recent.join(own, F.col("symbol") == F.col("_s")).groupBy("date", key).agg(F.sum("amount").alias("sector_amount"))
    return flow.join(market, F.col("date") == F.col("_d")).select("date", key, "sector_amount", (F.col("sector_amount") * 100 / F.nullif(F.col("_all"), F.lit(0.0))).alias("sector_ratio"))


def industry_flow(bars: DataFrame, industries: DataFrame, days: int = 30) -> DataFrame:
    return sector_flow(bars, industries, "industry_name", days)


def concept_flow(bars: DataFrame, blocks: DataFrame, days: int = 30) -> DataFrame:
    concept = blocks.where(F.col("block_category") == "concept").select(F.concat("market", "code").alias("symbol"), "block_name")
    return sector_flow(bars, concept, "block_name", days)


def top_bottom_series(flow: DataFrame, key: str, n: int = 10) -> DataFrame:
    """side, group, date, amount (1e8, 2 digits) and ratio (4 digits) of the n highest and n lowest groups at the latest date, on every date."""
    now = at_latest(flow)
    ends = (
        now.orderBy(F.desc("sector_ratio"), key).limit(n).select(F.lit("top").alias("side"), F.col(key).alias("_k"))
        .unionByName(now.orderBy("sector_ratio", key).limit(n).select(F.lit("bottom").alias("side"), F.col(key).alias("_k")))
    )
    frame = F.broadcast(ends).crossJoin(flow.select(F.col("date").alias("_d")).distinct())
    joined = frame.join(flow, (F.col("_k") == F.col(key)) & (F.col("_d") == F.col("date")), "left")
    return joined.select(
        "side", F.col("_k").alias(key), F.col("_d").alias("date"),
        F.round(F.coalesce("sector_amount", F.lit(0.0)) / 1e8, 2).alias("amount"), F.round(F.coalesce("sector_ratio", F.lit(0.0)), 4).alias("ratio"),
    )


def market_turnover(bars: DataFrame, calendar: DataFrame, days: int = 30) -> DataFrame:
    """Amount by board on each of the calendar's last dates."""
    recent = bars.join(last_dates(calendar, days), F.col("date") == F.col("_d"), "left_semi")
    symbol, amount = F.col("symbol"), F.col("amount")
    part = lambda *p: F.coalesce(F.sum(F.when(S.starts_with_any(symbol, p), amount)), F.lit(0.0))
    return recent.groupBy("date").agg(
        part("sh60").alias("sh"), part("sz00").alias("sz"), part("sz30").alias("chinext"), part("bj").alias("bj"), part("sh68").alias("star"), F.sum("amount").alias("total")
    )


