"""Event study of the abnormal-volume limit-up signal: signals, fills, outcomes, exits and their summaries.

Trades stay in long form, one row per trade and horizon. All look-ups of later bars are
joins on (symbol, bar_idx), never loops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I  # noqa: E741
from . import levels
from .market import limit_up_flag
from .periods import abnormal_count, by_month, daily_ma_slope, hist_range, mom_ratio, monthly_bars, resample_ma
from .universe import nth_in_month

HORIZONS = (20, 40, 60, 120)
CAP_CLASSES = ("<50", "50-200", "200-500", "500-1000", ">=1000")
TRADE = ["symbol", "signal_month"]


def abnormal_volume_signals(
    bars: DataFrame, ratio: float = 3.0, lookback: int = 12, min_months: int = 2, listing_days: int = 390, start: str | None = None, end: str | None = None, ranks: tuple[int, ...] = (1, 2)
) -> DataFrame:
    """Limit-up bars, the first and second of their month, of instruments with enough abnormal months before.

    One plan: daily flags and monthly features meet in an equi-join on (symbol, month).
    """
    features = hist_range(abnormal_count(monthly_bars(bars), ratio, lookback), lookback).where(F.col("abnormal_months_count") >= min_months)
    return _signals(bars, features, listing_days, start, end, ranks, ["abnormal_months_count", "hist_max_high_adj", "hist_min_low_adj"])


def _signals(bars, features, listing_days, start, end, ranks, columns) -> DataFrame:
    flagged = limit_up_flag(bars).withColumn("_first", I.first_date()).where("limit_up")
    ranked = nth_in_month(flagged, "limit_up_rank").where(F.col("limit_up_rank").isin(*ranks) & (F.datediff("date", "_first") >= listing_days))
    if start is not None:
        ranked = ranked.where(F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        ranked = ranked.where(F.col("date") <= F.to_date(F.lit(end)))
    own = features.select(F.col("symbol").alias("_s"), F.col("month").alias("signal_month"), *columns)
    joined = ranked.join(own, (F.col("symbol") == F.col("_s")) & (F.trunc("date", "month") == F.col("signal_month")))
    return joined.select("symbol", "date", "signal_month", "close", "close_adj", "factor", "ret", "limit_up_rank", *columns)


def indexed(bars: DataFrame) -> DataFrame:
    """Bars with bar_idx (from 0) and bars_total of their instrument; bars that have them already stay as they are, so a caller can number them once."""
    if {"bar_idx", "bars_total"} <= set(bars.columns):
        return bars
    return bars.withColumns({"bar_idx": F.row_number().over(I.by_date()) - 1, "bars_total": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})


def match_fills(signals: DataFrame, bars: DataFrame, strict_band: bool = True, max_gap: int = 10, max_gain: float = 0.20) -> DataFrame:
    """One trade per (symbol, month) at most: symbol, signal_month, signal_date, buy_date, buy_idx, buy_price, buy_price_adj, buy_factor, buy_type.

    The first signal fills at its close if the next bar's low is not above it (with
    ``strict_band`` the next high not below it either). Otherwise the second may, if it came within
    max_gap bars and max_gain of the first. Without a next bar after the first there is no trade.
    """
    return _fills(_filled(signals, bars, strict_band, max_gap, max_gain))


def _filled(signals: DataFrame, bars: DataFrame, strict_band: bool, max_gap: int, max_gain: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Months with a trade: the first signal a, the second b (null without one) and c, the one of them that fills; each with the columns ``carry``."""
    w = I.by_date()
    following = indexed(bars).select(
        F.col("symbol").alias("_s"), F.col("date").alias("_d"), "bar_idx",
        F.lead("low_adj").over(w).alias("_low"), F.lead("high_adj").over(w).alias("_high"), F.lead("date").over(w).alias("_next"),
    )
    placed = signals.join(following, (F.col("symbol") == F.col("_s")) & (F.col("date") == F.col("_d")))
    fits = (F.col("_low") <= F.col("close_adj")) & (F.col("_high") >= F.col("close_adj") if strict_band else F.lit(True))
    fields = F.struct("date", "close", "close_adj", "factor", "bar_idx", F.col("_next").alias("next"), F.coalesce(fits, F.lit(False)).alias("fits"), *carry)
    both = placed.groupBy(*TRADE).agg(
        F.min_by(F.when(F.col("limit_up_rank") == 1, fields), F.when(F.col("limit_up_rank") == 1, F.col("date"))).alias("a"),
        F.min_by(F.when(F.col("limit_up_rank") == 2, fields), F.when(F.col("limit_up_rank") == 2, F.col("date"))).alias("b"),
    ).where(F.col("a.next").isNotNull())
    near = (F.col("b.bar_idx") - F.col("a.bar_idx") <= max_gap) & (I.ratio(F.col("b.close_adj") - F.col("a.close_adj"), F.col("a.close_adj")) <= max_gain)
    second = F.coalesce(near & F.col("b.fits") & F.col("b.next").isNotNull(), F.lit(False))
    return both.where(F.col("a.fits") | second).withColumn("c", F.when(F.col("a.fits"), F.col("a")).otherwise(F.col("b")))


def _fills(chosen: DataFrame, *more: Column) -> DataFrame:
    return chosen.select(
        *TRADE, F.col("a.date").alias("signal_date"), F.col("c.next").alias("buy_date"), (F.col("c.bar_idx") + 1).alias("buy_idx"),
        F.col("c.close").alias("buy_price"), F.col("c.close_adj").alias("buy_price_adj"), F.col("c.factor").alias("buy_factor"),
        F.when(F.col("a.fits"), "first").otherwise("second").alias("buy_type"), *more,
    )


def _horizons(trades: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    return trades.withColumn("horizon", F.explode(F.array(*(F.lit(h) for h in horizons))))


def outcomes(trades: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = HORIZONS, incomplete: str = "mark") -> DataFrame:
    """Trades by horizon with exit_date, exit_price_adj, ret and completed.

    A horizon that history does not reach is marked to the last bar (``mark``) or left null (``null``).
    """
    own = indexed(bars)
    at = own.select(F.col("symbol").alias("_s"), F.col("bar_idx").alias("_i"), F.col("date").alias("_date"), F.col("close_adj").alias("_close"))
    last = own.where(F.col("bar_idx") == F.col("bars_total") - 1).select(F.col("symbol").alias("_l"), F.col("date").alias("_last_date"), F.col("close_adj").alias("_last_close"))
    rows = _horizons(trades, horizons).join(at, (F.col("symbol") == F.col("_s")) & (F.col("buy_idx") + F.col("horizon") == F.col("_i")), "left")
    done = F.col("_i").isNotNull()
    if incomplete == "mark":
        rows = rows.join(last, F.col("symbol") == F.col("_l"), "left")
        date, close = F.when(done, F.col("_date")).otherwise(F.col("_last_date")), F.when(done, F.col("_close")).otherwise(F.col("_last_close"))
    else:
        date, close = F.col("_date"), F.col("_close")
    return rows.select(*trades.columns, "horizon", date.alias("exit_date"), close.alias("exit_price_adj"), I.ratio(close - F.col("buy_price_adj"), F.col("buy_price_adj")).alias("ret"), done.alias("completed"))


def _in_reach(trades: DataFrame, own: DataFrame, first: int, last: int) -> DataFrame:
    """Trades with the rows of ``own`` (_s, bar_idx, ...) from ``first`` to ``last`` bars after the buy.

    Bars lie in blocks as long as the range, and a trade asks the two or three blocks that it touches: an equi-join on
    (symbol, block), so a trade meets a few blocks of bars and not its instrument's whole history.
    """
    size = max(1, last - first + 1)
    block = lambda c: F.floor(c / size)
    asked = trades.withColumn("_block", F.explode(F.sequence(block(F.col("buy_idx") + first), block(F.col("buy_idx") + last))))
    rows = own.withColumn("_of", block(F.col("bar_idx")))
    met = asked.join(rows, (F.col("symbol") == F.col("_s")) & (F.col("_block") == F.col("_of")))
    return met.where(F.col("bar_idx").between(F.col("buy_idx") + first, F.col("buy_idx") + last)).drop("_block", "_of")


def _lows(bars: DataFrame) -> DataFrame:
    return indexed(bars).select(F.col("symbol").alias("_s"), "bar_idx", F.col("date").alias("_date"), F.col("low_adj").alias("_low"))


def holding_drawdown(trades: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """symbol, signal_month, horizon and dd: the lowest low after the buy within the horizon, relative to the price.

    A trade meets two blocks of lows at most, with minima in levels; trades without a later bar are left out.
    """
    reach = 1, max(horizons)
    met = levels.met(trades.select(*TRADE, "buy_price_adj", "buy_idx"), _lows(bars), "_low", *reach)
    lows = met.groupBy(*TRADE, "buy_price_adj").agg(*(F.min(levels.lowest(h, *reach)).alias(f"h{h}") for h in horizons)).where(F.col(f"h{max(horizons)}").isNotNull())
    rows = lows.select(*TRADE, "buy_price_adj", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("low")) for h in horizons))).alias("x"))
    return rows.select(*TRADE, "x.horizon", (I.ratio(F.col("x.low"), F.col("buy_price_adj")) - 1).alias("dd"))


def with_benchmark(results: DataFrame, index_bars: DataFrame) -> DataFrame:
    """Adds idx_ret (0 where a date is missing) and alpha. The index has one row a date."""
    buy = index_bars.select(F.col("date").alias("_b"), F.col("close").alias("_buy"))
    sell = index_bars.select(F.col("date").alias("_e"), F.col("close").alias("_sell"))
    joined = results.join(buy, F.col("buy_date") == F.col("_b"), "left").join(sell, F.col("exit_date") == F.col("_e"), "left")
    idx = F.coalesce(I.ratio(F.col("_sell") - F.col("_buy"), F.col("_buy")), F.lit(0.0))
    return joined.select(*results.columns, idx.alias("idx_ret"), (F.col("ret") - idx).alias("alpha"))


def float_market_cap(trades: DataFrame, share_events: DataFrame, default: float = 3e9) -> DataFrame:
    """Adds float_market_cap: the last share record (10k units) on or before the buy date times the price; else the default."""
    shares = share_events.select(F.col("symbol").alias("_s"), F.col("date").alias("_at"), F.col("allocated_ratio").alias("_n"))
    asked = trades.select(F.col("symbol").alias("_s"), F.col("buy_date").alias("_at"), F.lit(None).cast("double").alias("_n")).distinct()
    w = Window.partitionBy("_s").orderBy("_at", F.asc_nulls_last("_n")).rowsBetween(Window.unboundedPreceding, 0)
    # null-priced questions sort behind the records of their own day
    known = shares.withColumn("_ask", F.lit(False)).unionByName(asked.withColumn("_ask", F.lit(True))).withColumn("_shares", F.last("_n", ignorenulls=True).over(w)).where("_ask").select("_s", "_at", "_shares")
    joined = trades.join(known, (F.col("symbol") == F.col("_s")) & (F.col("buy_date") == F.col("_at")), "left")
    return joined.select(*trades.columns, F.when(F.col("_shares") > 0, F.col("_shares") * 10000.0 * F.col("buy_price")).otherwise(F.lit(default)).alias("float_market_cap"))


def cap_class(cap: Column) -> Column:
    """Class in 1e8 units, closed on the left."""
    return F.when(cap < 50e8, CAP_CLASSES[0]).when(cap < 200e8, CAP_CLASSES[1]).when(cap < 500e8, CAP_CLASSES[2]).when(cap < 1000e8, CAP_CLASSES[3]).otherwise(CAP_CLASSES[4])


def cap_bin(cap: Column) -> Column:
    """Bin in 1e8 units, closed on the right; null outside (0, 1e12]."""
    edges = (0.0, 20e8, 50e8, 100e8, 300e8, 1e12)
    names = ("(0,20]", "(20,50]", "(50,100]", "(100,300]", "(300,10000]")
    out = F.lit(None).cast("string")
    for low, high, name in zip(edges, edges[1:], names, strict=False):
        out = F.when((cap > low) & (cap <= high), name).otherwise(out)
    return out


def confirm_trend(signals: DataFrame, bars: DataFrame, slope_pos: bool = True, above_daily: bool = True, above_weekly: bool = False, above_monthly: bool = False, col: str = "close") -> DataFrame:
    """Signals whose close (unadjusted, or ``col``) passes the chosen tests against its 30-period averages; an undefined average passes.

    Prices are whole cents and averages come from exact sums, so a close that equals its average is not above it.
    """
    rated = resample_ma(resample_ma(daily_ma_slope(bars, col=col), "week", col=col), "month", col=col)
    own = rated.select(F.col("symbol").alias("_s"), F.col("date").alias("_d"), F.round(col, 2).alias("_c"), "ma_day", "ma_day_slope", "ma_week", "ma_month")
    joined = signals.join(own, (F.col("symbol") == F.col("_s")) & (F.col("date") == F.col("_d")), "left")
    tests = [(slope_pos, F.col("ma_day_slope") > 0), (above_daily, F.col("_c") > F.col("ma_day")), (above_weekly, F.col("_c") > F.col("ma_week")), (above_monthly, F.col("_c") > F.col("ma_month"))]
    wanted = [F.coalesce(test, F.lit(True)) for on, test in tests if on]
    return joined.where(reduce(lambda a, b: a & b, wanted, F.lit(True))).select(*signals.columns)


def regime_bypass(trades: DataFrame, regimes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades whose signal date the regime allows (unknown dates pass), and one row of counts."""
    own = regimes.select(F.col("date").alias("_d"), "ok")
    judged = trades.join(own, F.col("signal_date") == F.col("_d"), "left").withColumn("_ok", F.coalesce("ok", F.lit(True)))
    stats = judged.agg(F.count(F.lit(1)).alias("signals"), F.count_if("_ok").alias("executed"), F.count_if(~F.col("_ok")).alias("bypassed"))
    return judged.where("_ok").select(*trades.columns), stats.withColumn("bypass_ratio", F.coalesce(I.ratio(F.col("bypassed") * 100.0, F.col("signals")), F.lit(0.0)))


def apply_stop_loss(trades: DataFrame, bars: DataFrame, pct: float = 10.0, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Outcomes with a stop: the first bar from the buy day on whose low reaches the stop ends the trade at -pct percent.

    Only horizons that history reaches; adds stopped. The first hit is found by minima in levels.
    """
    stop = F.col("buy_price_adj") * (1 - pct / 100.0)
    reach = 0, max(horizons)
    met = levels.met(trades.select(*TRADE, "buy_idx", stop.alias("_stop")), _lows(bars), "_low", *reach)
    hits = met.groupBy(*TRADE).agg(F.min(levels.first_hit("_stop", *reach)).alias("hit"))
    hits = hits.select(F.col("symbol").alias("_hs"), F.col("signal_month").alias("_hm"), F.col("hit.bar_idx").alias("stop_idx"), F.col("hit._date").alias("stop_date"))
    base = outcomes(trades, bars, horizons, incomplete="null").where("completed")
    joined = base.join(hits, (F.col("symbol") == F.col("_hs")) & (F.col("signal_month") == F.col("_hm")), "left")
    stopped = F.coalesce(F.col("stop_idx") <= F.col("buy_idx") + F.col("horizon"), F.lit(False))
    return joined.select(
        *trades.columns, "horizon", F.when(stopped, F.col("stop_date")).otherwise(F.col("exit_date")).alias("exit_date"),
        F.when(stopped, stop).otherwise(F.col("exit_price_adj")).alias("exit_price_adj"),
        F.when(stopped, F.lit(-pct / 100.0)).otherwise(F.col("ret")).alias("ret"), "completed", stopped.alias("stopped"),
    )


def size_and_pl(results: DataFrame, capital: float = 100_000.0, lot: int = 100) -> DataFrame:
    """Adds shares (whole lots, one at least), spend and pl in money."""
    shares = F.greatest(F.floor(capital / F.nullif(F.col("buy_price"), F.lit(0.0)) / lot) * lot, F.lit(lot)).cast("long")
    sized = results.withColumn("shares", shares)
    return sized.withColumns({"spend": F.col("shares") * F.col("buy_price"), "pl": F.col("shares") * (F.col("exit_price_adj") - F.col("buy_price_adj")) / F.nullif(F.col("buy_factor"), F.lit(0.0))})


def _summary() -> list[Column]:
    done = F.col("completed")
    return [
        F.count(F.lit(1)).alias("trades"), F.count_if(done).alias("valid"), (F.avg(F.when(done, F.col("ret"))) * 100).alias("avg_ret"),
        I.ratio(F.count_if(done & (F.col("ret") > 0)) * 100.0, F.count_if(done)).alias("win_rate"), F.sum(F.when(done, F.col("pl"))).alias("total_pl"),
    ]


def monthly_summary(results: DataFrame) -> DataFrame:
    """Per signal month and horizon: trades, valid, avg_ret, win_rate and total_pl of the completed ones."""
    return results.groupBy("signal_month", "horizon").agg(*_summary())


def monthly_cap_summary(results: DataFrame) -> DataFrame:
    """The same by cap class, dense: each month and horizon has all classes."""
    own = results.withColumn("cap_class", cap_class(F.col("float_market_cap"))).groupBy("signal_month", "horizon", "cap_class").agg(*_summary())
    frame = results.select(F.col("signal_month").alias("_m"), F.col("horizon").alias("_h")).distinct().withColumn("_c", F.explode(F.array(*(F.lit(c) for c in CAP_CLASSES))))
    joined = frame.join(own, (F.col("_m") == F.col("signal_month")) & (F.col("_h") == F.col("horizon")) & (F.col("_c") == F.col("cap_class")), "left")
    return joined.select(
        F.col("_m").alias("signal_month"), F.col("_h").alias("horizon"), F.col("_c").alias("cap_class"),
        F.coalesce("trades", F.lit(0)).alias("trades"), F.coalesce("valid", F.lit(0)).alias("valid"), "avg_ret", "win_rate", "total_pl",
    )


def _stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("trades"), F.avg("ret").alias("avg_ret"), (F.count_if(F.col("ret") > 0) * 1.0 / F.count(F.lit(1))).alias("win_rate"),
        F.avg("dd").alias("avg_dd"), F.avg("idx_ret").alias("avg_idx_ret"), F.avg("alpha").alias("avg_alpha"),
    ]


def holding_stats(results: DataFrame) -> DataFrame:
    """Per horizon: trades, means, win rate and the annualised mean return (1 + r)^(250/H) - 1."""
    own = results.groupBy("horizon").agg(*_stats())
    return own.withColumn("annualized", F.when(F.col("avg_ret") > -1, F.pow(1 + F.col("avg_ret"), F.lit(250.0) / F.col("horizon")) - 1))


def stratify(results: DataFrame, by: Column, name: str) -> DataFrame:
    """The same statistics by one more key (cap bin, market state, year)."""
    return results.withColumn(name, by).groupBy("horizon", name).agg(*_stats())


def market_state(index_bars: DataFrame, n: int = 250) -> DataFrame:
    """date and state: bull where the close is above its full n-bar average, else (or where it has none) bear."""
    rated = index_bars.withColumn("_ma", I.sma_full("close", n))
    return rated.select("date", F.when(F.col("close") > F.col("_ma"), "bull").otherwise("bear").alias("state"))


def top_industries(results: DataFrame, n: int = 10) -> DataFrame:
    own = results.groupBy("industry").agg(F.count(F.lit(1)).alias("trades"), F.avg("ret").alias("avg_ret"), (F.count_if(F.col("ret") > 0) * 1.0 / F.count(F.lit(1))).alias("win_rate"))
    return own.orderBy(F.desc("trades"), "industry").limit(n)


def evaluate_exits(trades: DataFrame, bars: DataFrame, stop: float = 8.0, trail: float = 6.0, ma_exit: bool = True, max_days: int = 10) -> DataFrame:
    """The first bar after the buy on which a rule fires: exit_date, exit_price, reason and held; at most max_days + 1 bars are looked at.

    Rules in order: close below the stop, close below the running peak less ``trail`` percent, close below
    its 20-row average, held max_days or longer. Bars without volume are passed over.
    """
    rated = I.with_means(bars, "close_adj", {"_ma20": 20})
    own = indexed(rated).select(F.col("symbol").alias("_s"), "bar_idx", F.col("date").alias("_date"), F.col("close_adj").alias("_close"), F.col("volume").alias("_v"), "_ma20")
    held = _in_reach(trades, own, 1, max_days).where(F.col("_v") > 0)
    w = Window.partitionBy(*TRADE).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    peaked = held.withColumn("_peak", F.greatest(F.max("_close").over(w), F.col("buy_price_adj")))
    price = F.col("buy_price_adj")
    reason = (
        F.when(F.lit(stop > 0) & (F.col("_close") < price * (1 - stop / 100)), "stop")
        .when(F.lit(trail > 0) & (F.col("_close") < F.col("_peak") * (1 - trail / 100)), "trail")
        .when(F.lit(ma_exit) & (F.col("_close") < F.col("_ma20")), "average")
        .when(F.lit(max_days > 0) & (F.col("bar_idx") - F.col("buy_idx") >= max_days), "time")
    )
    fired = peaked.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return fired.groupBy(*trades.columns).agg(F.min_by(F.struct(F.col("_date").alias("d"), F.col("_close").alias("p"), "reason", (F.col("bar_idx") - F.col("buy_idx")).alias("h")), "bar_idx").alias("x")).select(
        *trades.columns, F.col("x.d").alias("exit_date"), F.col("x.p").alias("exit_price"), "x.reason", F.col("x.h").alias("held")
    )


def net_of_costs(closed: DataFrame, commission: float = 0.03, stamp: float = 0.1, slippage: float = 0.1) -> DataFrame:
    """Adds net_pct: round-trip percent after slippage and commission on both sides and stamp duty on the sale."""
    paid = F.col("buy_price_adj") * (1 + slippage / 100) * (1 + commission / 100)
    got = F.col("exit_price") * (1 - slippage / 100) * (1 - (commission + stamp) / 100)
    return closed.withColumn("net_pct", (I.ratio(got, paid) - 1) * 100)


def _open_before(trades: DataFrame, key: str) -> DataFrame:
    """(key, date, open): trades of a key bought before a date and not out by it; daily sums, then a running sum by key."""
    moves = trades.select(F.col(key).alias("_k"), F.col("buy_date").alias("_d"), F.lit(1).alias("_in"), F.lit(0).alias("_out")).unionByName(
        trades.where(F.col("exit_date").isNotNull()).select(F.col(key).alias("_k"), F.col("exit_date").alias("_d"), F.lit(0).alias("_in"), F.lit(1).alias("_out"))
    )
    daily = moves.groupBy("_k", "_d").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    w = Window.partitionBy("_k").orderBy("_d")
    before = F.coalesce(F.sum("_in").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = F.sum("_out").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return daily.select("_k", "_d", (before - out).alias("_open"))


def exposure(trades: DataFrame) -> DataFrame:
    """Per trade (symbol, buy_date, exit_date, industry, concepts), with a row for each of its industries: same_industry, same_concept and days_since_exit.

    same_industry: trades of the industry open when it was bought; same_concept: the most open trades of any of its
    concepts, each counted once; days_since_exit: days since the last exit of the symbol's earlier trades. Counted with running
    sums by key, so a busy industry costs a row a day, not pairs of trades.
    """
    concept = trades.select("symbol", "buy_date", "exit_date", F.explode_outer("concepts").alias("_concept")).distinct()
    by_concept = _open_before(concept.where(F.col("_concept").isNotNull()).withColumnRenamed("_concept", "_one"), "_one")
    most = concept.join(by_concept, (F.col("_concept") == F.col("_k")) & (F.col("buy_date") == F.col("_d")), "left").groupBy(F.col("symbol").alias("_s"), F.col("buy_date").alias("_b")).agg(F.coalesce(F.max("_open"), F.lit(0)).alias("same_concept"))
    last_exit = F.max("exit_date").over(Window.partitionBy("symbol").orderBy(F.unix_date("buy_date")).rangeBetween(Window.unboundedPreceding, -1))
    timed = trades.withColumn("days_since_exit", F.datediff("buy_date", last_exit))
    in_industry = _open_before(trades, "industry")
    return (
        timed.join(in_industry, (F.col("industry") == F.col("_k")) & (F.col("buy_date") == F.col("_d")), "left")
        .join(most, (F.col("symbol") == F.col("_s")) & (F.col("buy_date") == F.col("_b")), "left")
        .select(*trades.columns, F.coalesce("_open", F.lit(0)).alias("same_industry"), F.coalesce("same_concept", F.lit(0)).alias("same_concept"), "days_since_exit")
    )


#: what a sweep varies, each with its direction from the strictest value to the loosest
AXES = {"vol_ratio": False, "upper": True, "lower": False}


def _above(column: str, bits: int) -> Column:
    """Nodes above a place (from 1) in a binary tree over 2^bits places: halves of its own number up to 1, the root."""
    return F.expr(f"transform(sequence(0, {bits}), k -> shiftright({(1 << bits) - 1} + {column}, k))")


def _before(column: str, bits: int) -> Column:
    """Nodes that together cover the places up to a place: one for each bit of its number."""
    return F.expr(f"transform(filter(sequence(0, {bits}), k -> shiftright({column}, k) % 2 = 1), k -> shiftleft(1, {bits} - k) + shiftright({column}, k) - 1)")


def sweep(bars: DataFrame, grid: DataFrame, lookback: int = 12, min_months: int = 2, listing_days: int = 390, horizon: int = 60, capital: float = 100_000.0) -> DataFrame:
    """Per combination of grid (param_id, vol_ratio, upper, lower): trades, valid, avg_ret, win_rate and total_pl at the horizon.

    A month's trade is the same for all combinations that allow it: those from its strictest ratio and bounds on, which its own figures
    tell. So each trade is made and followed once and counted in one cell of the grid; a combination adds up the cells
    before it on all three axes by a tree over each axis, a logarithmic number of sums an axis. The driver sees the different values
    of each axis. Adjusted closes are above zero. A combination with a null has no trades.
    """
    own = grid.agg(*(F.sort_array(F.collect_set(F.col(c).cast("double")), asc=asc).alias(c) for c, asc in AXES.items())).first()
    values = {c: F.array(*map(F.lit, own[c])).cast("array<double>") for c in AXES}
    bits = {c: max(0, len(own[c]) - 1).bit_length() for c in AXES}
    place = lambda c, passed: (len(own[c]) + 1 - passed).cast("int")  # noqa: E731  # of the strictest value that passes; one too far if none does

    before = by_month().rowsBetween(-lookback, -1)
    rated = hist_range(monthly_bars(bars), lookback).withColumn("mom_ratio", mom_ratio())
    ratio = F.get(F.sort_array(F.collect_list("mom_ratio").over(before), asc=False), F.lit(min_months - 1)) if min_months > 0 else F.lit(float("inf"))
    features = rated.withColumn("_ratio", ratio).withColumn("_vol_ratio", place("vol_ratio", F.size(F.filter(values["vol_ratio"], lambda x: F.col("_ratio") >= x)))).where(F.col("_vol_ratio") <= len(own["vol_ratio"]))
    found = _signals(bars, features, listing_days, None, None, (1, 2), ["_vol_ratio", "hist_max_high_adj", "hist_min_low_adj"])
    high, low, close = F.col("hist_max_high_adj"), F.col("hist_min_low_adj"), F.col("close_adj")
    signals = found.withColumns({
        "_upper": place("upper", F.size(F.filter(values["upper"], lambda x: (high == 0) | (high <= close * x)))),
        "_lower": place("lower", F.size(F.filter(values["lower"], lambda x: (high == 0) | (low >= close * x)))),
    })
    # a second signal's trade asks that both pass
    strictest = [F.when(F.col("a.fits"), F.col(f"a._{c}")).otherwise(F.greatest(f"a._{c}", f"b._{c}")).alias(f"_{c}") for c in AXES]
    allowed = signals.where((F.col("_upper") <= len(own["upper"])) & (F.col("_lower") <= len(own["lower"])))
    fills = _fills(_filled(allowed, bars, True, 10, 0.20, tuple(f"_{c}" for c in AXES)), *strictest)
    results = size_and_pl(outcomes(fills, bars, (horizon,), incomplete="null"), capital)

    done = F.col("completed")
    cells = results.groupBy(*(f"_{c}" for c in AXES)).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(done).alias("_valid"), F.count_if(done & (F.col("ret") > 0)).alias("_wins"),
        F.sum(F.when(done, F.col("ret"))).alias("_ret"), F.sum(F.when(done, F.col("pl"))).alias("_pl"),
    )
    sums = ("_n", "_valid", "_wins", "_ret", "_pl")
    for c in AXES:
        cells = cells.withColumn(f"_at_{c}", F.explode(_above(f"_{c}", bits[c])))
    nodes = cells.groupBy(*(f"_at_{c}" for c in AXES)).agg(*(F.sum(x).alias(x) for x in sums))
    asked = grid.select(F.col("param_id").alias("_p"), *(F.array_position(values[c], F.col(c).cast("double")).cast("int").alias(f"_{c}") for c in AXES))
    for c in AXES:
        asked = asked.withColumn(f"_on_{c}", F.explode(_before(f"_{c}", bits[c])))
    total = asked.join(nodes, reduce(lambda a, b: a & b, [F.col(f"_on_{c}") == F.col(f"_at_{c}") for c in AXES])).groupBy("_p").agg(*(F.sum(x).alias(x) for x in sums))
    return grid.join(total, F.col("param_id") == F.col("_p"), "left").select(
        *grid.columns, F.coalesce("_n", F.lit(0)).alias("trades"), F.coalesce("_valid", F.lit(0)).alias("valid"),
        (I.ratio(F.col("_ret"), F.col("_valid")) * 100).alias("avg_ret"), I.ratio(F.col("_wins") * 100.0, F.col("_valid")).alias("win_rate"), F.col("_pl").alias("total_pl"),
    )


def rank_sweep(results: DataFrame, min_samples: int = 5) -> DataFrame:
    """Adds place: combinations with enough samples first, then by mean return and win rate. A sweep has few rows."""
    w = Window.orderBy(F.desc(F.col("valid") >= min_samples), F.desc_nulls_last("avg_ret"), F.desc_nulls_last("win_rate"), "param_id")
    return results.withColumn("place", F.row_number().over(w))


def trades_by_date(trades: DataFrame) -> DataFrame:
    return trades.groupBy("buy_date").agg(F.count(F.lit(1)).alias("trades"), F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols"))
