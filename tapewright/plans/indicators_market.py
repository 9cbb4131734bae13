"""Queries over rolling indicators (W) and the market overview (M), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as I  # noqa: E741
from ..operators import curves, market, periods, universe
from ..sources.shared import shared_path
from ..streaming import arrivals
from .fixtures import Views, with_views

Q: dict[str, tuple] = {}


def _mean(n: int, col: str, scale: int, by: str = "date") -> str:
    """Moving average from an exact sum, as ``with_means`` has it: the order of adding decides no comparison of equal values."""
    frame = f"over (partition by symbol order by {by} rows {n - 1} preceding)"
    return f"(sum(cast(round({col} * {scale}) as bigint)) {frame}::double / count({col}) {frame} / {scale})"


def _avg(n: int, col: str = "close_adj") -> str:
    return _mean(n, col, 1 if col == "volume" else 100)


def r6(digits: int = 6, **columns):
    """Rounded columns (without negative zeros): sums of a window are added in another order elsewhere."""
    return [(F.round(c, digits) + F.lit(0.0)).alias(k) for k, c in columns.items()]


Q["w1_sma"] = (
    lambda v: I.with_means(v.bars, "close_adj", {f"ma{n}": n for n in I.MA_LENGTHS}).select("symbol", "date", *r6(9, **{f"ma{n}": F.col(f"ma{n}") for n in I.MA_LENGTHS})),
    with_views("bars", "select symbol, date, " + ", ".join(f"round({_avg(n)}, 9) as ma{n}" for n in (5, 10, 20, 30, 60, 120, 250)) + " from bars"),
)
Q["w2_sma_full"] = (
    lambda v: I.with_means(v.bars, "close_adj", {"ma30": 30, "ma250": 250}, full=True).select("symbol", "date", *r6(ma30=F.col("ma30"), ma250=F.col("ma250"))),
    with_views("bars", "select symbol, date, " + ", ".join(f"case when row_number() over (partition by symbol order by date) >= {n} then round({_avg(n)}, 6) end as ma{n}" for n in (30, 250)) + " from bars"),
)
Q["w3_w4_volume_ratio"] = (
    lambda v: I.with_means(v.bars, "volume", {"v5": 5, "v20": 20}, scale=1).select("symbol", "date", *r6(v5=F.col("v5"), v20=F.col("v20"), ratio5=I.over_mean("v5"), ratio20=I.over_mean("v20"))),
    with_views("bars", f"select symbol, date, round({_avg(5, 'volume')}, 6) as v5, round({_avg(20, 'volume')}, 6) as v20, round(volume / {_avg(5, 'volume')}, 6) as ratio5, round(volume / {_avg(20, 'volume')}, 6) as ratio20 from bars"),
)
_RET = "(close_adj - lag(close_adj) over (partition by symbol order by date)) / nullif(lag(close_adj) over (partition by symbol order by date), 0) * 100"
Q["w5_w6_returns"] = (
    lambda v: v.bars.withColumn("ret", I.pct_return()).select("symbol", "date", *r6(ret=F.col("ret"), std20=I.rolling_std("ret", 20), annual=I.rolling_std("ret", 20, annualize=250))),
    with_views("bars", f""", r as (select symbol, date, {_RET} as ret from bars), s as (select *, stddev_samp(ret) over (partition by symbol order by date rows 19 preceding) as s from r)
        select symbol, date, round(ret, 6) as ret, round(s, 6) as std20, round(s * sqrt(250), 6) as annual from s"""),
)
Q["w7_w12_range"] = (
    lambda v: I.with_extremes(v.bars, {"hi": ("close_adj", 250)}, {"lo": ("close_adj", 250)}).select("symbol", "date", *r6(high250=F.col("hi"), low250=F.col("lo"), dist=I.ratio(F.col("hi") - F.col("close_adj"), F.col("hi")) * 100)),
    with_views("bars", """, m as (select *, max(close_adj) over (partition by symbol order by date rows 249 preceding) as hi, min(close_adj) over (partition by symbol order by date rows 249 preceding) as lo from bars)
        select symbol, date, round(hi, 6) as high250, round(lo, 6) as low250, round((hi - close_adj) / hi * 100, 6) as dist from m"""),
)
Q["w8_w9_slope_deviation"] = (
    lambda v: I.with_means(v.bars, "close_adj", {"ma20": 20, "ma30": 30}).select("symbol", "date", *r6(slope20=I.slope_pct("ma20"), slope30=I.slope_pct("ma30"), dev=I.deviation_pct("close_adj", "ma20"))),
    with_views("bars", f""", m as (select *, {_avg(20)} as a, {_avg(30)} as b from bars),
        p as (select *, coalesce(lag(a, 5) over (partition by symbol order by date), a) as pa, coalesce(lag(b, 5) over (partition by symbol order by date), b) as pb from m)
        select symbol, date, round((a - pa) / pa * 100, 6) + 0::double as slope20, round((b - pb) / pb * 100, 6) + 0::double as slope30, round((close_adj - a) / a * 100, 6) as dev from p"""),
)
Q["w10_w11_forward_trailing"] = (
    lambda v: v.bars.withColumn("ret", I.pct_return()).select("symbol", "date", *r6(fwd=I.forward_return(5), top14=I.trailing_max("ret", 14, 1))),
    with_views("bars", f""", r as (select symbol, date, {_RET} as ret, (lead(close_adj, 5) over (partition by symbol order by date) - close_adj) / close_adj * 100 as fwd from bars)
        select symbol, date, round(fwd, 6) as fwd, round(max(ret) over (partition by symbol order by date rows between 14 preceding and 1 preceding), 6) as top14 from r"""),
)
Q["w13_w14_first_recency"] = (
    lambda v: v.bars.select("symbol", "date", I.first_date().alias("first"), I.recency_rank().alias("rank")),
    with_views("bars", "select symbol, date, min(date) over (partition by symbol) as first, row_number() over (partition by symbol order by date desc) as rank from bars"),
)
Q["w15_w16_drawdown"] = (
    lambda v: curves.curve_with_drawdown(v.equity_curve).select("date", *r6(ret=F.col("ret"), peak=F.col("peak"), drawdown=F.col("drawdown"))),
    with_views("equity_curve", """, p as (select *, max(total_value) over (order by date) as peak, lag(total_value) over (order by date) as b from equity_curve)
        select date, round(coalesce((total_value - b) / b, 0), 6) + 0::double as ret, round(peak, 6) as peak, round((total_value - peak) / peak, 6) + 0::double as drawdown from p"""),
)
_MONTHLY = ", m as (select symbol, cast(date_trunc('month', date) as date) as month, round(sum(cast(amount as decimal(18,2)))::double, 2) as amount, max(high_adj) as max_high_adj, min(low_adj) as min_low_adj from bars group by 1, 2)"
Q["w17_monthly_bars"] = (lambda v: periods.monthly_bars(v.bars).withColumn("amount", F.round("amount", 2)), with_views("bars", _MONTHLY + " select * from m"))
_RATED = _MONTHLY + ", q as (select *, amount / nullif(lag(amount) over (partition by symbol order by month), 0) as ratio from m)"
Q["w18_w19_abnormal_count"] = (
    lambda v: periods.abnormal_count(periods.monthly_bars(v.bars), 3.0, 12).select("symbol", "month", F.round("mom_ratio", 6).alias("mom_ratio"), "abnormal_months_count"),
    with_views("bars", _RATED + " select symbol, month, round(ratio, 6) as mom_ratio, coalesce(sum(case when ratio >= 3 then 1 else 0 end) over (partition by symbol order by month rows between 12 preceding and 1 preceding), 0)::bigint as abnormal_months_count from q"),
)
Q["w20_hist_range"] = (
    lambda v: periods.hist_range(periods.monthly_bars(v.bars), 12).select("symbol", "month", "hist_max_high_adj", "hist_min_low_adj"),
    with_views("bars", _MONTHLY + " select symbol, month, coalesce(max(max_high_adj) over f, 0) as hist_max_high_adj, coalesce(min(min_low_adj) over f, 0) as hist_min_low_adj from m window f as (partition by symbol order by month rows between 12 preceding and 1 preceding)"),
)
Q["w21_nth_in_month"] = (lambda v: universe.nth_in_month(v.bars).select("symbol", "date", "nth"), with_views("bars", "select symbol, date, row_number() over (partition by symbol, date_trunc('month', date) order by date) as nth from bars"))


def _resampled(v: Views, lookahead: bool):
    out = periods.resample_ma(periods.resample_ma(v.bars, "month", 12, lookahead), "quarter", 4, lookahead)
    return out.select("symbol", "date", *r6(ma_month=F.col("ma_month"), ma_quarter=F.col("ma_quarter")))


def _resample_sql(lag: str) -> str:
    parts, joins, cols = "", "", []
    for unit, n in (("month", 12), ("quarter", 4)):
        parts += f""", c{unit} as (select symbol, date_trunc('{unit}', date) as p, arg_max(close, date) as c from bars group by 1, 2),
            a{unit} as (select symbol, p, case when row_number() over (partition by symbol order by p) >= {n} then avg(c) over (partition by symbol order by p rows {n - 1} preceding) end as ma from c{unit}),
            l{unit} as (select symbol, p, {lag} as ma from a{unit})"""
        joins += f" left join l{unit} on b.symbol = l{unit}.symbol and date_trunc('{unit}', b.date) = l{unit}.p"
        cols.append(f"round(l{unit}.ma, 6) as ma_{unit}")
    return parts + f" select b.symbol, b.date, {', '.join(cols)} from bars b" + joins


Q["w22_resample_ma"] = (lambda v: _resampled(v, True), with_views("bars", _resample_sql("ma")))
Q["w22_resample_ma_previous"] = (lambda v: _resampled(v, False), with_views("bars", _resample_sql("lag(ma) over (partition by symbol order by p)")))
Q["w23_daily_slope"] = (
    lambda v: periods.daily_ma_slope(v.bars).select("symbol", "date", *r6(ma=F.col("ma_day"), slope=F.col("ma_day_slope"))),
    with_views("bars", f""", m as (select symbol, date, case when row_number() over (partition by symbol order by date) >= 30 then {_avg(30, "close")} end as ma from bars)
        select symbol, date, round(ma, 6) as ma, round(ma - lag(ma) over (partition by symbol order by date), 6) + 0::double as slope from m"""),
)
_MAS = (5, 10, 20, 30, 60, 120, 250)
_ALIGNED = " and ".join(f"ma{a} - ma{b} > 1e-9" for a, b in zip(_MAS, _MAS[1:], strict=False))
#: calendar days that the screens of the latest date look back here: the bars are weekly
WARM = 840
_UNCUT = ", recent as (select * from bars)"
_RECENT = f", recent as (select * from bars where date >= (select max(date) from bars) - {WARM})"


def _all_ma(source: str) -> str:
    return ", a as (select *, " + ", ".join(f"{_avg(n)} as ma{n}" for n in _MAS) + f", {_avg(5, 'volume')} as v5 from {source})"


_ALL_MA = _all_ma("bars")
_RECENT_MA = _RECENT + _all_ma("recent")
Q["w24_bull_aligned"] = (
    lambda v: I.with_means(v.bars, "close_adj", {f"ma{n}": n for n in I.MA_LENGTHS}).where(I.bull_aligned([f"ma{n}" for n in I.MA_LENGTHS])).select("symbol", "date"),
    with_views("bars", _ALL_MA + f" select symbol, date from a where {_ALIGNED}"),
)


def _regimes(v: Views):
    rows = [periods.regime(v.index_bars, 60, 5, p).select("date", F.lit(p).alias("preset"), F.round("ma", 9).alias("ma"), "ok") for p in ("resonance", "pullback", "reversal", "custom")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


Q["w25_regime"] = (
    _regimes,
    with_views("index_bars", """, m as (select date, close, case when row_number() over (order by date) >= 60 then avg(close) over (order by date rows 59 preceding) end as ma from index_bars),
        p as (select *, lag(ma, 5) over (order by date) as b from m), s as (select * from (values ('resonance'), ('pullback'), ('reversal'), ('custom')) as t(preset))
        select date, preset, round(ma, 9) as ma, case when ma is null or b is null or preset = 'custom' then true when preset = 'resonance' then ma > b and close > ma
            when preset = 'pullback' then ma > b and close < ma else ma < b and close < ma end as ok from p, s"""),
)
DRIFT = """, r as (select *, (close_adj - lag(close_adj) over (partition by symbol order by date)) / lag(close_adj) over (partition by symbol order by date) as r, row_number() over (partition by symbol order by date desc) as rn from bars),
    dv as (select symbol, max(date) as date, arg_max(close_adj, date) as close, coalesce(avg(r), 0.0005) as drift, case when stddev_samp(r) > 0 then stddev_samp(r) else 0.02 end as vol from r where rn <= 60 group by 1)"""
Q["w26_drift_vol"] = (
    lambda v: periods.drift_vol(v.bars).select("symbol", "date", *r6(close=F.col("close"), drift=F.col("drift"), vol=F.col("vol"))),
    with_views("bars", DRIFT + " select symbol, date, round(close, 6) as close, round(drift, 6) as drift, round(vol, 6) as vol from dv"),
)

# ---------------------------------------------------------------- market
_TEMP = _RECENT + f""", r as (select *, {_RET} as ret from recent), t as (select * from r where date = (select max(date) from bars) and ret is not null),
    k as (select max(date) as trade_date, count(*) as total_stocks, median(ret) as median_return, count(*) filter (where ret = 0) as flat_count,
        count(*) filter (where ret < -9.9) as limit_down, count(*) filter (where ret between -9.9 and -7) as n7_10, count(*) filter (where ret <= -5 and ret > -7) as n5_7,
        count(*) filter (where ret <= -3 and ret > -5) as n3_5, count(*) filter (where ret < 0 and ret > -3) as n0_3, count(*) filter (where ret > 0 and ret < 3) as p0_3,
        count(*) filter (where ret >= 3 and ret < 5) as p3_5, count(*) filter (where ret >= 5 and ret < 7) as p5_7, count(*) filter (where ret between 7 and 9.9) as p7_10,
        count(*) filter (where ret > 9.9) as limit_up from t)"""
_BINS = "limit_down, n7_10, n5_7, n3_5, n0_3, p0_3, p3_5, p5_7, p7_10, limit_up"
Q["m1_market_temperature"] = (
    lambda v: market.market_temperature(v.bars, warmup_days=WARM).withColumn("median_return", F.round("median_return", 6)),
    with_views("bars", _TEMP + f" select trade_date, total_stocks, round(median_return, 6) as median_return, flat_count, {_BINS} from k"),
)
_RISE = _TEMP + ", f as (select *, p0_3 + p3_5 + p5_7 + p7_10 + limit_up as rising, limit_down + n7_10 + n5_7 + n3_5 + n0_3 as falling from k)"
Q["m2_m14_rise_fall_env"] = (
    lambda v: market.market_env(market.rise_fall(market.market_temperature(v.bars, warmup_days=WARM))).select("trade_date", "rising", "falling", *r6(rising_pct=F.col("rising_pct"), falling_pct=F.col("falling_pct"), advance_decline=F.col("advance_decline"), temperature_index=F.col("temperature_index")), "market_env"),
    with_views("bars", _RISE + """ select trade_date, rising, falling, round(rising * 100.0 / total_stocks, 6)::double as rising_pct, round(falling * 100.0 / total_stocks, 6)::double as falling_pct,
        round(rising::double / greatest(1, falling), 6) as advance_decline, round(coalesce(rising * 100.0::double / nullif(rising + falling, 0), 50), 6) as temperature_index,
        case when coalesce(rising * 100.0 / nullif(rising + falling, 0), 50) > 65 then 'bull' when coalesce(rising * 100.0 / nullif(rising + falling, 0), 50) < 35 then 'defensive' else 'balanced' end as market_env from f"""),
)
_LIMIT = "coalesce(case when symbol like 'sh60%' or symbol like 'sz00%' then ret >= 9.91 when symbol like 'sh68%' or symbol like 'sz30%' then ret >= 19.91 else false end, false)"


def _flags(source: str) -> str:
    return f""", fr as (select *, (close - lag(close) over (partition by symbol order by date)) / nullif(lag(close) over (partition by symbol order by date), 0) * 100 as ret from {source}), fl as (select *, {_LIMIT} as up from fr)"""


_FLAGS = _flags("bars")
_STREAKS = _RECENT + _flags("recent") + """, g as (select *, count(*) filter (where not up) over (partition by symbol order by date rows unbounded preceding) as isle from fl),
    st as (select symbol, close, ret, date, (select count(*) from g h where h.symbol = g.symbol and h.isle = g.isle and h.up) as streak from g where up and date = (select max(date) from bars))"""
Q["m3_limit_up_streaks"] = (lambda v: market.limit_up_streaks(v.bars, warmup_days=WARM).withColumn("ret", F.round("ret", 6)), with_views("bars", _STREAKS + " select symbol, close, round(ret, 6) as ret, streak from st"))
#: the same screens against SQL that reads the whole history: the warm-up leaves nothing out
for _name in ("m1_market_temperature", "m3_limit_up_streaks"):
    Q[f"{_name}_uncut"] = (Q[_name][0], Q[_name][1].replace(_RECENT, _UNCUT))
Q["m4_streak_ladder"] = (
    lambda v: market.streak_ladder(market.limit_up_streaks(v.bars, warmup_days=WARM), v.names),
    with_views("bars names", _STREAKS + " select streak, count(*) as stocks, string_agg(coalesce(n.name, st.symbol), ',' order by coalesce(n.name, st.symbol)) as symbols from st left join names n on n.symbol = st.symbol group by 1"),
)
_TODAY = _RECENT + f""", x as (select *, {_avg(5)} as ma5, {_avg(10)} as ma10, {_avg(20)} as ma20, {_avg(60)} as ma60, {_avg(5, "volume")} as v5 from recent),
    d as (select symbol, close_adj > ma20 as above, ma5 - ma10 > 1e-9 and ma10 - ma20 > 1e-9 and ma20 - ma60 > 1e-9 as bull, close_adj > ma20 and volume > 1.5 * v5 as brk from x where date = (select max(date) from bars))"""


def _breadth_sql(members: str, key: str) -> str:
    return _TODAY + f""", m as ({members}) select {key}, count(*) as total, count(*) filter (where above) as above_ma20_count, count(*) filter (where bull) as bull_count, count(*) filter (where brk) as breakout_count,
        coalesce(string_agg(d.symbol, ',' order by d.symbol) filter (where brk), '') as breakout_symbols, count(*) filter (where above) * 100.0::double / count(*) as above_ma20_ratio, count(*) filter (where bull) * 100.0::double / count(*) as bull_ratio
        from d join m on d.symbol = m.symbol group by 1"""


_CONCEPT = "select distinct market || code as symbol, block_name from blocks where block_category = 'concept'"
Q["m5_concept_breadth"] = (lambda v: market.concept_breadth(v.bars, v.blocks, warmup_days=WARM), with_views("bars blocks", _breadth_sql(_CONCEPT, "block_name")))
Q["m6_industry_breadth"] = (lambda v: market.industry_breadth(v.bars, v.industries, warmup_days=WARM), with_views("bars industries", _breadth_sql("select distinct symbol, industry_name from industries", "industry_name")))
#: a screen date in the past
_PAST = "1998-06-01"
_past = lambda sql: sql.replace("(select max(date) from bars)", f"date '{_PAST}'").replace(f"date >= date '{_PAST}' - {WARM}", f"date between date '{_PAST}' - {WARM} and date '{_PAST}'")
Q["m5_concept_breadth_past"] = (lambda v: market.concept_breadth(v.bars, v.blocks, warmup_days=WARM, date=_PAST), _past(Q["m5_concept_breadth"][1]))
Q["m6_industry_breadth_past"] = (lambda v: market.industry_breadth(v.bars, v.industries, warmup_days=WARM, date=_PAST), _past(Q["m6_industry_breadth"][1]))
Q["m7_breadth_label"] = (
    lambda v: market.industry_breadth(v.bars, v.industries, warmup_days=WARM).select("industry_name", market.breadth_label(F.col("above_ma20_ratio")).alias("label")),
    with_views("bars industries", _TODAY + """, s as (select industry_name, count(*) filter (where above) * 100.0 / count(*) as share from d join industries m on d.symbol = m.symbol group by 1)
        select industry_name, case when share >= 40 then 'main line' when share >= 25 then 'medium-term bull' else 'local' end as label from s"""),
)
_PROFILE = """, l as (select * from index_bars order by date desc limit 120), s as (select min(close) as lo, max(close) as hi from l),
    v as (select least(floor((close - lo) / nullif(hi - lo, 0) * 10)::int + 1, 10) as bucket, close, amount from l, s),
    p as (select coalesce(bucket, 1) as bucket, min(close) as min_close, max(close) as max_close, round(sum(amount), 2) as amount, count(*) as days from v group by 1)"""
Q["m8_volume_profile"] = (lambda v: market.volume_profile(v.index_bars).withColumn("amount", F.round("amount", 2)), with_views("index_bars", _PROFILE + " select * from p"))
Q["m9_share_of_total"] = (
    lambda v: market.share_of_total(market.volume_profile(v.index_bars), "amount").select("bucket", F.round("amount_share", 6).alias("amount_share")),
    with_views("index_bars", _PROFILE + " select bucket, round(amount * 100 / sum(amount) over (), 6) as amount_share from p"),
)


def _flow_sql(members: str, key: str) -> str:
    return f""", ds as (select distinct date from bars order by date desc limit 30), b30 as (select * from bars where date in (select date from ds)), mk as (select date, sum(amount) as a from b30 group by 1),
        m as ({members}), fw as (select b30.date, {key}, sum(amount) as sector_amount from b30 join m on m.symbol = b30.symbol group by 1, 2),
        flow as (select fw.date, {key}, sector_amount, sector_amount * 100 / mk.a as sector_ratio from fw join mk on mk.date = fw.date)"""


_FLOW_OUT = "select date, {k}, round(sector_amount, 2) as sector_amount, round(sector_ratio, 6) as sector_ratio from flow"
_rounded = lambda f, k: f.select("date", k, F.round("sector_amount", 2).alias("sector_amount"), F.round("sector_ratio", 6).alias("sector_ratio"))
Q["m10_industry_flow"] = (lambda v: _rounded(market.industry_flow(v.bars, v.industries), "industry_name"), with_views("bars industries", _flow_sql("select distinct symbol, industry_name from industries", "industry_name") + _FLOW_OUT.format(k="industry_name")))
Q["m11_concept_flow"] = (lambda v: _rounded(market.concept_flow(v.bars, v.blocks), "block_name"), with_views("bars blocks", _flow_sql(_CONCEPT, "block_name") + _FLOW_OUT.format(k="block_name")))
Q["m12_top_bottom_series"] = (
    lambda v: market.top_bottom_series(market.concept_flow(v.bars, v.blocks), "block_name"),
    with_views("bars blocks", _flow_sql(_CONCEPT, "block_name") + """, now as (select * from flow where date = (select max(date) from flow)),
        e as (select * from (select 'top' as side, block_name from now order by sector_ratio desc, block_name limit 10) union all select * from (select 'bottom' as side, block_name from now order by sector_ratio, block_name limit 10)),
        fr as (select side, block_name, date from e, (select distinct date from flow))
        select fr.side, fr.block_name, fr.date, round(coalesce(sector_amount, 0) / 1e8, 2) as amount, round(coalesce(sector_ratio, 0), 4) as ratio from fr left join flow on fr.block_name = flow.block_name and fr.date = flow.date"""),
)
Q["m13_market_turnover"] = (
    lambda v: market.market_turnover(v.bars, v.index_bars).select("date", *(F.round(c, 2).alias(c) for c in ("sh", "sz", "chinext", "bj", "star", "total"))),
    with_views("bars", "select date, " + ", ".join(f"coalesce(round(sum(amount) filter (where symbol like '{p}%'), 2), 0) as {n}" for n, p in (("sh", "sh60"), ("sz", "sz00"), ("chinext", "sz30"), ("bj", "bj"), ("star", "sh68"))) + ", round(sum(amount), 2) as total from bars where date in (select distinct date from bars order by date desc limit 30) group by 1"),
)


# ------------------------------------------------------------------ as bars arrive
def w1_w5_m3_on_arrival(v: Views):
    """Averages, returns and streaks of all bars, which arrive in three parts; each part sees the state that the one before left."""
    spark, bars = v.spark, v.bars.select("symbol", "date", "close", "close_adj")
    came, out = shared_path(spark, "arriving"), shared_path(spark, "arrived")
    edges = ("1900-01-01", "1994-06-01", "1998-03-01", "2100-01-01")
    for part, (first, last) in enumerate(zip(edges, edges[1:], strict=False)):
        bars.where((F.col("date") >= first) & (F.col("date") < last)).write.parquet(f"{came}/part={part}")
        running = arrivals.on_arrival(spark.readStream.schema(bars.schema).parquet(came), idle_days=4000)  # longer than any pause, as the SQL has none
        running.writeStream.format("parquet").option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("symbol", "date", "streak", *r6(ma5=F.col("ma5"), ma20=F.col("ma20"), ret=F.col("ret")))


Q["w1_w5_m3_on_arrival"] = (
    w1_w5_m3_on_arrival,
    with_views("bars", _FLAGS + f""", g as (select *, count(*) filter (where not up) over (partition by symbol order by date rows unbounded preceding) as isle from fl)
        select symbol, date, round({_avg(5)}, 6) + 0::double as ma5, round({_avg(20)}, 6) + 0::double as ma20, round(ret, 6) + 0::double as ret, count(*) filter (where up) over (partition by symbol, isle order by date rows unbounded preceding) as streak from g"""),
)
