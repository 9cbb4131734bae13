"""Queries over screens (S), lookups (Q), profiles (P) and pattern similarity (D), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup, market, periods, profile, screens, similarity, terms
from ..sources.store import current_sql
from .fixtures import Views, with_views
from .indicators_market import DRIFT, WARM, _ALL_MA, _RECENT, _RECENT_MA, _RET, _UNCUT, _avg, r6

Q: dict[str, tuple] = {}
_MAS = (5, 10, 20, 60)
_SHORT = "ma5 - ma10 > 1e-9 and ma10 - ma20 > 1e-9 and ma20 - ma60 > 1e-9"
_TODAY = "date = (select max(date) from bars)"


def _shown(df, *more):
    return df.select(*more, "symbol", "Close", *r6(Vol_Ratio=F.col("Vol_Ratio"), Dev_MA20_Pct=F.col("Dev_MA20_Pct")), "Resonance_Sectors")


def _resonance_sql(condition: str, when: str, least: int = 3, averages: str = _RECENT_MA) -> str:
    """CTEs up to res(date, symbol, Close, Vol_Ratio, Dev_MA20_Pct, Resonance_Sectors)."""
    return averages + f""", pk as (select date, symbol, close_adj, volume / v5 as vr, (close_adj - ma20) / ma20 * 100 as dev from a where {when} and {condition}),
        mb as (select distinct market || code as symbol, block_name from blocks where block_category = 'concept'), sz as (select block_name, count(*) as size from mb group by 1),
        hit as (select pk.date, pk.symbol, block_name from pk join mb on mb.symbol = pk.symbol), st as (select date, block_name, count(*) as n from hit group by 1, 2 having count(*) >= {least}),
        lab as (select hit.date, hit.symbol, string_agg(hit.block_name || '(' || n || '/' || format('{{:.1f}}', round(n * 100.0 / size, 1)::double) || '%)', ', ' order by hit.block_name || '(' || n || '/' || format('{{:.1f}}', round(n * 100.0 / size, 1)::double) || '%)') as s
            from hit join st on hit.date = st.date and hit.block_name = st.block_name join sz on sz.block_name = hit.block_name group by 1, 2),
        res as (select pk.date, pk.symbol, close_adj as Close, round(vr, 6) as Vol_Ratio, round(dev, 6) as Dev_MA20_Pct, s as Resonance_Sectors from pk join lab on pk.date = lab.date and pk.symbol = lab.symbol)"""


_BREAK = "close_adj > ma20 and volume > 1.5 * v5"
_OUT = " select symbol, Close, Vol_Ratio, Dev_MA20_Pct, Resonance_Sectors from res"
Q["s1_volume_breakout"] = (
    lambda v: screens.factors(v.bars, (20,)).where(screens.volume_breakout()).groupBy("date").agg(F.count(F.lit(1)).alias("breakouts")),
    with_views("bars", _ALL_MA + f" select date, count(*) as breakouts from a where {_BREAK} group by 1"),
)
Q["s2_resonance_breakout"] = (lambda v: _shown(screens.validate_screen(screens.resonance_breakout(v.bars, v.blocks, warmup_days=WARM))), with_views("bars blocks", _resonance_sql(_BREAK, _TODAY) + _OUT))
Q["s3_ma_long_sequence"] = (
    lambda v: _shown(screens.ma_long_sequence(v.bars, v.blocks, 0.5, _MAS, 2, warmup_days=WARM)),
    with_views("bars blocks", _resonance_sql(_SHORT + " and volume >= 0.5 * v5", _TODAY, 2) + _OUT),
)
#: the same screen against SQL that reads the whole history
Q["s3_ma_long_sequence_uncut"] = (Q["s3_ma_long_sequence"][0], Q["s3_ma_long_sequence"][1].replace(_RECENT, _UNCUT))
Q["s4_dual_resonance"] = (
    lambda v: _shown(screens.dual_resonance(v.bars, v.blocks, 1.1, (5, 10, 20), 1, warmup_days=WARM)),
    with_views("bars blocks", _resonance_sql("close_adj > ma20 and volume > 1.1 * v5 and ma5 - ma10 > 1e-9 and ma10 - ma20 > 1e-9", _TODAY, 1) + _OUT),
)


def _two(v: Views):
    return screens.resonance_breakout(v.bars, v.blocks, 1.0, 1, warmup_days=WARM), screens.ma_long_sequence(v.bars, v.blocks, 0.5, (5, 10, 20), 1, warmup_days=WARM)


def s5_s6_intersect(v: Views):
    both = screens.merge_sectors(screens.intersect(*_two(v)), ["Resonance_Sectors", "Resonance_Sectors_other"])
    return both.select("symbol", "Close", *r6(Vol_Ratio=F.col("Vol_Ratio"), Vol_Ratio_other=F.col("Vol_Ratio_other")), "Sectors")


Q["s5_s6_intersect"] = (
    s5_s6_intersect,
    with_views("bars blocks", _RECENT_MA + """, mb as (select distinct market || code as symbol, block_name from blocks where block_category = 'concept'), sz as (select block_name, count(*) as size from mb group by 1),
        d as (select * from a where date = (select max(date) from bars)),
        h as (select 1 as k, d.symbol, block_name from d join mb on mb.symbol = d.symbol where close_adj > ma20 and volume > v5 union all
            select 2, d.symbol, block_name from d join mb on mb.symbol = d.symbol where ma5 - ma10 > 1e-9 and ma10 - ma20 > 1e-9 and volume >= 0.5 * v5),
        n as (select k, h.block_name, count(*) as n, any_value(size) as size from h join sz on sz.block_name = h.block_name group by 1, 2),
        l as (select distinct h.symbol, h.k, h.block_name || '(' || n || '/' || format('{:.1f}', round(n * 100.0 / size, 1)::double) || '%)' as s from h join n on n.k = h.k and n.block_name = h.block_name),
        b as (select symbol from l group by 1 having count(distinct k) = 2), u as (select symbol, string_agg(distinct s, ', ' order by s) as Sectors from l group by 1)
        select b.symbol, close_adj as Close, round(volume / v5, 6) as Vol_Ratio, round(volume / v5, 6) as Vol_Ratio_other, Sectors from b join d on d.symbol = b.symbol join u on u.symbol = b.symbol"""),
)
Q["s7_with_slopes"] = (
    lambda v: screens.with_slopes(screens.resonance_breakout(v.bars, v.blocks, warmup_days=WARM), v.bars, warmup_days=WARM).select("symbol", *r6(slope_ma20=F.col("slope_ma20"), slope_ma30=F.col("slope_ma30"))),
    with_views("bars blocks", _resonance_sql(_BREAK, _TODAY) + """, pv as (select *, coalesce(lag(ma20, 5) over (partition by symbol order by date), ma20) as p20, coalesce(lag(ma30, 5) over (partition by symbol order by date), ma30) as p30,
            row_number() over (partition by symbol order by date desc) as rn from a)
        select res.symbol, round((ma20 - p20) / p20 * 100, 6) as slope_ma20, round((ma30 - p30) / p30 * 100, 6) as slope_ma30 from res join pv on pv.symbol = res.symbol where rn = 1"""),
)
Q["s9_rebalance_dates"] = (
    lambda v: screens.rebalance_dates(v.lineitem.select(F.to_date("l_shipdate").alias("date")), "1997-01-01", "1997-12-31"),
    "with d as (select distinct cast(l_shipdate as date) as date from lineitem where cast(l_shipdate as date) between date '1997-01-01' and date '1997-12-31') select date from d where isodow(date) = 1 or date = (select min(date) from d)",
)
Q["s8_select_all_dates"] = (
    lambda v: _shown(screens.select_all_dates(v.bars, v.blocks, screens.rebalance_dates(v.bars, "1998-01-01", "1998-12-31")), "date"),
    with_views("bars blocks", _resonance_sql(_BREAK, "date between date '1998-01-01' and date '1998-12-31' and (isodow(date) = 1 or date = (select min(date) from bars where date >= date '1998-01-01'))", averages=_ALL_MA) + " select date, symbol, Close, Vol_Ratio, Dev_MA20_Pct, Resonance_Sectors from res"),
)


def s10_catalogue(v: Views):
    own = screens.default_catalogue()
    own.register("market_temperature", "Temperature", "Not shown in the list", market.market_temperature)
    own.register("thin", "Thin trading", "Instruments below a volume at the latest date", "select symbol, close_adj as Close, cast(volume as double) as Vol_Ratio from bars where date = (select max(date) from bars) and volume < :most")
    thin = own.run(v.spark, "thin", {"bars": v.bars}, most=60)
    listed = own.list_strategies(v.spark).agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"))
    return thin.crossJoin(F.broadcast(listed))


def s10_table_function(v: Views):
    """A strategy in SQL, called twice in FROM with different arguments and joined to industries; it reads the store and leaves no view."""
    own = screens.Catalogue()
    own.register("strong_days", "Strong days", "Bars that gained on the open by a share, from a date on", "select symbol, date, close / open - 1 as gain from bars where open > 0 and close / open - 1 >= :least and date >= cast(:since as date)")
    name = own.as_table_function(v.spark, "strong_days", {"least": "double", "since": "string"}, "symbol string, date date, gain double", {"bars": current_sql(v.store)})
    text = f"""select i.industry_name, count(*) as days, count(s.gain) as very_strong, round(max(a.gain), 6) as best from {name}(0.05, '1997-01-01') a
        join {{industries}} i on i.symbol = a.symbol left join {name}(least => 0.2, since => '1998-01-01') s on s.symbol = a.symbol and s.date = a.date group by 1"""
    return v.spark.sql(text, industries=v.industries)


Q["s10_table_function"] = (
    s10_table_function,
    with_views("bars industries", """, d as (select symbol, date, close / open - 1 as gain from bars where open > 0)
        select i.industry_name, count(*) as days, count(*) filter (where a.gain >= 0.2 and a.date >= date '1998-01-01') as very_strong, round(max(a.gain), 6) as best
        from d a join industries i on i.symbol = a.symbol where a.gain >= 0.05 and a.date >= date '1997-01-01' group by 1"""),
)


Q["s10_s11_catalogue"] = (s10_catalogue, with_views("bars", f"select symbol, close_adj as Close, volume::double as Vol_Ratio, 'dual_resonance,ma_long_sequence,resonance_breakout,thin' as keys from bars where {_TODAY} and volume < 60"))

# --------------------------------------------------------------- lookups
Q["q1_list_blocks"] = (lambda v: lookup.list_blocks(v.blocks, "style"), with_views("blocks", "select distinct block_name from blocks where block_category = 'style'"))
Q["q2_search_blocks"] = (
    lambda v: lookup.search_blocks(v.blocks, "brand#1"),
    with_views("blocks", ", h as (select * from blocks where contains(lower(block_name), 'brand#1')) select block_name, block_category, count(distinct market || code) as members, lower(block_name) = 'brand#1' as exact, (select count(distinct block_name) from h) = 1 as single from h group by 1, 2"),
)
Q["q3_block_members"] = (lambda v: lookup.block_members(v.blocks, "Brand#12"), with_views("blocks", "select distinct upper(market) || code as symbol from blocks where block_name = 'Brand#12'"))
Q["q4_instrument_blocks"] = (
    lambda v: lookup.instrument_blocks(v.blocks, v.industries, "sh600005"),
    with_views("blocks industries", ", u as (select distinct block_category as category, block_name as name from blocks where market || code = 'sh600005' union all select 'industry', industry_name from industries where symbol = 'sh600005') select category, string_agg(name, ', ' order by name) as names from u group by 1"),
)
Q["q5_keyword_members"] = (
    lambda v: lookup.keyword_members(v.blocks.unionByName(v.blocks.withColumn("block_name", F.lit("UNITED BRANDS")).where("block_category = 'concept' and code like '%1'")), v.industries, v.names.where("initials not like '%1'"), "UNITED"),
    with_views("blocks industries names", """, i as (select distinct symbol from industries where contains(industry_name, 'UNITED')), b as (select distinct market || code as symbol from blocks where block_category = 'concept' and code like '%1'),
        u as (select symbol, 'industry' as origin from i union all select symbol, 'block' from b where symbol not in (select symbol from i))
        select upper(u.symbol) as symbol, coalesce(n.name, '') as name, origin from u left join names n on n.symbol = u.symbol and n.initials not like '%1'"""),
)
Q["q6_search_instruments"] = (
    lambda v: lookup.search_instruments(v.names, "s12").unionByName(lookup.search_instruments(v.names, "00000004")).unionByName(lookup.search_instruments(v.names, "sz30")),
    with_views("names", ", t as (select * from names order by symbol) " + " union all ".join(f"select * from (select upper(symbol) as symbol, name, initials from t where {c} order by t.symbol limit 15)" for c in ("starts_with(initials, 's12') or contains(lower(name), 's12') or (length(initials) >= 3 and starts_with('s12', initials))", "contains(lower(name), '00000004') or starts_with(substr(symbol, 3, 6), '00000004')", "starts_with(symbol, 'sz30')"))),
)
Q["q6_initials"] = (
    lambda v: lookup.initials_of(v.names.select("symbol", "name"), v.spark.sql("select 'S' as char, 'x' as initial union all select '#', ''")).select("symbol", "initials"),
    with_views("names", "select symbol, lower(replace(replace(name, 'S', 'x'), '#', '')) as initials from names"),
)


def _terms(v: Views):
    """All names of blocks, industries and instruments, and terms cut from them: words, ends, beginnings and letters."""
    texts = v.blocks.select(F.concat_ws(":", "block_category", "block_name").alias("key"), F.col("block_name").alias("text"))
    texts = texts.unionByName(v.industries.select(F.concat(F.lit("industry:"), "industry_name").alias("key"), F.col("industry_name").alias("text"))).unionByName(v.names.select(F.col("symbol").alias("key"), F.col("name").alias("text")))
    index = v.kept("postings", lambda: terms.postings(texts))
    parts = F.concat(F.split("text", " "), F.array(F.substring("text", -3, 3), F.substring("text", 1, 2), F.substring("text", 2, 1), F.concat("text", F.lit("x")), F.expr("right(text, 2) || left(text, 2)")))
    return terms.search_terms(texts.select(F.explode(parts).alias("term")), index)


Q["q2_q6_search_terms"] = (
    lambda v: _terms(v).groupBy("term").agg(F.count(F.lit(1)).alias("hits"), F.min("key").alias("first_key"), F.max("key").alias("last_key")),
    with_views("blocks industries names", """, x as (select distinct block_category || ':' || block_name as key, block_name as text from blocks union select 'industry:' || industry_name, industry_name from industries union select symbol, name from names),
        t as (select distinct unnest(list_concat(string_split(text, ' '), [right(text, 3), left(text, 2), substr(text, 2, 1), text || 'x', right(text, 2) || left(text, 2)])) as term from x)
        select term, count(*) as hits, min(key) as first_key, max(key) as last_key from t join x on contains(lower(text), lower(term)) where term <> '' group by 1"""),
)
Q["q7_recent_bars"] = (
    lambda v: lookup.recent_bars(v.bars, "sz300003", 10).select("symbol", "date", "close", "bars", "first_date", "last_date"),
    with_views("bars", "select symbol, date, close, (select count(*) from bars where symbol = 'sz300003') as bars, (select min(date) from bars where symbol = 'sz300003') as first_date, (select max(date) from bars where symbol = 'sz300003') as last_date from bars where symbol = 'sz300003' order by date desc limit 10"),
)

# -------------------------------------------------------------- profiles
_MA7 = (5, 10, 20, 30, 60, 120, 250)
_FEATURES = f""", l as (select * from (select *, row_number() over (partition by symbol order by date desc) as rn from bars) where rn <= 260),
    q as (select *, {_RET} as ret, {", ".join(f"{_avg(n)} as ma{n}" for n in _MA7)}, max(close_adj) over (partition by symbol order by date rows 249 preceding) as hi, min(close_adj) over (partition by symbol order by date rows 249 preceding) as lo,
        volume / {_avg(5, "volume")} as vr5, volume / {_avg(20, "volume")} as vr20 from l),
    z as (select *, coalesce(stddev_samp(ret) over (partition by symbol order by date rows 19 preceding) * sqrt(250), 0) as vol, coalesce(lag(ma20, 5) over (partition by symbol order by date), ma20) as p20, coalesce(lag(ma30, 5) over (partition by symbol order by date), ma30) as p30 from q),
    feat as (select symbol, date, close_adj as close, coalesce(ret, 0) as ret, {", ".join(f"ma{n}" for n in _MA7)}, hi as high_250, lo as low_250, (hi - close_adj) / hi * 100 as dist_high_pct, (close_adj - ma20) / ma20 * 100 as dev_ma20,
        (ma20 - p20) / p20 * 100 as slope_ma20, (ma30 - p30) / p30 * 100 as slope_ma30, volume, vr5 as vol_ratio_5, vr20 as vol_ratio_20, vol as volatility,
        case when vol > 45 then 'very high' when vol > 30 then 'high' when vol > 18 then 'medium' else 'low' end as risk_level from z where rn = 1)"""
_FCOLS = ["close", "ret", *(f"ma{n}" for n in _MA7), "high_250", "low_250", "dist_high_pct", "dev_ma20", "slope_ma20", "slope_ma30", "vol_ratio_5", "vol_ratio_20", "volatility"]
Q["p1_p6_feature_snapshot"] = (
    lambda v: profile.feature_snapshot(v.bars).select("symbol", "date", "volume", "risk_level", *r6(8, **{c: F.col(c) for c in _FCOLS})),
    with_views("bars", _FEATURES + " select symbol, date, volume, risk_level, " + ", ".join(f"round({c}, 8) + 0::double as {c}" for c in _FCOLS) + " from feat"),
)
_PATTERNS = f""", q as (select *, {_RET} as ret, (lead(close_adj, 5) over (partition by symbol order by date) - close_adj) / close_adj * 100 as fwd, {_avg(20)} as ma20, {_avg(5, "volume")} as v5, {_avg(20, "volume")} as v20 from bars),
    z as (select *, (close_adj - ma20) / ma20 * 100 as dev, max(ret) over (partition by symbol order by date rows between 14 preceding and 1 preceding) as top from q),
    y as (select symbol, fwd, close_adj > ma20 and volume > 1.5 * v5 as breakout, low_adj <= ma20 and ma20 <= close_adj as support, dev < -12 and ret >= 3 as rebound, top >= 7 and volume < 0.65 * v20 as dry_up from z where fwd is not null),
    x as (select symbol, p.pattern, fwd, case p.pattern when 'breakout' then breakout when 'support' then support when 'rebound' then rebound else dry_up end as holds from y, (values ('breakout'), ('support'), ('rebound'), ('dry_up')) as p(pattern))"""
Q["p2_pattern_stats"] = (
    lambda v: profile.pattern_stats(v.bars).select("symbol", "pattern", "samples", *r6(win_rate=F.col("win_rate"), avg_return=F.col("avg_return"))),
    with_views("bars", _PATTERNS + " select symbol, pattern, count(*) filter (where holds) as samples, round(coalesce(count(*) filter (where holds and fwd > 0) * 100.0::double / nullif(count(*) filter (where holds), 0), 50), 6) as win_rate, round(coalesce(avg(fwd) filter (where holds), 0), 6) + 0::double as avg_return from x group by 1, 2"),
)
_FORWARD = ", fw as (select symbol, (lead(close_adj, 5) over (partition by symbol order by date) - close_adj) / close_adj * 100 as fwd from bars), fs as (select symbol, count(*) as samples, count(*) filter (where fwd > 0) as wins, avg(fwd) filter (where fwd > 0) as avg_gain, avg(fwd) filter (where fwd < 0) as avg_loss from fw where fwd is not null group by 1)"
Q["p3_forward_stats"] = (
    lambda v: profile.forward_stats(v.bars).select("symbol", "samples", "wins", *r6(avg_gain=F.col("avg_gain"), avg_loss=F.col("avg_loss"))),
    with_views("bars", _FORWARD + " select symbol, samples, wins, round(avg_gain, 6) as avg_gain, round(avg_loss, 6) as avg_loss from fs"),
)


def p4_p5_outlook(v: Views):
    env = market.market_env(market.rise_fall(market.market_temperature(v.bars, warmup_days=WARM)))
    out = profile.advice(profile.outlook(profile.forward_stats(v.bars), profile.feature_snapshot(v.bars), env))
    return out.select("symbol", "advice", *r6(win_rate=F.col("win_rate"), expected_return=F.col("expected_return"), risk_reward=F.col("risk_reward")))


_TEMPERATURE = _RECENT + f""", rr as (select *, {_RET} as ret from recent), rt as (select ret from rr where date = (select max(date) from bars) and ret is not null),
    env as (select round(round(coalesce(count(*) filter (where ret > 0) * 100.0::double / nullif(count(*) filter (where ret <> 0), 0), 50), 6), 1) as temperature from rt)"""
_OUTLOOK = _TEMPERATURE + _FEATURES + _FORWARD + """,
    w0 as (select feat.symbol, coalesce(samples, 0) > 100 as enough, coalesce(avg_gain, 2.5) as g, abs(coalesce(avg_loss, -2.0)) as ls, round(round(dev_ma20, 6), 2) as dev_ma20, round(round(vol_ratio_5, 6), 2) as vol_ratio_5,
            round(round(wins * 100.0::double / samples, 6), 1) + (round(round(slope_ma20, 6), 2) + round(round(slope_ma30, 6), 2)) / 2 + (temperature - 50) / 10 as moved
        from feat left join fs on fs.symbol = feat.symbol, env),
    w as (select *, case when enough then least(92.0, greatest(18.0, round(round(moved, 6), 1))) else 52.4 end as win_rate from w0),
    o as (select *, case when enough then round(round(win_rate / 100 * g - (1 - win_rate / 100) * ls, 6), 2) else 1.85 end as expected_return,
        case when enough then coalesce(round(round(g / nullif(ls, 0), 6), 2), 1.5) else 1.35 end as risk_reward from w)
    select symbol, case when win_rate >= 62 and risk_reward >= 1.5 then 'accumulate' when win_rate >= 54 and dev_ma20 > 0 then 'hold' when win_rate >= 45 and vol_ratio_5 < 0.7 then 'wait'
        when win_rate < 45 and dev_ma20 < -8 then 'oversold' else 'reduce' end as advice, round(win_rate, 6) as win_rate, round(expected_return, 6) as expected_return, round(risk_reward, 6) as risk_reward from o"""
Q["p4_p5_outlook"] = (p4_p5_outlook, with_views("bars", _OUTLOOK))
_DAYS = "(select symbol, date, close, drift, vol, unnest(list_filter(range(date + 1, date + 22, interval 1 day), lambda x: isodow(x) <= 5)[1:10])::date as day, generate_subscripts(list_filter(range(date + 1, date + 22, interval 1 day), lambda x: isodow(x) <= 5)[1:10], 1) as t from dv)"
Q["p7_p8_price_bands"] = (
    lambda v: profile.price_bands(periods.drift_vol(v.bars)).select("symbol", "day", *r6(**{f"p{q}": F.col(f"p{q}") for q in profile.BAND_QUANTILES})),
    with_views("bars", DRIFT + f" select symbol, day, " + ", ".join(f"round(close * exp((drift - vol * vol / 2) * t + {z!r} * vol * sqrt(t)), 6) as p{q}" for q, z in profile.BAND_QUANTILES.items()) + f" from {_DAYS}"),  # noqa: F541
)
Q["p9_chart_slice"] = (
    lambda v: profile.chart_slice(v.bars).select("symbol", "date", "close", *r6(9, ma20=F.col("ma20"), ma30=F.col("ma30"))),
    with_views("bars", f", q as (select *, {_avg(20)} as a, {_avg(30)} as b, row_number() over (partition by symbol order by date desc) as rn from bars) select symbol, date, close_adj as close, round(a, 9) as ma20, round(b, 9) as ma30 from q where rn <= 90"),
)

# ------------------------------------------------------------- similarity
#: targets: the instruments with numbers divisible by 20, against the windows of all
def _aims(v: Views):
    return similarity.targets(v.bars.where("cast(substring(symbol, 5) as int) % 20 = 0"))


_WINDOWS = """, ok as (select * from bars where close_adj is not null and volume > 0),
    ix as (select symbol, date, close_adj, row_number() over (partition by symbol order by date) - 1 as i, count(*) over (partition by symbol) as n, list(close_adj) over (partition by symbol order by date rows between current row and 49 following) as prices,
        lead(date, 29) over (partition by symbol order by date) as end_date from ok),
    wn as (select symbol as source, i as start_idx, date as start_date, end_date, prices, list_transform(prices[1:30], lambda x: (x - list_min(prices[1:30])) / coalesce(nullif(list_max(prices[1:30]) - list_min(prices[1:30]), 0), 1)) as pattern from ix where i < n - 60)"""
Q["d1_d2_windows"] = (
    lambda v: similarity.windows(v.bars).select("source", "start_idx", "start_date", "end_date", F.element_at("prices", 50).alias("last_price"), *r6(mid=F.element_at("pattern", 15), total=F.aggregate("pattern", F.lit(0.0), lambda s, x: s + x))),
    with_views("bars", _WINDOWS + " select source, start_idx, start_date, end_date, prices[50] as last_price, round(pattern[15], 6) as mid, round(list_sum(pattern), 6) as total from wn"),
)
_NEAR = _WINDOWS + """, tp as (select symbol as target, list(close_adj order by date) as p from (select *, row_number() over (partition by symbol order by date desc) as rn from ok where cast(substr(symbol, 5) as int) % 20 = 0) where rn <= 30 group by 1),
    tg as (select target, p[1] as start_price, list_transform(p, lambda x: (x - list_min(p)) / coalesce(nullif(list_max(p) - list_min(p), 0), 1)) as tpat from tp where len(p) = 30),
    nr as (select *, sqrt(list_sum(list_transform(list_zip(tpat, pattern), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 30) as l2 from tg, wn),
    nk as (select * from (select *, row_number() over (partition by target order by l2, source, start_idx) as l2_rank from nr) where l2_rank <= 150)"""
Q["d3_nearest_l2"] = (
    lambda v: similarity.nearest_l2(_aims(v), v.bars).select("target", "source", "start_idx", "l2_rank", F.round("l2", 6).alias("l2"), F.element_at("prices", 50).alias("last_price")),
    with_views("bars", _NEAR + " select target, source, start_idx, l2_rank, round(l2, 6) as l2, prices[50] as last_price from nk"),
)


def _recursive(sql: str) -> str:
    return "with recursive " + sql.removeprefix("with ")


# time warping by rows of its table: a cell is the cheapest way to enter its row at k and go on to j; then the best five, one after the other
_WARPED = _NEAR + """,
    dp as (select target, source, start_idx, 0 as i, tpat, pattern, [0.0::double] || list_transform(range(1, 31), lambda j: 'infinity'::double) as cells from nk
        union all
        select target, source, start_idx, i + 1, tpat, pattern, list_transform(range(0, 31), lambda j: case when j < greatest(1, i - 3) or j > least(30, i + 5) then 'infinity'::double else
            list_min(list_transform(range(greatest(1, i - 3), j + 1), lambda k: least(cells[k], cells[k + 1]) + list_sum(list_transform(range(k, j + 1), lambda l: abs(tpat[i + 1] - pattern[l]))))) end) from dp where i < 30),
    wp as (select nk.*, cells[31] as dtw, row_number() over (partition by nk.target order by cells[31], nk.source, nk.start_idx) as r from nk join dp on dp.target = nk.target and dp.source = nk.source and dp.start_idx = nk.start_idx and dp.i = 30),
    gr as (select target, 0 as r, []::struct(s varchar, i bigint)[] as taken from tg
        union all
        select gr.target, gr.r + 1, case when len(taken) < 5 and not list_bool_or(list_transform(taken, lambda x: x.s = wp.source and 50 - abs(x.i - wp.start_idx) > 10) || [false]) then list_append(taken, {'s': wp.source, 'i': wp.start_idx}) else taken end
        from gr join wp on wp.target = gr.target and wp.r = gr.r + 1),
    pk as (select target, unnest(taken) as t, generate_subscripts(taken, 1) as match from (select target, arg_max(taken, r) as taken from gr group by 1)),
    mt as (select wp.*, pk.match, (prices[50] - prices[30]) / prices[30] * 100 as sample_return, greatest(50.0, least(99.5, 100 * (1 - dtw / 4.5))) as similarity from pk join wp on wp.target = pk.target and wp.source = pk.t.s and wp.start_idx = pk.t.i)"""
Q["d4_d7_similar_patterns"] = (
    lambda v: similarity.similar_patterns(v.bars, _aims(v)).select("target", "source", "start_idx", "match", *r6(dtw=F.col("dtw"), sample_return=F.col("sample_return"), similarity=F.col("similarity"))),
    _recursive(with_views("bars", _WARPED + " select target, source, start_idx, match, round(dtw, 6) as dtw, round(sample_return, 6) as sample_return, round(similarity, 6) as similarity from mt")),
)
Q["d7_match_summary"] = (
    lambda v: similarity.match_summary(similarity.similar_patterns(v.bars, _aims(v))).select("target", "matches", *r6(win_rate=F.col("win_rate"), avg_return=F.col("avg_return"), max_gain=F.col("max_gain"), max_loss=F.col("max_loss"))),
    _recursive(with_views("bars", _WARPED + " select target, count(*) as matches, round(count(*) filter (where sample_return > 0) * 100.0::double / count(*), 6) as win_rate, round(avg(sample_return), 6) as avg_return, round(max(sample_return), 6) as max_gain, round(min(sample_return), 6) as max_loss from mt group by 1")),
)
Q["d6_align_matches"] = (
    lambda v: similarity.align_matches(similarity.nearest_l2(_aims(v), v.bars, 5).withColumn("dtw", F.col("l2") * 6)).select("target", "source", "start_idx", *r6(sample_return=F.col("sample_return"), similarity=F.col("similarity"), last=F.element_at("aligned", -1))),
    with_views("bars", _NEAR + " select target, source, start_idx, round((prices[50] - prices[30]) / prices[30] * 100, 6) as sample_return, round(greatest(50.0, least(99.5, 100 * (1 - l2 * 6 / 4.5))), 6) as similarity, round(start_price * (prices[50] / prices[1]), 6) as last from nk where l2_rank <= 5"),
)
