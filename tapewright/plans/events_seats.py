"""Queries over the event study (B), curves and the seat graph (G), with their SQL.

The fixture's bars are weekly, so horizons are 4, 8, 12 and 24 bars.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, events, periods, seats, universe
from .fixtures import Views, with_views
from .indicators_market import _FLAGS, _avg, _mean, r6

Q: dict[str, tuple] = {}
H = (4, 8, 12, 24)
_HS = "(values (4), (8), (12), (24)) as hz(horizon)"

_MONTHLY = """, m as (select symbol, cast(date_trunc('month', date) as date) as month, sum(cast(amount as decimal(18,2)))::double as amount, max(high_adj) as hi, min(low_adj) as lo from bars group by 1, 2),
    mr as (select *, amount / nullif(lag(amount) over (partition by symbol order by month), 0) as ratio, coalesce(max(hi) over f, 0) as mx, coalesce(min(lo) over f, 0) as mn from m
        window f as (partition by symbol order by month rows between 12 preceding and 1 preceding)),
    ma as (select *, coalesce(sum(case when ratio >= 3 then 1 else 0 end) over (partition by symbol order by month rows between 12 preceding and 1 preceding), 0)::bigint as cnt from mr)"""
_SIGNALS = _FLAGS + _MONTHLY + """, u as (select symbol, date, cast(date_trunc('month', date) as date) as signal_month, close, close_adj, factor, ret, first, row_number() over (partition by symbol, date_trunc('month', date) order by date) as rk
        from (select fl.*, f0.first from fl join (select symbol, min(date) as first from bars group by 1) f0 on f0.symbol = fl.symbol) where up),
    sg as (select u.symbol, u.date, u.signal_month, close, close_adj, factor, ret, rk as limit_up_rank, cnt as abnormal_months_count, mx as hist_max_high_adj, mn as hist_min_low_adj
        from u join ma on ma.symbol = u.symbol and ma.month = u.signal_month where rk <= 2 and date - first >= 390 and cnt >= 2)"""  # fmt: skip
_FILLS = _SIGNALS + """, ib as (select *, row_number() over (partition by symbol order by date) - 1 as i, count(*) over (partition by symbol) as n, lead(low_adj) over w as nl, lead(high_adj) over w as nh, lead(date) over w as nd from bars window w as (partition by symbol order by date)),
    pl as (select sg.*, i, nd, coalesce(nl <= sg.close_adj and nh >= sg.close_adj, false) as fits from sg join ib on ib.symbol = sg.symbol and ib.date = sg.date),
    tr as (select a.symbol, a.signal_month, a.date as signal_date, case when a.fits then a.nd else b.nd end as buy_date, case when a.fits then a.i else b.i end + 1 as buy_idx, case when a.fits then a.close else b.close end as buy_price,
            case when a.fits then a.close_adj else b.close_adj end as buy_price_adj, case when a.fits then a.factor else b.factor end as buy_factor, case when a.fits then 'first' else 'second' end as buy_type
        from pl a left join pl b on b.symbol = a.symbol and b.signal_month = a.signal_month and b.limit_up_rank = 2
        where a.limit_up_rank = 1 and a.nd is not null and (a.fits or coalesce(b.fits and b.nd is not null and b.i - a.i <= 10 and (b.close_adj - a.close_adj) / a.close_adj <= 0.2, false)))"""
_OUTCOMES = _FILLS + f""", oc as (select tr.*, horizon, x.i is not null as completed, coalesce(x.date, l.date) as exit_date, coalesce(x.close_adj, l.close_adj) as exit_price_adj
        from tr cross join {_HS} left join ib x on x.symbol = tr.symbol and x.i = tr.buy_idx + horizon join ib l on l.symbol = tr.symbol and l.i = l.n - 1),
    ou as (select *, (exit_price_adj - buy_price_adj) / buy_price_adj as ret from oc)"""


def _signals(v: Views):
    return events.abnormal_volume_signals(v.bars)


def _trades(v: Views):
    """The trades of all signals, written once a session; b3_match_fills makes them."""
    return v.kept("trades", lambda: events.match_fills(_signals(v), v.numbered))


Q["b1_limit_up_flag"] = (lambda v: events.limit_up_flag(v.bars).select("symbol", "date", "limit_up", *r6(ret=F.col("ret"))), with_views("bars", _FLAGS + " select symbol, date, up as limit_up, round(ret, 6) + 0::double as ret from fl"))
Q["b2_f12_signals"] = (
    lambda v: universe.signal_range(_signals(v), "1996-01-01", "2000-12-31").select("symbol", "date", "close", "limit_up_rank", "abnormal_months_count", "hist_max_high_adj", "hist_min_low_adj"),
    with_views("bars", _SIGNALS + " select symbol, date, close, limit_up_rank, abnormal_months_count, hist_max_high_adj, hist_min_low_adj from sg where date between date '1996-01-01' and date '2000-12-31'"),
)
Q["f8_price_position"] = (
    lambda v: universe.price_position(_signals(v), 1.15, 0.85).select("symbol", "date"),
    with_views("bars", _SIGNALS + " select symbol, date from sg where hist_max_high_adj = 0 or (hist_max_high_adj <= close_adj * 1.15 and hist_min_low_adj >= close_adj * 0.85)"),
)
_TR = "symbol, signal_month, signal_date, buy_date, buy_idx, buy_price, buy_price_adj, buy_type"
Q["b3_match_fills"] = (lambda v: events.match_fills(_signals(v), v.numbered).select(*_TR.split(", ")), with_views("bars", _FILLS + f" select {_TR} from tr"))
Q["b4_b6_outcomes"] = (
    lambda v: events.outcomes(_trades(v), v.numbered, H).select("symbol", "signal_month", "horizon", "exit_date", "completed", *r6(ret=F.col("ret"))),
    with_views("bars", _OUTCOMES + " select symbol, signal_month, horizon, exit_date, completed, round(ret, 6) + 0::double as ret from ou"),
)
Q["b6_outcomes_null"] = (
    lambda v: events.outcomes(_trades(v), v.numbered, H, "null").select("symbol", "signal_month", "horizon", "exit_date", "completed", *r6(ret=F.col("ret"))),
    with_views("bars", _OUTCOMES + " select symbol, signal_month, horizon, case when completed then exit_date end as exit_date, completed, case when completed then round(ret, 6) + 0::double end as ret from ou"),
)
_DD = _FILLS + f", dd as (select tr.symbol, tr.signal_month, horizon, min(low_adj) / any_value(buy_price_adj) - 1 as dd from tr cross join {_HS} join ib on ib.symbol = tr.symbol and ib.i between buy_idx + 1 and buy_idx + horizon group by 1, 2, 3)"
Q["b5_holding_drawdown"] = (
    lambda v: events.holding_drawdown(_trades(v), v.numbered, H).where("dd is not null").select("symbol", "signal_month", "horizon", *r6(dd=F.col("dd"))),
    with_views("bars", _DD + " select symbol, signal_month, horizon, round(dd, 6) + 0::double as dd from dd"),
)


def _measured(v: Views):
    """Outcomes with drawdown, benchmark, market cap, industry, shares and money."""
    results = events.outcomes(_trades(v), v.numbered, H)
    dd = events.holding_drawdown(_trades(v), v.numbered, H).select(F.col("symbol").alias("_s"), F.col("signal_month").alias("_m"), F.col("horizon").alias("_h"), "dd")
    joined = results.join(dd, (F.col("symbol") == F.col("_s")) & (F.col("signal_month") == F.col("_m")) & (F.col("horizon") == F.col("_h")), "left").drop("_s", "_m", "_h")
    own = v.industries.select(F.col("symbol").alias("_i"), F.col("industry_name").alias("industry"))
    with_industry = events.with_benchmark(joined, v.index_bars).join(own, F.col("symbol") == F.col("_i"), "left").drop("_i")
    return events.size_and_pl(events.float_market_cap(with_industry, v.share_events))


#: the last share record on or before the buy date, of several that day the largest
_CAP = "(select case when arg_max(e.allocated_ratio, row(e.date, e.allocated_ratio)) > 0 then arg_max(e.allocated_ratio, row(e.date, e.allocated_ratio)) * 10000.0 * {0}.buy_price end from share_events e where e.symbol = {0}.symbol and e.date <= {0}.buy_date)"
_MEASURED = _OUTCOMES + f""", ddx as (select tr.symbol, tr.signal_month, horizon, min(low_adj) / any_value(buy_price_adj) - 1 as dd from tr cross join {_HS} join ib on ib.symbol = tr.symbol and ib.i between buy_idx + 1 and buy_idx + horizon group by 1, 2, 3),
    mc as (select ou.*, dd, industry_name as industry, coalesce((x2.close - x1.close) / x1.close, 0) as idx_ret, ou.ret - coalesce((x2.close - x1.close) / x1.close, 0) as alpha,
        {_CAP.format("ou")} as cap0,
        greatest(floor(100000.0 / buy_price / 100) * 100, 100)::bigint as shares
      from ou left join ddx on ddx.symbol = ou.symbol and ddx.signal_month = ou.signal_month and ddx.horizon = ou.horizon left join industries ii on ii.symbol = ou.symbol
      left join index_bars x1 on x1.date = ou.buy_date left join index_bars x2 on x2.date = ou.exit_date),
    me as (select *, coalesce(cap0, 3e9) as float_market_cap, shares * buy_price as spend, shares * (exit_price_adj - buy_price_adj) / buy_factor as pl from mc)"""
_NEED = "bars index_bars industries share_events"
_KEY = ["symbol", "signal_month", "horizon"]
Q["b7_with_benchmark"] = (
    lambda v: events.with_benchmark(events.outcomes(_trades(v), v.numbered, H), v.index_bars).select(*_KEY, *r6(idx_ret=F.col("idx_ret"), alpha=F.col("alpha"))),
    with_views("bars index_bars", _OUTCOMES + """, be as (select ou.*, coalesce((x2.close - x1.close) / x1.close, 0) as idx_ret from ou left join index_bars x1 on x1.date = ou.buy_date left join index_bars x2 on x2.date = ou.exit_date)
        select symbol, signal_month, horizon, round(idx_ret, 6) + 0::double as idx_ret, round(ret - idx_ret, 6) + 0::double as alpha from be"""),
)
_CLASS = "case when float_market_cap < 50e8 then '<50' when float_market_cap < 200e8 then '50-200' when float_market_cap < 500e8 then '200-500' when float_market_cap < 1000e8 then '500-1000' else '>=1000' end"
_BIN = "case when float_market_cap <= 0 then null when float_market_cap <= 20e8 then '(0,20]' when float_market_cap <= 50e8 then '(20,50]' when float_market_cap <= 100e8 then '(50,100]' when float_market_cap <= 300e8 then '(100,300]' when float_market_cap <= 1e12 then '(300,10000]' end"
Q["b8_b10_market_cap"] = (
    lambda v: events.float_market_cap(_trades(v), v.share_events).select("symbol", "signal_month", F.round("float_market_cap", 2).alias("float_market_cap"), events.cap_class(F.col("float_market_cap")).alias("cap_class"), events.cap_bin(F.col("float_market_cap")).alias("cap_bin")),
    with_views("bars share_events", _FILLS + f", me as (select tr.symbol, tr.signal_month, coalesce({_CAP.format('tr')}, 3e9) as float_market_cap from tr) select symbol, signal_month, round(float_market_cap, 2) as float_market_cap, {_CLASS} as cap_class, {_BIN} as cap_bin from me"),
)
_TREND = "".join(
    f""", c{u} as (select symbol, date_trunc('{u}', date) as p, arg_max(close, date) as c from bars group by 1, 2), a{u} as (select symbol, p, case when row_number() over (partition by symbol order by p) >= 30 then {_mean(30, 'c', 100, 'p')} end as ma from c{u})"""
    for u in ("week", "month")
) + f", dy as (select *, case when row_number() over (partition by symbol order by date) >= 30 then {_avg(30, 'close')} end as ma from bars), ds as (select *, ma - lag(ma) over (partition by symbol order by date) as slope from dy)"
Q["b11_confirm_trend"] = (
    lambda v: events.confirm_trend(_signals(v), v.bars, True, True, True, True).select("symbol", "date"),
    with_views("bars", _SIGNALS + _TREND + """ select sg.symbol, sg.date from sg join ds on ds.symbol = sg.symbol and ds.date = sg.date left join aweek w on w.symbol = sg.symbol and w.p = date_trunc('week', sg.date)
        left join amonth o on o.symbol = sg.symbol and o.p = date_trunc('month', sg.date) where coalesce(slope > 0, true) and coalesce(round(ds.close, 2) > ds.ma, true) and coalesce(round(ds.close, 2) > w.ma, true) and coalesce(round(ds.close, 2) > o.ma, true)"""),
)
_REGIME = ", rm as (select date, close, case when row_number() over (order by date) >= 60 then avg(close) over (order by date rows 59 preceding) end as ma from index_bars), rp as (select *, lag(ma, 5) over (order by date) as b from rm), rg as (select date, case when ma is null or b is null then true else ma > b and close > ma end as ok from rp)"


def _bypass(v: Views):
    return events.regime_bypass(_trades(v), periods.regime(v.index_bars, 60, 5, "resonance"))


Q["b12_regime_kept"] = (lambda v: _bypass(v)[0].select("symbol", "signal_month"), with_views("bars index_bars", _FILLS + _REGIME + " select symbol, signal_month from tr left join rg on rg.date = signal_date where coalesce(ok, true)"))
Q["b12_regime_stats"] = (
    lambda v: _bypass(v)[1].withColumn("bypass_ratio", F.round("bypass_ratio", 6)),
    with_views("bars index_bars", _FILLS + _REGIME + " select count(*) as signals, count(*) filter (where coalesce(ok, true)) as executed, count(*) filter (where not coalesce(ok, true)) as bypassed, round(coalesce(count(*) filter (where not coalesce(ok, true)) * 100.0::double / nullif(count(*), 0), 0), 6) as bypass_ratio from tr left join rg on rg.date = signal_date"),
)
Q["b13_stop_loss"] = (
    lambda v: events.apply_stop_loss(_trades(v), v.numbered, 8.0, H).select(*_KEY, "exit_date", "stopped", *r6(ret=F.col("ret"), exit_price_adj=F.col("exit_price_adj"))),
    with_views("bars", _OUTCOMES + """, sp as (select ou.*, (select min(i) from ib where ib.symbol = ou.symbol and ib.i between buy_idx and buy_idx + horizon and low_adj <= buy_price_adj * (1 - 8.0::double / 100)) as si from ou where completed)
        select sp.symbol, signal_month, horizon, case when si is not null then ib.date else exit_date end as exit_date, si is not null as stopped, round(case when si is not null then -0.08 else ret end, 6) + 0::double as ret,
            round(case when si is not null then buy_price_adj * 0.92 else exit_price_adj end, 6) as exit_price_adj from sp left join ib on ib.symbol = sp.symbol and ib.i = si"""),
)
Q["b14_size_and_pl"] = (
    lambda v: _measured(v).select(*_KEY, "shares", *r6(4, spend=F.col("spend"), pl=F.col("pl"))),
    with_views(_NEED, _MEASURED + " select symbol, signal_month, horizon, shares, round(spend, 4) as spend, round(pl, 4) + 0::double as pl from me"),
)
_SUMS = "count(*) as trades, count(*) filter (where completed) as valid, round(avg(ret) filter (where completed) * 100, 6) as avg_ret, round(count(*) filter (where completed and ret > 0) * 100.0::double / nullif(count(*) filter (where completed), 0), 6) as win_rate, round(sum(pl) filter (where completed), 4) as total_pl"
_ROUNDED = lambda: [*r6(avg_ret=F.col("avg_ret"), win_rate=F.col("win_rate")), *r6(4, total_pl=F.col("total_pl"))]
Q["b15_monthly_summary"] = (
    lambda v: events.monthly_summary(_measured(v)).select("signal_month", "horizon", "trades", "valid", *_ROUNDED()),
    with_views(_NEED, _MEASURED + f" select signal_month, horizon, {_SUMS} from me group by 1, 2"),
)
Q["b16_monthly_cap_summary"] = (
    lambda v: events.monthly_cap_summary(_measured(v)).select("signal_month", "horizon", "cap_class", "trades", "valid", *_ROUNDED()),
    with_views(_NEED, _MEASURED + f""", sm as (select signal_month, horizon, {_CLASS} as cap_class, {_SUMS} from me group by 1, 2, 3), grid as (select signal_month, horizon, cap_class from (select distinct signal_month, horizon from me), (values ('<50'), ('50-200'), ('200-500'), ('500-1000'), ('>=1000')) as c(cap_class))
        select grid.signal_month, grid.horizon, grid.cap_class, coalesce(trades, 0) as trades, coalesce(valid, 0) as valid, avg_ret, win_rate, total_pl from grid left join sm using (signal_month, horizon, cap_class)"""),
)
_STATS = "count(*) as trades, round(avg(ret), 6) + 0::double as avg_ret, round(count(*) filter (where ret > 0)::double / count(*), 6) as win_rate, round(avg(dd), 6) + 0::double as avg_dd, round(avg(idx_ret), 6) + 0::double as avg_idx_ret, round(avg(alpha), 6) + 0::double as avg_alpha"
_STAT = ["avg_ret", "win_rate", "avg_dd", "avg_idx_ret", "avg_alpha"]
Q["b17_holding_stats"] = (
    lambda v: events.holding_stats(_measured(v)).select("horizon", "trades", *r6(**{c: F.col(c) for c in [*_STAT, "annualized"]})),
    with_views(_NEED, _MEASURED + f" select horizon, {_STATS}, round(pow(1 + avg(ret), 250.0 / horizon) - 1, 6) as annualized from me group by 1"),
)


def b18_stratify(v: Views):
    measured = _measured(v)
    state = events.market_state(v.index_bars, 60).select(F.col("date").alias("_d"), "state")
    by_state = measured.join(state, F.col("signal_date") == F.col("_d"), "left")
    parts = [
        events.stratify(measured, events.cap_bin(F.col("float_market_cap")), "part").withColumn("kind", F.lit("cap")),
        events.stratify(by_state, F.coalesce("state", F.lit("bear")), "part").withColumn("kind", F.lit("state")),
        events.stratify(measured, F.year("buy_date").cast("string"), "part").withColumn("kind", F.lit("year")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("kind", "part", "horizon", "trades", *r6(**{c: F.col(c) for c in _STAT}))


Q["b18_stratify"] = (
    b18_stratify,
    with_views(_NEED, _MEASURED + f""", sx as (select date, case when row_number() over (order by date) >= 60 and close > avg(close) over (order by date rows 59 preceding) then 'bull' else 'bear' end as state from index_bars),
        al as (select 'cap' as kind, {_BIN} as part, * from me union all select 'state', coalesce(state, 'bear'), me.* from me left join sx on sx.date = me.signal_date union all select 'year', year(buy_date)::varchar, * from me)
        select kind, part, horizon, {_STATS} from al group by 1, 2, 3"""),
)
Q["b19_top_industries"] = (
    lambda v: events.top_industries(_measured(v).where("horizon = 8")).select("industry", "trades", *r6(avg_ret=F.col("avg_ret"), win_rate=F.col("win_rate"))),
    with_views(_NEED, _MEASURED + " select industry, count(*) as trades, round(avg(ret), 6) + 0::double as avg_ret, round(count(*) filter (where ret > 0)::double / count(*), 6) as win_rate from me where horizon = 8 group by 1 order by trades desc, industry limit 10"),
)
_EXITS = _FILLS + f""", m20 as (select symbol, date, {_avg(20)} as ma20 from bars),
    hb as (select tr.symbol, tr.signal_month, tr.buy_price_adj, ib.i - buy_idx as held, ib.date, ib.close_adj, ma20, greatest(buy_price_adj, max(ib.close_adj) over (partition by tr.symbol, tr.signal_month order by ib.i rows unbounded preceding)) as peak
        from tr join ib on ib.symbol = tr.symbol and ib.i between buy_idx + 1 and buy_idx + 10 join m20 on m20.symbol = ib.symbol and m20.date = ib.date where ib.volume > 0),
    rs as (select *, case when close_adj < buy_price_adj * (1 - 8.0::double / 100) then 'stop' when close_adj < peak * (1 - 6.0::double / 100) then 'trail' when close_adj < ma20 then 'average' when held >= 10 then 'time' end as reason from hb),
    ex as (select symbol, signal_month, any_value(buy_price_adj) as buy_price_adj, min(held) as held, arg_min(date, held) as exit_date, arg_min(close_adj, held) as exit_price, arg_min(reason, held) as reason from rs where reason is not null group by 1, 2)"""
Q["b20_evaluate_exits"] = (
    lambda v: events.evaluate_exits(_trades(v), v.numbered).select("symbol", "signal_month", "exit_date", "exit_price", "reason", "held"),
    with_views("bars", _EXITS + " select symbol, signal_month, exit_date, exit_price, reason, held from ex"),
)
Q["b21_net_of_costs"] = (
    lambda v: events.net_of_costs(events.evaluate_exits(_trades(v), v.numbered)).select("symbol", "signal_month", *r6(net_pct=F.col("net_pct"))),
    with_views("bars", _EXITS + " select symbol, signal_month, round((exit_price * (1 - 0.1::double / 100) * (1 - (0.03::double + 0.1::double) / 100) / (buy_price_adj * (1 + 0.1::double / 100) * (1 + 0.03::double / 100)) - 1) * 100, 6) as net_pct from ex"),
)


def _exposed(v: Views):
    """Trades with their exits, industries and concept blocks."""
    closed = events.evaluate_exits(_trades(v), v.numbered).select("symbol", "buy_date", "exit_date")
    own = v.industries.select(F.col("symbol").alias("_i"), F.col("industry_name").alias("industry")).distinct()
    concepts = v.blocks.where("block_category = 'concept'").groupBy(F.concat("market", "code").alias("_c")).agg(F.collect_set("block_name").alias("concepts"))
    return closed.join(own, F.col("symbol") == F.col("_i"), "left").join(concepts, F.col("symbol") == F.col("_c"), "left").select("symbol", "buy_date", "exit_date", "industry", "concepts")


Q["b22_exposure"] = (
    lambda v: events.exposure(_exposed(v)).select("symbol", "buy_date", "same_industry", "same_concept", "days_since_exit"),
    with_views("bars industries blocks", _EXITS + """, te as (select tr.symbol, tr.buy_date, ex.exit_date, industry_name as industry from ex join tr on tr.symbol = ex.symbol and tr.signal_month = ex.signal_month left join (select distinct symbol, industry_name from industries) i on i.symbol = tr.symbol),
        cb as (select distinct market || code as symbol, block_name from blocks where block_category = 'concept'), tc as (select distinct te.symbol, te.buy_date, te.exit_date, block_name from te join cb on cb.symbol = te.symbol),
        cc as (select a.symbol, a.buy_date, a.block_name, count(b.symbol) as n from tc a left join tc b on b.block_name = a.block_name and b.buy_date < a.buy_date and b.exit_date > a.buy_date group by 1, 2, 3),
        cm as (select symbol, buy_date, max(n) as n from cc group by 1, 2)
        select te.symbol, te.buy_date, (select count(*) from te b where b.industry = te.industry and b.buy_date < te.buy_date and b.exit_date > te.buy_date) as same_industry, coalesce(cm.n, 0) as same_concept,
            te.buy_date - max(te.exit_date) over (partition by te.symbol order by te.buy_date range between unbounded preceding and interval 1 day preceding) as days_since_exit from te left join cm on cm.symbol = te.symbol and cm.buy_date = te.buy_date"""),
)


def b23_curve_metrics(v: Views):
    both = [curves.curve_metrics(v.equity_curve, c).withColumn("convention", F.lit(c)) for c in ("242", "250")]
    out = both[0].unionByName(both[1])
    return out.select("convention", *r6(**{c: F.col(c) for c in ("total_return", "annualized", "max_drawdown", "sharpe", "calmar")}))


_CURVE = """, cr as (select date, total_value, coalesce(total_value / lag(total_value) over (order by date) - 1, 0) as r, total_value / max(total_value) over (order by date) - 1 as dd from equity_curve),
    cs as (select arg_min(total_value, date) as a, arg_max(total_value, date) as z, count(*) as n, max(date) - min(date) as span, min(dd) as dd, avg(r) as mean, stddev_samp(r) as ss, stddev_pop(r) as sp from cr)"""
Q["b23_curve_metrics"] = (
    b23_curve_metrics,
    with_views("equity_curve", _CURVE + """ select '242' as convention, round(z / a - 1, 6) as total_return, round(pow(z / a, 242.0 / n) - 1, 6) as annualized, round(dd, 6) as max_drawdown, round((mean - 0.02 / 242) / ss * sqrt(242), 6) as sharpe, round((pow(z / a, 242.0 / n) - 1) / abs(dd), 6) as calmar from cs
        union all select '250', round(z / a - 1, 6), round(pow(z / a, 365.0 / span) - 1, 6), round(dd, 6), round((mean - 0.02 / 250) / sp * sqrt(250), 6), round((pow(z / a, 365.0 / span) - 1) / abs(dd), 6) from cs"""),
)
Q["b24_benchmark_nav"] = (lambda v: curves.benchmark_nav(v.index_bars, 100.0).select("date", *r6(nav=F.col("nav"))), with_views("index_bars", "select date, round(close / (select arg_min(close, date) from index_bars) * 100, 6) as nav from index_bars"))
Q["b25_trade_ratios"] = (
    lambda v: curves.trade_ratios(events.net_of_costs(events.evaluate_exits(_trades(v), v.numbered)), "net_pct").select("sells", *r6(win_rate=F.col("win_rate"), profit_loss_ratio=F.col("profit_loss_ratio"))),
    with_views("bars", _EXITS + ", np as (select (exit_price * 0.999 * (1 - 0.0013) / (buy_price_adj * 1.001 * 1.0003) - 1) * 100 as p from ex) select count(*) as sells, round(coalesce(count(*) filter (where p > 0) * 100.0::double / nullif(count(*), 0), 0), 6) as win_rate, case when count(*) = 0 then 0 else round(coalesce(coalesce(avg(p) filter (where p > 0), 0) / avg(-p) filter (where p <= 0), 99), 6) end as profit_loss_ratio from np"),
)
_SWEEP = _FLAGS + _MONTHLY.partition(",\n    ma as")[0] + """,
    ma as (select *, coalesce(sum(case when ratio >= vol_ratio then 1 else 0 end) over (partition by param_id, symbol order by month rows between 12 preceding and 1 preceding), 0)::bigint as cnt from mr, params),
    u as (select symbol, date, cast(date_trunc('month', date) as date) as signal_month, close, close_adj, factor, first, row_number() over (partition by symbol, date_trunc('month', date) order by date) as rk
        from (select fl.*, f0.first from fl join (select symbol, min(date) as first from bars group by 1) f0 on f0.symbol = fl.symbol) where up),
    sg as (select param_id, u.symbol, u.date, u.signal_month, close, close_adj, factor, rk as limit_up_rank from u join ma on ma.symbol = u.symbol and ma.month = u.signal_month where rk <= 2 and date - first >= 390 and cnt >= 2
        and (mx = 0 or (mx <= close_adj * upper and mn >= close_adj * lower))),
    ib as (select *, row_number() over (partition by symbol order by date) - 1 as i, lead(low_adj) over w as nl, lead(high_adj) over w as nh, lead(date) over w as nd from bars window w as (partition by symbol order by date)),
    pl as (select sg.*, i, nd, coalesce(nl <= sg.close_adj and nh >= sg.close_adj, false) as fits from sg join ib on ib.symbol = sg.symbol and ib.date = sg.date),
    tr as (select a.param_id, a.symbol, case when a.fits then a.i else b.i end + 1 as buy_idx, case when a.fits then a.close else b.close end as price, case when a.fits then a.close_adj else b.close_adj end as price_adj, case when a.fits then a.factor else b.factor end as factor
        from pl a left join pl b on b.param_id = a.param_id and b.symbol = a.symbol and b.signal_month = a.signal_month and b.limit_up_rank = 2
        where a.limit_up_rank = 1 and a.nd is not null and (a.fits or coalesce(b.fits and b.nd is not null and b.i - a.i <= 10 and (b.close_adj - a.close_adj) / a.close_adj <= 0.2, false))),
    rs as (select tr.*, x.close_adj / price_adj - 1 as ret, greatest(floor(100000.0 / price / 100) * 100, 100) * (x.close_adj - price_adj) / tr.factor as pl, x.i is not null as done from tr left join ib x on x.symbol = tr.symbol and x.i = buy_idx + 12),
    sw as (select p.param_id, vol_ratio, upper, lower, count(rs.symbol) as trades, count(*) filter (where done) as valid, round(avg(ret) filter (where done) * 100, 6) as avg_ret, round(count(*) filter (where done and ret > 0) * 100.0::double / nullif(count(*) filter (where done), 0), 6) as win_rate, round(sum(pl) filter (where done), 4) as total_pl
        from params p left join rs on rs.param_id = p.param_id group by 1, 2, 3, 4)"""
Q["b26_b27_sweep"] = (
    lambda v: events.rank_sweep(events.sweep(v.bars, v.params, horizon=12)).select("place", "param_id", "vol_ratio", "upper", "lower", "trades", "valid", *_ROUNDED()),
    with_views("bars params", _SWEEP + " select row_number() over (order by valid >= 5 desc, avg_ret desc nulls last, win_rate desc nulls last, param_id) as place, * from sw"),
)
Q["b28_trades_by_date"] = (lambda v: events.trades_by_date(_trades(v)), with_views("bars", _FILLS + " select buy_date, count(*) as trades, string_agg(symbol, ',' order by symbol) as symbols from tr group by 1"))

# ------------------------------------------------------------------ seats
_ROWS = """, nr as (select TRADE_DATE as date, SECURITY_CODE as code, case when contains(coalesce(SECUCODE, ''), '.') then lower(split_part(SECUCODE, '.', 2)) || split_part(SECUCODE, '.', 1) else case when SECURITY_CODE like '0%' or SECURITY_CODE like '3%' then 'sz' else 'sh' end || SECURITY_CODE end as symbol,
    OPERATEDEPT_NAME as dept, coalesce(BUY, 0) as buy, coalesce(SELL, 0) as sell, coalesce(NET, 0) as net, EXPLANATION as reason from seat_trades where coalesce(SECURITY_CODE, '') <> '')"""
_LEAST = 1.2e6
_TOTALS = _ROWS + f""", sk as (select code, sum(abs(net)) as total from nr group by 1 having sum(abs(net)) > {_LEAST}), se as (select dept, sum(abs(net)) as total, sum(net) as net, sum(buy) as buy, sum(sell) as sell from nr group by 1),
    sa as (select se.*, a.nickname from se left join seat_alias a on a.dept = se.dept where se.total > {_LEAST} or a.nickname is not null)"""
Q["g1_normalize_seats"] = (lambda v: seats.normalize_seats(v.seat_trades).drop("reason"), with_views("seat_trades", _ROWS + " select date, code, symbol, dept, buy, sell, net from nr"))
Q["g2_g3_active_seats"] = (
    lambda v: seats.active_seats(seats.seat_totals(seats.normalize_seats(v.seat_trades)), v.seat_alias, _LEAST).select("dept", "nickname", *r6(2, total=F.col("total"), net=F.col("net"), buy=F.col("buy"), sell=F.col("sell"))),
    with_views("seat_trades seat_alias", _TOTALS + " select dept, nickname, round(total, 2) as total, round(net, 2) + 0::double as net, round(buy, 2) as buy, round(sell, 2) as sell from sa"),
)
Q["g2_g3_active_stocks"] = (
    lambda v: seats.active_stocks(seats.stock_totals(seats.normalize_seats(v.seat_trades)), _LEAST).select("code", F.round("total", 2).alias("total")),
    with_views("seat_trades seat_alias", _TOTALS + " select code, round(total, 2) as total from sk"),
)
Q["g4_g8_nodes"] = (
    lambda v: seats.seat_graph(seats.normalize_seats(v.seat_trades), v.seat_alias, _LEAST)[0].select("id", "type", "size", F.round("total", 2).alias("total")),
    with_views("seat_trades seat_alias", _TOTALS + " select code as id, 'stock' as type, 18 + floor(least(22, total / 4e7 * 10))::int as size, round(total, 2) as total from sk union all select dept, 'seat', 12 + floor(least(18, total / 3e7 * 8))::int, round(total, 2) from sa"),
)
Q["g5_g8_edges"] = (
    lambda v: seats.seat_graph(seats.normalize_seats(v.seat_trades), v.seat_alias, _LEAST)[1].select("src", "dst", "net", F.round("width", 9).alias("width")),
    with_views("seat_trades seat_alias", _TOTALS + ", fi as (select *, row_number() over (partition by dept, code order by date, net desc, buy desc, sell desc) as k from nr) select dept as src, code as dst, net, round(greatest(1.0, least(5.0, abs(net) / 2e6)), 9) as width from fi where k = 1 and code in (select code from sk) and dept in (select dept from sa)"),
)
#: three digits of amounts in whole cents over 1e4: halves go away from zero, and the rounding of doubles has no say
_listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit(":"), x["net"].cast("decimal(20,6)").cast("decimal(20,3)").cast("string"))), ",")


def _units(c: str) -> str:
    """A sum in whole cents as units of 1e8 with eight digits, halves away from zero."""
    return f"(round(sum({c}), 2) / 1e8)::decimal(28,10)::decimal(28,8)::double"


def _tops_sql(name: str, key: str, source: str, label: str, order: str) -> str:
    return f", {name} as (select {key}, string_agg({label} || ':' || (net / 1e4)::decimal(20,6)::decimal(20,3)::varchar, ',' order by k) as s from (select *, row_number() over (partition by {key} order by {order}, {label}) as k from {source}) where k <= 3 group by 1)"


Q["g6_stock_summary"] = (
    lambda v: seats.stock_summary(seats.normalize_seats(v.seat_trades), v.seat_alias).select("code", F.round("net_amt", 8).alias("net_amt"), "reason", F.coalesce(_listed("buy_seats"), F.lit("")).alias("buy_seats"), F.coalesce(_listed("sell_seats"), F.lit("")).alias("sell_seats")),
    with_views("seat_trades seat_alias", _ROWS + ", nn as (select nr.*, coalesce(nickname, substr(nr.dept, 1, 8) || '...') as seat from nr left join seat_alias a on a.dept = nr.dept), bs as (select * from nn where net > 0), ss as (select * from nn where net < 0)"
        + _tops_sql("tb", "code", "bs", "seat", "net desc") + _tops_sql("ts", "code", "ss", "seat", "net")
        + ", g as (select code, " + _units("net") + " as net_amt, arg_min(reason, row(date, dept, buy, sell)) as reason from nr group by 1) select g.code, net_amt, coalesce(reason, 'daily move') as reason, coalesce(tb.s, '') as buy_seats, coalesce(ts.s, '') as sell_seats from g left join tb on tb.code = g.code left join ts on ts.code = g.code"),
)
Q["g7_seat_summary"] = (
    lambda v: seats.seat_summary(seats.normalize_seats(v.seat_trades), v.seat_alias, v.names).select("nickname", *r6(8, buy=F.col("buy"), sell=F.col("sell"), net=F.col("net")), _listed("targets").alias("targets")),
    with_views("seat_trades seat_alias names", _ROWS + ", oo as (select nr.*, nickname, coalesce(n.name, code) as stock from nr join seat_alias a on a.dept = nr.dept left join names n on n.symbol = nr.symbol), os as (select nickname, stock, round(sum(net), 2) as net from oo group by 1, 2)"
        + _tops_sql("tt", "nickname", "os", "stock", "abs(net) desc")
        + ", g as (select nickname, " + ", ".join(f"{_units(c)} as {c}" for c in ("buy", "sell", "net")) + " from nr join seat_alias a on a.dept = nr.dept group by 1) select g.nickname, buy, sell, net, tt.s as targets from g join tt on tt.nickname = g.nickname"),
)
