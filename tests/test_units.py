"""Edge rules of single operators on rows made by hand."""

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.functions import indicators as I  # noqa: E741
from tapewright.functions import symbols as S
from tapewright.operators import adjust, curves, events, levels, lookup, market, periods, profile, screens, seats, similarity, terms, universe
from tapewright.sources import bars as bar_files
from tapewright.sources import appended, fixed_width, reference, store, sync
from tapewright.sources.shared import shared_path

DAY = dt.date(2020, 1, 6)
BAR = "symbol string, date date, open double, high double, low double, close double, amount double, volume long"


def bars(spark, closes, symbol="sh600000", volumes=None, lows=None, highs=None, step=1):
    rows = [
        (symbol, DAY + dt.timedelta(days=step * k), c, highs[k] if highs else c, lows[k] if lows else c, c, c * 100, volumes[k] if volumes else 100)
        for k, c in enumerate(closes)
    ]
    raw = spark.createDataFrame(rows, BAR)
    return raw.withColumns({"factor": F.lit(1.0), "volume_adj": F.col("volume").cast("double")} | {f"{c}_adj": F.col(c) for c in ("open", "high", "low", "close")})


def action(date, category=1, dividend=0.0, price=0.0, split=0.0, ratio=0.0, symbol="sh600000"):
    return (symbol, date, category, dividend, price, split, ratio)


ACTION = "symbol string, date date, category int, dividend double, allocated_price double, split_ratio double, allocated_ratio double"


def at(k):
    return DAY + dt.timedelta(days=k)


# ----------------------------------------------------------------- adjustment


def test_adjustment_rules(spark):
    raw = bars(spark, [10.0, 11.0, 12.0, 13.0]).select(*[f.split()[0] for f in BAR.split(", ")])
    acts = [action(at(-5), dividend=5.0), action(at(2), dividend=1.0), action(at(2), split=10.0), action(at(1), category=5, dividend=9.0), action(at(9), split=10.0), action(at(3), symbol="sz000001", split=10.0)]
    out = {r.date: r for r in adjust.adjusted_bars(raw, spark.createDataFrame(acts, ACTION)).collect()}
    early = (11 - 0.1) / 11 * 0.5 * 0.5
    assert out[at(0)].factor == pytest.approx(early) and out[at(1)].factor == pytest.approx(early)
    assert out[at(2)].factor == out[at(3)].factor == 0.5
    assert out[at(0)].close_adj == round(10 * early, 2) and out[at(0)].volume_adj == round(100 / early)
    none = adjust.adjusted_bars(raw, spark.createDataFrame([], ACTION))
    assert none.where("factor <> 1 or close_adj <> close").count() == 0 and none.count() == 4
    assert adjust.adjustment_audit(none).first().adjusted_days == 0


def test_event_between_bars_takes_the_close_before(spark):
    raw = bars(spark, [10.0, 20.0], step=10).select(*[f.split()[0] for f in BAR.split(", ")])
    found = adjust.event_factors(raw, spark.createDataFrame([action(at(4), dividend=10.0), action(at(0), dividend=10.0), action(at(5), ratio=-30.0)], ACTION)).collect()
    assert sorted((r.date, r.factor) for r in found) == [(at(4), 0.9), (at(5), 1.0)]


# ------------------------------------------------------------------- symbols


def test_codes_boards_and_categories(spark):
    raw = spark.createDataFrame([("0000001",), ("1600000",), ("600000",), ("900901",), ("300750",), ("200011",), ("430047",), ("999999",), ("1688",)], "raw string")
    got = {r.raw: (r.c.market, r.c.code) for r in raw.select("raw", S.normalize_code(F.col("raw")).alias("c")).collect()}
    assert got == {"0000001": ("sz", "000001"), "1600000": ("sh", "600000"), "600000": ("sh", "600000"), "900901": ("sh", "900901"), "300750": ("sz", "300750"), "200011": ("sz", "200011"), "430047": ("bj", "430047"), "999999": ("unknown", "999999"), "1688": ("unknown", "1688")}
    ids = spark.createDataFrame([(s,) for s in ("sh600000", "sh688001", "sh000001", "sz399001", "sh880001", "sh510300", "sz128001", "bj430047")], "symbol string")
    pick = lambda *c: {r.symbol for r in universe.by_category(ids, list(c)).collect()}
    assert pick() == pick("stock") == pick("nonsense") == {"sh600000", "sh688001", "bj430047"}
    assert pick("index", "bond") == {"sh000001", "sz399001", "sz128001"} and pick("fund") == {"sh510300"} and pick("sector") == {"sh880001"}
    assert ids.select(S.clean_name(F.lit("xdName"))).first()[0] == "Name"


def test_categories_are_disjoint():
    every = [(c, p) for c, ps in S.CATEGORY_PREFIXES.items() for p in ps]
    assert not [(a, b) for a, b in itertools.permutations(every, 2) if a[0] != b[0] and a[1].startswith(b[1])]


# ---------------------------------------------------------------- indicators


def test_windows_partial_and_full(spark):
    df = bars(spark, [1.0, 2.0, 3.0, 4.0]).withColumns({"a": I.sma("close", 3), "b": I.sma_full("close", 3), "t": I.trailing_max("close", 2, 1), "f": I.forward_return(1), "s": F.lit(0)}).orderBy("date").collect()
    assert [r.a for r in df] == [1.0, 1.5, 2.0, 3.0] and [r.b for r in df] == [None, None, 2.0, 3.0]
    assert [r.t for r in df] == [None, 1.0, 2.0, 3.0] and df[0].f == 100.0 and df[3].f is None
    zero = bars(spark, [0.0, 1.0], volumes=[0, 0]).withColumns({"r": I.pct_return("close"), "v": I.vol_ratio(5)}).orderBy("date").collect()
    assert zero[1].r is None and [z.v for z in zero] == [1.0, 1.0]


def test_regime_presets(spark):
    index = bars(spark, [1.0, 2.0, 3.0, 2.9], "sh000001")
    flag = lambda p, **k: [r.ok for r in periods.regime(index, 2, 1, p, **k).orderBy("date").collect()]
    assert flag("resonance") == [True, True, True, False] and flag("pullback") == [True, True, False, True]
    assert flag("reversal") == [True, True, False, False] and flag("custom") == [True] * 4 and flag("custom", slope="down") == [True, True, False, False]


# -------------------------------------------------------------------- market


def test_temperature_edges_and_sums(spark):
    moves = [-20.0, -9.9, -7.0, -5.0, -3.0, -1.0, 0.0, 1.0, 3.0, 5.0, 7.0, 9.9, 12.0]
    df = None
    for k, m in enumerate(moves):
        one = bars(spark, [1000.0, 1000.0 + 10 * m], f"sh60{k:04d}")
        df = one if df is None else df.unionByName(one)
    row = market.rise_fall(market.market_temperature(df)).first()
    assert [row[b] for b in market.BINS] == [1, 2, 1, 1, 1, 1, 1, 1, 2, 1]
    assert row.rising + row.falling + row.flat_count == row.total_stocks == len(moves) and row.median_return == 0.0


def test_limit_up_streaks(spark):
    a = bars(spark, [10.0, 11.0, 12.1, 13.31], "sh600001")
    b = bars(spark, [10.0, 12.0, 12.0, 14.4], "sz300001")
    c = bars(spark, [10.0, 11.0, 12.1], "sh600002")
    got = {r.symbol: r.streak for r in market.limit_up_streaks(a.unionByName(b).unionByName(c)).collect()}
    assert got == {"sh600001": 3, "sz300001": 1}


def test_volume_profile_edges(spark):
    rows = market.volume_profile(bars(spark, [0.0, 1.0, 5.0, 10.0, 10.0], "sh000001")).orderBy("bucket").collect()
    assert [(r.bucket, r.days) for r in rows] == [(1, 1), (2, 1), (6, 1), (10, 2)]
    assert [(r.bucket, r.days) for r in market.volume_profile(bars(spark, [3.0, 3.0], "sh000001")).collect()] == [(1, 2)]


# ------------------------------------------------------------------- screens


def test_screens_and_catalogue(spark):
    a = spark.createDataFrame([("x", 1.0, 2.0, "A, B"), ("y", 1.0, 2.0, "")], "symbol string, Close double, Vol_Ratio double, R string")
    b = spark.createDataFrame([("x", 5.0, 3.0, "B, C")], "symbol string, Close double, Vol_Ratio double, R string")
    both = screens.merge_sectors(screens.intersect(a, b, b), ["R", "R_other"])
    assert both.columns == ["symbol", "Close", "Vol_Ratio", "R", "Close_other", "Vol_Ratio_other", "R_other", "Close_other2", "Vol_Ratio_other2", "R_other2", "Sectors"]
    assert both.collect()[0].Sectors == "A, B, C" and screens.intersect(a, b.where("1 = 0")).count() == 0
    with pytest.raises(ValueError, match="Vol_Ratio"):
        screens.validate_screen(a.drop("Vol_Ratio"))
    own = screens.default_catalogue()
    own.register("k", "n", "d", "select symbol from bars where symbol = :s")
    assert own.run(spark, "k", {"bars": a}, s="y").collect()[0].symbol == "y"
    assert "k" in {r.key for r in own.list_strategies(spark).collect()}
    a.limit(1).createOrReplaceTempView("bars")
    assert own.run(spark, "k", {"bars": a}, s="y").count() == 1 and spark.table("bars").count() == 1
    spark.catalog.dropTempView("bars")


def test_rebalance_dates(spark):
    cal = spark.createDataFrame([(at(k),) for k in (2, 3, 7, 8, 14)], "date date")
    assert sorted(r.date for r in screens.rebalance_dates(cal, "2020-01-07", "2020-01-31").collect()) == [at(2), at(7), at(14)]
    assert screens.rebalance_dates(cal, "2020-01-07", "2020-01-31", "daily").count() == 5


# ----------------------------------------------------------------- event study


SIGNAL = "symbol string, date date, signal_month date, close double, close_adj double, factor double, limit_up_rank int"


def signal(k, close, rank=1):
    return ("sh600000", at(k), dt.date(2020, 1, 1), close, close, 1.0, rank)


def test_fill_rules(spark):
    df = bars(spark, [10.0, 11.0, 12.0, 13.0, 12.5], lows=[10.0, 10.5, 11.5, 12.2, 12.0], highs=[10.0, 11.0, 12.0, 13.5, 13.0])
    fills = lambda rows, **k: events.match_fills(spark.createDataFrame(rows, SIGNAL), df, **k).collect()
    first = fills([signal(1, 11.6)])
    assert [(r.buy_type, r.buy_date, r.buy_idx, r.buy_price_adj) for r in first] == [("first", at(2), 2, 11.6)]
    second = fills([signal(1, 11.0), signal(2, 12.5, 2)])
    assert [(r.buy_type, r.buy_date) for r in second] == [("second", at(3))]
    assert not fills([signal(1, 11.0), signal(2, 13.6, 2)]) and not fills([signal(4, 12.5)]) and not fills([signal(2, 12.5, 2)])
    assert not fills([signal(1, 11.0), signal(2, 12.5, 2)], max_gap=0) and not fills([signal(1, 13.0)]) and len(fills([signal(1, 13.0)], strict_band=False)) == 1


TRADE = "symbol string, signal_month date, buy_date date, buy_idx int, buy_price double, buy_price_adj double, buy_factor double"


def trade(k, price=10.0):
    return ("sh600000", dt.date(2020, 1, 1), at(k), k, price, price, 1.0)


def test_outcomes_stop_and_drawdown(spark):
    df = bars(spark, [10.0, 9.5, 12.0, 11.0], lows=[10.0, 9.0, 11.0, 10.5])
    t = spark.createDataFrame([trade(0)], TRADE)
    marked = {r.horizon: r for r in events.outcomes(t, df, (1, 2, 9)).collect()}
    assert (marked[1].ret, marked[1].completed) == (pytest.approx(-0.05), True) and (marked[9].ret, marked[9].completed, marked[9].exit_date) == (pytest.approx(0.1), False, at(3))
    assert {r.horizon: r.ret for r in events.outcomes(t, df, (9,), "null").collect()} == {9: None}
    assert {r.horizon: round(r.dd, 6) for r in events.holding_drawdown(t, df, (1, 3)).collect()} == {1: -0.1, 3: -0.1}
    stopped = {r.horizon: (round(r.ret, 6), r.exit_date, r.stopped) for r in events.apply_stop_loss(t, df, 10.0, (2, 3, 9)).collect()}
    assert stopped == {2: (-0.1, at(1), True), 3: (-0.1, at(1), True)}
    assert not events.apply_stop_loss(t, df, 11.0, (2,)).first().stopped


def test_levels_find_what_a_scan_finds(spark):
    rng = random.Random(5)
    lows = {f"s{k}": [rng.choice([None, float("nan")]) if rng.random() < 0.05 else float(rng.randrange(40)) for _ in range(n)] for k, n in enumerate((1, 2, 7, 8, 9, 100))}
    own = spark.createDataFrame([(s, i, x) for s, xs in lows.items() for i, x in enumerate(xs)], "_s string, bar_idx long, _low double")
    asks = [(s, rng.randrange(len(xs) + 2), float(rng.randrange(-1, 30))) for s, xs in lows.items() for _ in range(25)]
    trades = spark.createDataFrame([(k, *a) for k, a in enumerate(asks)], "id int, symbol string, buy_idx long, _stop double")
    for first, last in ((0, 0), (0, 7), (1, 5), (0, 20), (1, 300)):
        held = lambda s, i, reach: [(k, x) for k, x in enumerate(lows[s]) if i + first <= k <= i + reach and x is not None and x == x]  # noqa: B023, E731
        for horizon in {last, (first + last) // 2}:
            got = levels.met(trades, own, "_low", first, last).groupBy("id").agg(F.min(levels.first_hit("_stop", first, last)).alias("hit"), F.min(levels.lowest(horizon, first, last)).alias("low"))
            found = {r.id: ((r.hit.bar_idx if r.hit and r.hit.bar_idx <= asks[r.id][1] + horizon else None), None if r.low is None or r.low != r.low else r.low) for r in got.collect()}
            for k, (s, i, stop) in enumerate(asks):
                inside = held(s, i, horizon)
                wanted = (next((at for at, x in inside if x <= stop), None), min((x for _, x in inside), default=None))
                assert found.get(k, (None, None)) == wanted, (first, last, horizon, asks[k])


def test_a_sweep_equals_its_combinations_one_by_one(spark):
    rng = random.Random(11)
    frames, day = [], dt.date(2019, 1, 1)
    for n in range(12):
        price, rows = 100.0, []
        for k in range(500):
            price = round(price * (1.1 if rng.random() < 0.06 else rng.uniform(0.985, 1.01)), 2)
            rows.append((f"sh6000{n:02d}", day + dt.timedelta(days=k * 3), price, price, round(price * 1.02, 2), round(price * 0.97, 2), 1.0, 1000, float(rng.randrange(1, 9)) * rng.choice([1.0, 6.0])))
        frames += rows
    df = spark.createDataFrame(frames, "symbol string, date date, close double, close_adj double, high_adj double, low_adj double, factor double, volume long, amount double").cache()
    grid = [(k, r, u, w) for k, (r, u, w) in enumerate([(1.0, 1.1, 0.5), (1.5, 1.1, 0.9), (1.0, 0.9, 0.9), (2.5, 1.3, 0.1), (99.0, 1.3, 0.1), (1.0, 1.3, 0.1), (None, 1.3, 0.1)])]
    got = {r.param_id: r for r in events.sweep(df, spark.createDataFrame(grid, "param_id int, vol_ratio double, upper double, lower double"), horizon=10).collect()}
    assert sorted(got) == list(range(7)) and got[6].trades == got[4].trades == 0 and got[4].avg_ret is None
    seen = set()
    for k, ratio, upper, lower in grid[:6]:
        near = universe.price_position(events.abnormal_volume_signals(df, ratio), upper, lower)
        results = events.size_and_pl(events.outcomes(events.match_fills(near, df), df, (10,), incomplete="null")).collect()
        done = [r for r in results if r.completed]
        assert (got[k].trades, got[k].valid) == (len(results), len(done))
        if done:
            assert abs(got[k].avg_ret - sum(r.ret for r in done) / len(done) * 100) < 1e-9 and abs(got[k].win_rate - sum(r.ret > 0 for r in done) / len(done) * 100) < 1e-9
            assert abs(got[k].total_pl - sum(r.pl for r in done)) < 1e-4
        seen.add(len(results))
    assert len(seen) > 3
    assert events.sweep(df, spark.createDataFrame([], "param_id int, vol_ratio double, upper double, lower double")).count() == 0


def test_exit_priority(spark):
    exits = lambda closes, **k: [(r.reason, r.held) for r in events.evaluate_exits(spark.createDataFrame([trade(0)], TRADE), bars(spark, closes), **k).collect()]
    assert exits([10.0, 9.0]) == [("stop", 1)] and exits([10.0, 12.0, 11.0]) == [("trail", 2)] and exits([10.0, 9.9]) == [("average", 1)]
    assert exits([10.0] * 12) == [("time", 10)] and exits([10.0, 10.0]) == [] and exits([10.0, 9.9, 10.5], ma_exit=False, max_days=2) == [("time", 2)]


def test_caps_costs_and_sizes(spark):
    caps = spark.createDataFrame([(x,) for x in (0.0, 20e8, 49.9e8, 50e8, 1000e8, 2e12)], "cap double").select("cap", events.cap_class(F.col("cap")).alias("c"), events.cap_bin(F.col("cap")).alias("b")).collect()
    assert [r.c for r in caps] == ["<50", "<50", "<50", "50-200", ">=1000", ">=1000"] and [r.b for r in caps] == [None, "(0,20]", "(20,50]", "(20,50]", "(300,10000]", None]
    shares = spark.createDataFrame([("sh600000", at(0), 100.0), ("sh600000", at(5), -1.0)], "symbol string, date date, allocated_ratio double")
    t = spark.createDataFrame([trade(2), trade(7)], TRADE)
    assert sorted(r.float_market_cap for r in events.float_market_cap(t, shares).collect()) == [1e7, 3e9]
    sized = events.size_and_pl(t.withColumn("exit_price_adj", F.lit(11.0)), capital=1.0).first()
    assert (sized.shares, sized.spend, sized.pl) == (100, 1000.0, 100.0)
    assert events.net_of_costs(t.withColumn("exit_price", F.lit(10.0)), 0, 0, 0).first().net_pct == 0.0


def test_curves(spark):
    flat = spark.createDataFrame([(at(k), 5.0) for k in range(4)], "date date, total_value double")
    row = curves.curve_metrics(flat).first()
    assert (row.total_return, row.sharpe, row.calmar, row.max_drawdown) == (0.0, 0.0, 0.0, 0.0)
    assert curves.trade_ratios(spark.createDataFrame([(1.0,)], "pnl double")).first().profit_loss_ratio == 99.0
    assert tuple(curves.trade_ratios(spark.createDataFrame([], "pnl double")).first()) == (0, 0.0, 0.0)


# ----------------------------------------------------------- profile, patterns


def test_business_days_and_bands(spark):
    friday = spark.createDataFrame([("s", dt.date(2020, 1, 3), 10.0, 0.0, 0.0)], "symbol string, date date, close double, drift double, vol double")
    rows = profile.price_bands(friday, 6).collect()
    assert [r.day.isoweekday() for r in rows] == [1, 2, 3, 4, 5, 1] and all(r.p5 == r.p95 == 10.0 for r in rows)


def test_losses_leave_out_returns_of_zero(spark):
    row = profile.forward_stats(bars(spark, [100.0, 100.0, 90.0, 90.0, 99.0]), 1).first()
    assert (row.samples, row.wins, row.avg_gain, row.avg_loss) == (4, 1, pytest.approx(10.0), pytest.approx(-10.0))


def test_drift_takes_sixty_returns(spark):
    row = periods.drift_vol(bars(spark, [50.0] + [100.0] * 60)).first()
    assert row.drift == pytest.approx(1 / 60) and row.vol > 0
    flat = periods.drift_vol(bars(spark, [5.0] * 70)).first()
    assert (flat.drift, flat.vol) == (0.0, 0.02)
    one = periods.drift_vol(bars(spark, [5.0])).first()
    assert (one.drift, one.vol) == (0.0005, 0.02)


def test_outlook_rounds_before_its_thresholds(spark):
    stats = spark.createDataFrame([("s", 1000, 619, 3.0, -2.0)], "symbol string, samples long, wins long, avg_gain double, avg_loss double")
    features = spark.createDataFrame([("s", 0.04, 0.05, 1.0, 1.0)], "symbol string, slope_ma20 double, slope_ma30 double, dev_ma20 double, vol_ratio_5 double")
    env = spark.createDataFrame([(50.04,)], "temperature_index double")
    row = profile.advice(profile.outlook(stats, features, env)).first()
    # 61.9 + 0.045 becomes 61.9; 50.04 counts as 50.0
    assert (row.win_rate, row.risk_reward, row.expected_return, row.advice) == (61.9, 1.5, 1.1, "hold")
    up = profile.advice(profile.outlook(stats.withColumn("wins", F.lit(620)), features, env)).first()
    assert (up.win_rate, up.advice) == (62.0, "accumulate")


def test_price_position_passes_only_without_history(spark):
    rows = [("a", 120.0, 0.0, 100.0), ("b", 0.0, 1.0, 100.0), ("c", 120.0, 80.0, 100.0), ("d", 140.0, 80.0, 100.0)]
    signals = spark.createDataFrame(rows, "symbol string, hist_max_high_adj double, hist_min_low_adj double, close_adj double")
    assert {r.symbol for r in universe.price_position(signals).collect()} == {"b", "c"}


def test_trends_are_of_unadjusted_closes(spark):
    df = bars(spark, [10.0] * 39 + [11.0]).withColumn("close_adj", F.lit(5.0) - F.datediff("date", F.lit(DAY)) / 1000)
    rated = {r.date: r for r in periods.daily_ma_slope(df).collect()}
    assert rated[at(39)].ma_day == pytest.approx(10 + 1 / 30) and rated[at(39)].ma_day_slope > 0
    one = spark.createDataFrame([("sh600000", at(39))], "symbol string, date date")
    assert events.confirm_trend(one, df).count() == 1 and events.confirm_trend(one, df, col="close_adj").count() == 0


def direct_dtw(a, b, band):
    n, m = len(a), len(b)
    band = max(band, abs(n - m))
    t = np.full((n + 1, m + 1), np.inf)
    t[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if abs(i - j) <= band:
                t[i, j] = abs(a[i - 1] - b[j - 1]) + min(t[i - 1, j], t[i, j - 1], t[i - 1, j - 1])
    return t[n, m]


def test_time_warping_matches_the_plain_table():
    rng = np.random.default_rng(1)
    for n, m in ((30, 30), (5, 5), (7, 4), (1, 1)):
        a, b = rng.random((20, n)), rng.random((20, m))
        assert np.allclose(similarity.dtw_distances(a, b), [direct_dtw(x, y, 4) for x, y in zip(a, b, strict=True)])


def test_windows_and_overlaps(spark):
    assert similarity.windows(bars(spark, [float(k % 7) for k in range(61)])).count() == 1
    assert similarity.windows(bars(spark, [1.0] * 60)).count() == 0
    assert similarity.windows(bars(spark, [1.0] * 62, volumes=[0, *[100] * 61])).count() == 1
    rows = [("t", s, i, d) for s, i, d in (("a", 0, 1.0), ("a", 39, 2.0), ("a", 40, 3.0), ("b", 5, 4.0), ("b", 6, 5.0))]
    got = similarity.non_overlapping(spark.createDataFrame(rows, "target string, source string, start_idx int, dtw double"), 3)
    assert sorted((r.match, r.source, r.start_idx) for r in got.collect()) == [(1, "a", 0), (2, "a", 40), (3, "b", 5)]


@pytest.mark.parametrize("scope", ["all", "own"])
def test_nearest_windows_match_brute_force(spark, scope):
    rng = np.random.default_rng(4)
    series = {f"sh60000{k}": (100 + rng.normal(size=70 + 5 * k).cumsum()).round(2).tolist() for k in range(4)} | {"sh000001": (3000 + rng.normal(size=80).cumsum()).round(2).tolist()}
    frames = [bars(spark, closes, s) for s, closes in series.items()]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    aims = similarity.targets(df.where("symbol in ('sh600001', 'sh600003')"))
    scale = lambda x: (x - x.min()) / (np.ptp(x) or 1.0)
    wanted = {}
    for t in ("sh600001", "sh600003"):
        last = scale(np.array(series[t][-30:]))
        pool = [(s, i) for s, closes in series.items() for i in range(len(closes) - 60) if scope == "all" or s in (t, "sh000001")]
        far = sorted((np.sqrt(((scale(np.array(series[s][i : i + 30])) - last) ** 2).mean()), s, i) for s, i in pool)
        wanted |= {(t, s, i): (n + 1, round(d, 9)) for n, (d, s, i) in enumerate(far[:7])}
    for at_once in (20_000, 1):
        found = similarity.nearest_l2(aims, df, 7, scope, at_once=at_once).collect()
        assert {(r.target, r.source, r.start_idx): (r.l2_rank, round(r.l2, 9)) for r in found} == wanted
        assert all(r.prices == series[r.source][r.start_idx : r.start_idx + 50] for r in found)


# --------------------------------------------------------------- lookups, seats


def test_search_by_initials(spark):
    names = spark.createDataFrame([("sh600001", "Alpha Beta", "abc", "xbc"), ("sz000002", "Gamma", "g", None)], "symbol string, name string, initials string, initials_alt string")
    hit = lambda q: [r.symbol for r in lookup.search_instruments(names, q).collect()]
    assert hit("ab") == hit("abcd") == hit("xb") == hit("600") == hit("SH6") == hit("beta") == ["SH600001"] and hit("abcde") == hit("gg") == hit("") == []


def test_seats(spark):
    schema = "TRADE_DATE date, SECURITY_CODE string, SECUCODE string, OPERATEDEPT_NAME string, BUY double, SELL double, NET double, EXPLANATION string"
    rows = [(DAY, "000001", None, "d1", None, 2e6, -2e6, None), (DAY, "600001", "600001.SH", "d1", 6e6, None, 6e6, "r"), (at(1), "600001", "600001.SH", "d1", 1e6, None, 1e6, "r"), (DAY, "600001", "600001.SH", None, 1e6, None, 1e6, "r"), (DAY, None, None, "d2", 1.0, 1.0, 9e9, "r")]
    flat = seats.normalize_seats(spark.createDataFrame(rows, schema))
    assert {r.symbol for r in flat.collect()} == {"sz000001", "sh600001"} and flat.count() == 4
    nodes, edges = seats.seat_graph(flat, spark.createDataFrame([], "dept string, nickname string"))
    assert {r.id for r in nodes.collect()} == {"600001", "d1"} and [(r.net, r.width) for r in edges.collect()] == [(6e6, 3.0)]


# ------------------------------------------------------------------- sources


def test_fixed_width_files(spark, tmp_path):
    import pandas as pd

    good = fixed_width.encode_bars(pd.DataFrame({"date": [DAY, at(1)], "open": [1.25, 2.0], "high": [1.5, 2.0], "low": [1.0, 2.0], "close": [1.3, 2.0], "amount": [5.5, 6.0], "volume": [7, 8]}))
    bad = np.zeros(1, fixed_width.BAR_RECORD)
    bad["date"] = 20201341
    (tmp_path / "sh600000.day").write_bytes(good + bad.tobytes() + b"tail")
    rows = fixed_width.read_fixed_width(spark, f"{tmp_path}/*.day", fixed_width.BARS_LAYOUT).orderBy("date").collect()
    assert [(r.symbol, r.date, r.open, r.amount, r.volume) for r in rows] == [("sh600000", DAY, 1.25, 5.5, 7), ("sh600000", at(1), 2.0, 6.0, 8)]
    (tmp_path / "shm.tnf").write_bytes(fixed_width.encode_names([("600000", "浦发银行"), ("6000", "short"), ("600001", "")]))
    assert {(r.symbol, r.name) for r in fixed_width.read_fixed_width(spark, f"{tmp_path}/*.tnf", fixed_width.NAMES_LAYOUT).collect()} == {("sh600000", "浦发银行"), ("sh600001", "")}
    (tmp_path / "b.dat").write_bytes(fixed_width.encode_blocks([("通信", 2, ["0000001", "1600000"]), ("", 1, ["0000001"])]))
    assert {tuple(r) for r in fixed_width.read_fixed_width(spark, f"{tmp_path}/*.dat", fixed_width.BLOCKS_LAYOUT).collect()} == {("通信", 2, "0000001"), ("通信", 2, "1600000")}


def test_ranges_split_large_files_and_join_small_ones():
    found = appended.ranges({"a": 3, "c": 5}, {"a": 10, "b": 2, "c": 5, "d": 1}, 4)
    assert [r.parts for r in found] == [[("a", 3, 7)], [("a", 7, 10), ("b", 0, 1)], [("b", 1, 2), ("d", 0, 1)]]
    assert appended.ranges({}, {}, 4) == []
    with pytest.raises(ValueError, match="fewer records"):
        appended.ranges({"a": 3}, {"a": 2}, 4)


def test_a_grown_file_is_read_from_its_old_end(spark, tmp_path):
    rows = lambda symbol, days: pd.DataFrame([(symbol, at(k), 1.0 + k, 1.0 + k, 1.0 + k, 1.0 + k, 10.0, 5) for k in days], columns=[c.split()[0] for c in BAR.split(", ")])
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "sh600000.day").write_bytes(fixed_width.encode_bars(rows("", range(7))))
    (folder / "sz000001.day").write_bytes(fixed_width.encode_bars(rows("", range(2))) + b"half a record")
    (folder / "notes.txt").write_bytes(b"x" * 99)
    source = f"file://{folder}"
    appended.register(spark)
    read = spark.read.format("bar_files").option("records", "3").load(source)
    assert read.rdd.getNumPartitions() == 3 and sorted((r.symbol, r.record, r.close) for r in read.collect()) == [("sh600000", k, 1.0 + k) for k in range(7)] + [("sz000001", k, 1.0 + k) for k in range(2)]

    table, raw = f"followed_{tmp_path.name}".replace("-", "_"), f"file://{tmp_path}/raw"
    store.write_store(spark.createDataFrame([], f"{BAR}, factor double, open_adj double, high_adj double, low_adj double, close_adj double, volume_adj double"), table, 2, f"file://{tmp_path}/store")
    actions = spark.createDataFrame([action(at(8), split=10.0)], ACTION)
    run = lambda: appended.follow(spark, source, raw, actions, table, f"file://{tmp_path}/offsets").awaitTermination(120)
    run()
    # what was read is spoilt, so that reading it again would show
    with open(folder / "sh600000.day", "r+b") as file:
        file.write(b"\xff" * 32 * 7)
        file.write(fixed_width.encode_bars(rows("", range(7, 10))))
        file.write(fixed_width.encode_bars(rows("", [9]).assign(close=20.0)))  # a day that comes again
    run()
    run()  # nothing new
    batches = {b: spark.read.parquet(f"{raw}/batch={b}") for b in (0, 1)}
    assert [(b, sorted((r.symbol, r.record) for r in df.collect())) for b, df in batches.items()][1] == (1, [("sh600000", k) for k in range(7, 11)])
    kept = {(r.symbol, r.date): (r.close, r.close_adj) for r in store.load_store(spark, table).collect()}
    assert len(kept) == 12 and kept["sh600000", at(0)] == (1.0, 0.5) and kept["sh600000", at(9)] == (20.0, 20.0) and kept["sz000001", at(1)] == (2.0, 2.0)
    spark.sql(f"drop table {table}")


def test_a_strategy_becomes_a_table_function(spark):
    own = screens.Catalogue()
    own.register("above", "Above", "", "select symbol, close from bars where close > :close and symbol like :like and volume::double > 0")
    own.register("coded", "Coded", "", lambda bars: bars)
    table, path = new_store(spark, "store")
    store.write_store(bars(spark, [1.0, 2.0, 3.0]), table, 1, path)
    before = {t.name for t in spark.catalog.listTables()}
    name = own.as_table_function(spark, "above", {"close": "double", "like": "string"}, "symbol string, price double", {"bars": store.current_sql(table)})
    assert sorted(r.price for r in spark.sql(f"select price from {name}(1.5, 'sh%')").collect()) == [2.0, 3.0]
    assert spark.sql(f"select * from {name}(like => 'sz%', close => 0.0)").count() == 0
    assert {t.name for t in spark.catalog.listTables()} == before
    with pytest.raises(ValueError):
        own.as_table_function(spark, "coded", {}, "symbol string", {})


def test_terms_find_what_a_scan_finds(spark):
    rng = random.Random(8)
    names = [(k, "".join(rng.choices("abAé ", k=rng.randint(0, 7)))) for k in range(60)] + [(60, None), (60, "ab"), (60, "ab")]
    asked = ["".join(rng.choices("abBÉ ", k=n)) for n in (1, 1, 2, 2, 3, 3, 4, 4, 5, 6)] + ["zz", "abz", "", None, "aba", "aba"]
    df = spark.createDataFrame(names, "key long, text string")
    found = terms.search_terms(spark.createDataFrame([(t,) for t in asked], "term string"), terms.postings(df)).collect()
    wanted = {(t, k, x) for t in asked if t for k, x in names if x is not None and t.lower() in x.lower()}
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted
    assert terms.search_terms(spark.createDataFrame([("a",)], "term string"), terms.postings(df.limit(0))).count() == 0


def test_bounds_prune_and_lose_no_window():
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.normal(size=30_000)) + 500
    walk[200:300] = 7.0  # flat windows, many ties
    rows = similarity.scaled_windows(walk, 30, 29_000)
    patterns = rows[[5, 210, 700, 12_000]]
    search = similarity._Search(patterns, 20)
    for a in range(0, len(rows), 4000):
        search.add(rows[a : a + 4000], np.arange(len(rows))[a : a + 4000], np.arange(4))
    for pattern, best in zip(patterns, search.best, strict=True):
        every = np.sqrt(((rows - pattern) ** 2).mean(1))
        distance, at = best.cut()
        assert set(np.flatnonzero(every <= np.sort(every)[19] * (1 - 1e-12)).tolist()) <= set(at.tolist())
        assert np.allclose(np.sort(distance)[:20], np.sort(every)[:20]) and np.allclose(every[at], distance)
    assert search.met == 4 * len(rows) and search.measured < 0.2 * search.met
    for size in (1, 4, 7, 30):
        a, b = rng.random((50, size)), rng.random((50, size))
        assert (np.sqrt(((similarity.part_means(a) - similarity.part_means(b)) ** 2).sum(1)) <= np.sqrt(((a - b) ** 2).mean(1)) + 1e-12).all()


def test_bars_by_file(spark):
    path = shared_path(spark, "by-file")
    for s in ("sh600000", "sz000001"):
        bars(spark, [1.0, 2.0], s).drop("symbol").write.parquet(f"{path}/{s}.parquet")
    assert {(r.symbol, r["count"]) for r in bar_files.load_bars_by_file(spark, path).groupBy("symbol").count().collect()} == {("sh600000", 2), ("sz000001", 2)}


def new_store(spark, name):
    path = shared_path(spark, name)
    return path.rsplit("/", 1)[-1].replace("-", "_"), path


def test_one_instrument_is_replaced_and_all_others_stay(spark):
    table, path = new_store(spark, "store")
    every = [f"sh6{k:05d}" for k in range(40)]
    full = spark.range(40 * 3).selectExpr("concat('sh6', lpad(cast(id div 3 as string), 5, '0')) as symbol", "date_add(date'2020-12-30', cast(id % 3 as int)) as date", "cast(id as double) as close", "100L as volume")
    store.write_store(full, table, 4, path)
    counts = lambda: {r.symbol: r["count"] for r in store.load_store(spark, table).groupBy("symbol").count().collect()}
    assert counts() == dict.fromkeys(every, 3)
    new = spark.createDataFrame([("sh600007", dt.date(1999, 1, 4), 7.5, 1), ("sh699999", dt.date(1999, 1, 4), 1.0, 1)], "symbol string, date date, close double, volume long")
    store.replace_instruments(new.withColumn("close", F.lit(-1.0)), table)
    before = store.load_store(spark, table)  # a reader keeps what it has planned
    store.replace_instruments(new, table)
    assert counts() == dict.fromkeys(every, 3) | {"sh600007": 1, "sh699999": 1} and before.count() == 39 * 3 + 2
    rest = store.load_store(spark, table).where("symbol not in ('sh600007', 'sh699999')")
    assert rest.exceptAll(full.where("symbol <> 'sh600007'")).count() == 0 and rest.count() == 39 * 3
    store.replace_instruments(new.where("1 = 0"), table)
    assert sum(counts().values()) == 39 * 3 + 2
    assert [r.close for r in store.load_symbol(spark, table, "sh600007", ["close"]).collect()] == [7.5]
    assert spark.sql(f"select * from {store.current_sql(table)}").exceptAll(store.load_store(spark, table)).count() == 0
    assert spark.sql(f"select count(*) as n from {store.current_sql(table)}").first().n == 39 * 3 + 2
    small, small_path = new_store(spark, "small-store")
    store.compact(spark, table, small, small_path)
    assert spark.table(small).count() == 39 * 3 + 2 and store.load_store(spark, small).columns == full.columns


def test_a_writer_lost_before_its_note_changes_nothing(spark):
    table, path = new_store(spark, "store")
    full = bars(spark, [1.0, 2.0], "sh600000").unionByName(bars(spark, [3.0], "sz000001"))
    store.write_store(full, table, 2, path)
    store._write(bars(spark, [9.0], "sh600000").withColumn(store.VERSION, F.lit(5)), table, 2, "append", None)
    store.replace_instruments(bars(spark, [4.0], "sz000001"), table)
    found = sorted((r.symbol, r.close) for r in store.load_store(spark, table).where("symbol = 'sz000001'").collect())
    assert found == [("sz000001", 4.0)]


def test_windows_and_joins_over_a_store_need_no_exchange(spark, capsys):
    table, path = new_store(spark, "store")
    store.write_store(bars(spark, [1.0, 2.0, 3.0], "sh600000").unionByName(bars(spark, [3.0], "sz000001")), table, 3, path)
    stored = store.load_store(spark, table)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        I.with_means(stored, "close_adj", {"ma5": 5}).join(events.indexed(stored).select("symbol", "date", "bar_idx").hint("merge"), ["symbol", "date"]).explain()
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    said = capsys.readouterr().out
    assert "Window" in said and "Join" in said and "Exchange" not in said
    assert store.buckets_for(10, 8) == 8 and store.buckets_for(10**9, 8) == 10**9 * store.BAR_BYTES // store.BUCKET_BYTES + 1


def test_means_and_extremes_equal_those_of_sliding_windows(spark):
    rng = random.Random(5)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=k), None if rng.random() < 0.1 else round(rng.random() * 50, 2)) for s in "ab" for k in range(70)] + [("c", dt.date(2020, 1, 1), None)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double")
    lengths = (1, 2, 3, 4, 7, 8, 30, 64, 65)
    got = I.with_means(df, "x", {f"m{n}": n for n in lengths})
    got = I.with_means(got, "x", {f"f{n}": n for n in lengths}, full=True)
    got = I.with_extremes(got, {f"h{n}": ("x", n) for n in lengths}, {f"l{n}": ("x", n) for n in lengths})
    wanted = df.withColumns({f"m{n}": I.sma("x", n) for n in lengths} | {f"f{n}": I.sma_full("x", n) for n in lengths} | {f"h{n}": I.rolling_max("x", n) for n in lengths} | {f"l{n}": I.rolling_min("x", n) for n in lengths})
    assert got.columns == wanted.columns
    cut = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    key = lambda row: (row[0], row[1])
    assert list(map(cut, sorted(got.collect(), key=key))) == list(map(cut, sorted(wanted.collect(), key=key)))


def test_screens_of_a_date_read_its_days_only(spark, capsys):
    table, path = new_store(spark, "long-store")
    store.write_store(bars(spark, [10.0 + k % 9 for k in range(900)]), table, 2, path)
    stored = store.load_store(spark, table)
    market.latest_flags(stored, mas=(5, 10), warmup_days=60).explain("formatted")
    said = capsys.readouterr().out
    first, last = at(899 - 60), at(899)
    assert f"GreaterThanOrEqual(date,{first})" in said and f"LessThanOrEqual(date,{last})" in said
    row = market.latest_flags(stored, mas=(5, 10), warmup_days=60).first()
    assert tuple(row) == tuple(market.latest_flags(stored, mas=(5, 10), warmup_days=2000).first())
    assert market.market_temperature(stored.where("1 = 0")).first().total_stocks == 0


def test_reference_files_and_sync(spark, tmp_path):
    (tmp_path / "d.txt").write_text("x\n#A\nT01|one\n\n#B\nT01|two\n")
    section = reference.read_section(reference.read_lines(spark, str(tmp_path / "d.txt")), "A")
    assert [r.value for r in section.collect()] == ["T01|one"]
    raw = spark.createDataFrame([("1", "20200106"), ("1", "20200231"), ("0", "2020010"), ("0", "20191231")], "code string, date string")
    assert [(r.code, r.date) for r in reference.clean_actions(raw).collect()] == [("0", dt.date(2019, 12, 31)), ("1", DAY)]
    t0, t1 = dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)
    sources = spark.createDataFrame([("a", t1), ("b", t0), ("c", t0)], "path string, mtime timestamp")
    manifest = spark.createDataFrame([("a", t0), ("b", t0)], "path string, mtime timestamp")
    assert {r.path for r in sync.changed_sources(sources, manifest).collect()} == {"a", "c"}
    assert sync.list_sources(spark, f"{tmp_path}/*.txt").count() == 1


# ----------------------------------------------------------------- streaming


def test_radar_screens_running_bars(spark, tmp_path):
    from tapewright.streaming import radar

    ticks = [(dt.datetime(2020, 3, 1, 10, k), f"sh60000{s}", 10.0 + k, 500) for s in range(3) for k in range(2)]
    spark.createDataFrame(ticks, "ts timestamp, symbol string, price double, volume long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, symbol string, price double, volume long").parquet(str(tmp_path / "in"))
    history = None
    for s in range(3):
        one = bars(spark, [5.0] * 5, f"sh60000{s}")
        history = one if history is None else history.unionByName(one)
    blocks = spark.createDataFrame([("B", 1, "concept", f"60000{s}", "sh") for s in range(3)], "block_name string, block_type_id int, block_category string, code string, market string")
    seen = []
    query = radar.start_radar(radar.running_bars(stream), history, blocks, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"), alert=3)
    query.awaitTermination(120)
    assert {(r.symbol, r.Close, r.Resonance_Sectors) for r in seen} == {(f"sh60000{s}", 11.0, "B(3/100.0%)") for s in range(3)}


def test_radar_merges_batches_and_leaves_late_ticks_out(spark, tmp_path):
    from tapewright.streaming import radar

    schema = "ts timestamp, symbol string, price double, volume long"
    history = bars(spark, [5.0] * 5, "sh600000").unionByName(bars(spark, [5.0] * 5, "sh600001"))
    blocks = spark.createDataFrame([("B", 1, "concept", f"60000{s}", "sh") for s in range(2)], "block_name string, block_type_id int, block_category string, code string, market string")
    seen = {}
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    batches = [
        [(dt.datetime(2020, 3, 1, 10), "sh600000", 10.0, 500)],
        [(dt.datetime(2020, 3, 1, 11), "sh600001", 12.0, 500)],  # the other one's bar comes from the batch before
        [(dt.datetime(2020, 3, 3, 9), "sh600000", 20.0, 500), (dt.datetime(2020, 3, 3, 9), "sh600001", 20.0, 500)],
        [(dt.datetime(2020, 3, 1, 12), "sh600000", 99.0, 500), (dt.datetime(2020, 3, 3, 10), "sh600000", 21.0, 1)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = radar.start_radar(radar.running_bars(stream), history, blocks, lambda df, n: seen.setdefault(n, []).extend(df.collect()), str(tmp_path / "cp"), alert=2)
        query.awaitTermination(120)
        assert k < len(seen)
    last = {r.symbol: r.Close for r in seen[max(seen)]}
    assert any({r.symbol for r in rows} == {"sh600000", "sh600001"} for rows in seen.values()) and last == {"sh600000": 21.0, "sh600001": 20.0}
    kept = spark.read.parquet(f"{tmp_path}/cp/bars/{max(seen) % 2}")
    assert kept.where("high = 99").count() == 0


def test_bars_on_arrival_go_on_from_their_state(spark, tmp_path):
    from tapewright.streaming import arrivals

    schema = "symbol string, date date, close double, close_adj double"
    closes = {"sh600000": [10.0, 11.0, 12.1, 12.0, 13.2, 13.2, 14.52], "bj430001": [1.0, 2.0, 4.0], "sz300001": [10.0, 11.5, 13.8]}
    rows = {s: [(s, at(k), c, c / 2) for k, c in enumerate(xs)] for s, xs in closes.items()}
    first = [rows["sh600000"][2], rows["sh600000"][0], rows["sh600000"][1], rows["bj430001"][0]]
    later = [rows["sh600000"][1], *rows["sh600000"][3:], *rows["bj430001"][1:], *rows["sz300001"], rows["sz300001"][2]]  # one is old, one comes twice
    running = lambda: arrivals.on_arrival(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), (2, 3))
    spark.createDataFrame(first, schema).write.parquet(f"{tmp_path}/in/part=0")
    for part in (first, later):
        if part is later:
            spark.createDataFrame(later, schema).write.parquet(f"{tmp_path}/in/part=1")
        assert running().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(60)
        found = {(r.symbol, r.date): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        if part is first:
            assert len(found) == 4
    assert len(found) == sum(map(len, closes.values())) == spark.read.parquet(f"{tmp_path}/out").count()
    for s, xs in closes.items():
        assert [found[s, at(k)].ma3 for k in range(len(xs))] == pytest.approx([sum(xs[max(0, k - 2) : k + 1]) / min(k + 1, 3) / 2 for k in range(len(xs))])
        assert [found[s, at(k)].ret for k in range(len(xs))] == [None, *(pytest.approx((b - a) / a * 100) for a, b in itertools.pairwise(xs))]
    assert [found["sh600000", at(k)].streak for k in range(7)] == [0, 1, 2, 0, 1, 0, 1]
    assert [found["bj430001", at(2)].streak, found["sz300001", at(1)].streak, found["sz300001", at(2)].streak] == [0, 0, 1]


def test_an_instrument_without_bars_for_long_is_forgotten(spark, tmp_path):
    from tapewright.streaming import arrivals

    schema = "symbol string, date date, close double, close_adj double"
    parts = [[("sh600000", at(0), 10.0, 10.0), ("sh600001", at(0), 10.0, 10.0)], [("sh600001", at(30), 20.0, 20.0)], [("sh600000", at(31), 30.0, 30.0), ("sh600001", at(31), 40.0, 40.0)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/part={k}")
        stream = arrivals.on_arrival(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), (2,), idle_days=10)
        assert stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(60)
    last = {r.symbol: (r.ma2, r.ret) for r in spark.read.parquet(f"{tmp_path}/out").where(F.col("date") == at(31)).collect()}
    assert last == {"sh600000": (30.0, None), "sh600001": (30.0, 100.0)}


def test_blocks_and_names_spread_over_files(spark, monkeypatch, tmp_path):
    from tapewright.plans import sources_universe
    from tapewright.sources import fixed_width

    codes = [f"1{k:06d}" for k in range(1001)]
    assert [len(x) for x in (fixed_width._blocks("x", fixed_width.encode_blocks([("large", 2, codes), ("small", 3, codes[:400]), ("none", 4, [])])),)] == [1401]
    monkeypatch.setattr(sources_universe, "FILE_ROWS", 300)
    monkeypatch.setattr(sources_universe, "shared_path", lambda _, name: f"file://{tmp_path}/{name}")
    blocks = [("Brand#11", 1, "concept", f"{k:06d}", "sh") for k in range(1001)] + [("Brand#12", 2, "concept", f"{k:06d}", "sz") for k in range(5)] + [("Brand#13", 3, "style", "000001", "sz")]
    names = [(f"sh{k:06d}", f"name {k}") for k in range(700)] + [("sz000001", "one")]

    class V:
        pass

    v = V()
    v.spark = spark
    v.blocks = spark.createDataFrame(blocks, "block_name string, block_type_id int, block_category string, code string, market string")
    v.names = spark.createDataFrame(names, "symbol string, name string")
    found = sorted(map(tuple, sources_universe.i6_block_files(v).collect()))
    assert found == sorted((b, t, {"sh": "1", "sz": "0"}[m] + c) for b, t, k, c, m in blocks if k == "concept")
    assert sorted(map(tuple, sources_universe.i5_name_files(v).collect())) == sorted(names)
    assert len(list((tmp_path / "block-files").glob("*.dat"))) == 5 and len(list((tmp_path / "name-files").glob("*.tnf"))) == 4
