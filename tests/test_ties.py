"""Comparisons of equal values, repeated keys and equal amounts: the same result in Spark and in SQL, whatever the order of rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tapewright.functions import indicators as I  # noqa: E741
from tapewright.operators import adjust, events, lookup, profile, screens
from tapewright.plans import fixtures, indicators_market

DAY = datetime.date(2024, 1, 1)
#: prices in cents whose sum of doubles is not the double of their sum
CENTS = [10, 20, 30, 70, 110, 333, 1001] * 6


def _bars(spark, closes, symbol="sh600001", volume=100):
    rows = [(symbol, DAY + datetime.timedelta(days=i), c, c, c, c, volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, close double, close_adj double, low_adj double, high_adj double, volume long")


def _at_average(n):
    """Closes of which each from the n-th on, if it is whole, equals the average of the last n (itself included)."""
    cents = [c for c in CENTS[: n - 1]]
    for _ in range(20):
        last = cents[-(n - 1) :]
        whole = sum(last) % (n - 1) == 0
        cents.append(sum(last) // (n - 1) if whole else cents[0] + (n - 1) - sum(last[1:] + [cents[0]]) % (n - 1))
    return [c / 100 for c in cents]


def _in_sql(closes, n):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute("create table bars (symbol varchar, date date, close_adj double)")
    db.executemany("insert into bars values ('sh600001', ?, ?)", [(DAY + datetime.timedelta(days=i), c) for i, c in enumerate(closes)])
    return db.execute(f"select {indicators_market._avg(n)} as ma from bars order by date").fetchall()


@pytest.mark.parametrize("n", [20])
def test_sql_average_is_that_of_the_cents(n):
    closes = _at_average(n)
    found = [r[0] for r in _in_sql(closes, n)]
    cents = [round(c * 100) for c in closes]
    exact = [sum(cents[max(0, i - n + 1) : i + 1]) / len(cents[max(0, i - n + 1) : i + 1]) / 100 for i in range(len(cents))]
    assert found == exact
    assert any(c == m for c, m in zip(closes[n - 1 :], exact[n - 1 :], strict=True))


def test_p2_support_counts_a_close_at_its_average_as_sql_does(spark):
    closes = _at_average(20)
    found = profile.pattern_stats(_bars(spark, closes)).where("pattern = 'support'").first()["samples"]
    means = [r[0] for r in _in_sql(closes, 20)]
    assert found == sum(c == m for c, m in zip(closes[:-5], means[:-5], strict=True)) > 0


def test_s1_a_close_at_its_average_is_no_breakout(spark):
    closes = _at_average(20)
    bars = _bars(spark, closes).withColumn("volume", F.when(F.dayofyear("date") % 2 == 0, 1000).otherwise(100).cast("long"))
    found = {r["date"] for r in screens.factors(bars, (20,)).where(screens.volume_breakout()).collect()}
    means = [r[0] for r in _in_sql(closes, 20)]
    above = {DAY + datetime.timedelta(days=i) for i, (c, m) in enumerate(zip(closes, means, strict=True)) if c > m and (i + 1) % 2 == 0 and i}
    assert found == above


def test_s1_half_cents_of_adjusted_closes_go_away_from_zero(spark):
    duckdb = pytest.importorskip("duckdb")
    # a close before its event: (p - d + 20 r) / (1 + s + r), half a cent for many p; s, r in hundredths
    rows = []
    for p in range(30000, 140000, 37):
        for d, split, right in ((80, 10, 10), (0, 2, 10), (30, 4, 0)):
            over, under = (p - d + 20 * right * 10) * 100, 100 + split + right
            if 2 * over % under == 0 and over % under:
                close = p / 100
                below = close * (1 + split / 100 + right / 100)
                rows.append((len(rows), close, (close - d / 100 + 200.0 * right / 100) / below, (over + under // 2) // under / 100))
    assert len(rows) > 300
    df = spark.createDataFrame(rows, "k int, close double, factor double, wanted double").withColumn("volume", F.lit(1))
    found = adjust.with_adjusted(df.withColumns({c: F.col("close") for c in ("open", "high", "low")})).orderBy("k").collect()
    assert [r.close_adj for r in found] == [r.wanted for r in found]
    db = duckdb.connect()
    db.execute("create table c (k int, close double, factor double)")
    db.executemany("insert into c values (?, ?, ?)", [r[:3] for r in rows])
    assert [x for (x,) in db.execute(f"select close_adj from (select k, {fixtures.adjusted_sql('close')} from c) order by k").fetchall()] == [r[3] for r in rows]
    odd = spark.createDataFrame([(None,), (0.0,), (-0.001,), (-1.005,), (2.675,), (float("nan"),)], "x double").select(adjust.whole_cents(F.col("x")).alias("x")).collect()
    assert repr([r.x for r in odd]) == "[None, 0.0, 0.0, -1.01, 2.68, nan]"


def test_b11_a_close_at_its_average_does_not_confirm(spark):
    # closes as the difference of doubles: 30 equal ones lie at their average, and its slope is 0
    closes = [912.34 - 600, 312.34] * 20
    bars = _bars(spark, closes)
    signals = bars.select("symbol", "date").where(F.col("date") >= F.lit(DAY + datetime.timedelta(days=33)))
    for tests in ((True, False, False, False), (False, True, False, False)):
        assert events.confirm_trend(signals, bars, *tests).count() == 0


def test_q6_initials_of_a_symbol_with_two_names(spark):
    names = spark.createDataFrame([("sz000001", "Ab"), ("sz000001", "Cd")], "symbol string, name string")
    letters = spark.createDataFrame([("A", "x")], "char string, initial string")
    found = lookup.initials_of(names, letters).collect()
    assert sorted((r["name"], r["initials"]) for r in found) == [("Ab", "xb"), ("Cd", "cd")]


def test_b22_counts_a_trade_in_two_industries_once_a_concept(spark):
    d = lambda n: DAY + datetime.timedelta(days=n)
    rows = [("a", d(0), d(9), "x", ["c"]), ("a", d(0), d(9), "y", ["c"]), ("b", d(5), d(9), "x", ["c"])]
    trades = spark.createDataFrame(rows, "symbol string, buy_date date, exit_date date, industry string, concepts array<string>")
    found = events.exposure(trades).collect()
    assert sorted((r["symbol"], r["industry"], r["same_industry"], r["same_concept"], r["days_since_exit"]) for r in found) == [
        ("a", "x", 0, 0, None), ("a", "y", 0, 0, None), ("b", "x", 1, 1, None),
    ]


def _sql(name, tables):
    """The query's SQL over tables given as rows; views that it defines itself are replaced by them."""
    duckdb = pytest.importorskip("duckdb")
    from tapewright.plans import events_seats, fixtures

    db = duckdb.connect()
    text = events_seats.Q[name][1]
    for view, select in tables.items():
        own = f"{view} as ({fixtures.VIEWS[view][1].format(**fixtures._DUCK)})"
        assert own in text
        text = text.replace(own, f"{view} as ({select})")
    return db.execute(text).fetchall()


_SEATS = "select date '2024-01-01' as TRADE_DATE, '600001' as SECURITY_CODE, null as SECUCODE, d as OPERATEDEPT_NAME, n as BUY, 0.0::double as SELL, n as NET, 'r' as EXPLANATION from (values ('one', 104005.0::double), ('two', 104015.0::double)) as t(d, n)"


def test_g6_halves_go_away_from_zero_in_sql():
    found = _sql("g6_stock_summary", {"seat_trades": _SEATS, "seat_alias": "select '' as dept, '' as nickname where false"})
    assert [r[3] for r in found] == ["two...:10.402,one...:10.401"]


def test_g7_a_symbol_with_two_names_is_added_up_once():
    names = "select 'sh600001' as symbol, x as name, '' as initials from (values ('p'), ('q')) as t(x)"
    found = _sql("g7_seat_summary", {"seat_trades": _SEATS, "seat_alias": "select 'one' as dept, 'nick' as nickname", "names": names})
    assert [(r[0], r[1], r[4]) for r in found] == [("nick", round(104005 / 1e8, 8), "p:10.401,q:10.401")]


def test_b8_of_share_records_of_one_day_the_largest_counts(spark):
    duckdb = pytest.importorskip("duckdb")
    from tapewright.plans import events_seats

    rows = [("a", DAY, 5.0), ("a", DAY, 9.0), ("a", DAY, 7.0)]
    trades = spark.createDataFrame([("a", DAY, 2.0)], "symbol string, buy_date date, buy_price double")
    found = events.float_market_cap(trades, spark.createDataFrame(rows, "symbol string, date date, allocated_ratio double")).first()["float_market_cap"]
    db = duckdb.connect()
    db.execute("create table share_events (symbol varchar, date date, allocated_ratio double)")
    db.executemany("insert into share_events values (?, ?, ?)", rows)
    assert found == 180000.0 == db.execute(f"select {events_seats._CAP.format('tr')} from (select 'a' as symbol, ?::date as buy_date, 2.0::double as buy_price) as tr", [DAY]).fetchone()[0]


def test_sql_of_b7_and_b8_joins_no_industries():
    from tapewright.plans import events_seats

    for name in ("b7_with_benchmark", "b8_b10_market_cap"):
        assert "industries" not in events_seats.Q[name][1]
