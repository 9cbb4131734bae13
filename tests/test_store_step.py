"""The step that all queries on bars share: bars are aggregated and dealt once, and read from the store after that."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tapewright.operators import adjust
from tapewright.plans.fixtures import Views
from tapewright.sources import fixed_width


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def views(spark, sf_dir):
    return Views(spark, sf_dir)


def test_items_are_dealt_by_instrument_before_they_are_sorted(views):
    lines = [x.strip() for x in _plan(views.raw_from_items()).split("== Initial Plan ==")[-1].splitlines()]
    kinds = [m.group(1) for x in lines if (m := re.search(r"(SortAggregate|Exchange|SortMergeJoin|BroadcastHashJoin)", x))]
    dealt = kinds.index("Exchange")
    assert kinds[:dealt] == ["SortAggregate", "SortAggregate"] and "SortAggregate" not in kinds[dealt:]


def test_bars_from_items_are_those_of_the_view(views):
    assert _rows(views.raw_from_items()) == _rows(views.view("bars_raw")) == _rows(views.bars_raw)


def test_raw_bars_index_and_memberships_read_no_items_again(views):
    for df in (views.bars_raw, views.index_bars, views.blocks):
        assert "lineitem.parquet" not in _plan(df)


def test_adjustment_computes_its_bars_once(spark, tmp_path):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    bars = [(s, day(n), 10.0 + n, 10.0 + n, 10.0 + n, None if n == 3 else 10.0 + n, 1.0, 5) for s in ("a", "b") for n in range(0, 12, 2 if s == "a" else 1)]
    spark.createDataFrame(bars, "symbol string, date date, open double, high double, low double, close double, amount double, volume long").write.parquet(f"{tmp_path}/bars")
    acts = [("a", day(4), 1, 1.0, 0.0, 1.0, 0.0), ("a", day(4), 1, 2.0, 3.0, None, 1.0), ("a", day(0), 1, 9.0, 0.0, 0.0, 0.0), ("a", day(5), 2, 9.0, 0.0, 0.0, 0.0), ("b", day(4), 1, 1.0, 0.0, 5.0, 0.0), ("b", day(40), 1, 1.0, 0.0, 5.0, 0.0), ("c", day(4), 1, 1.0, 0.0, 5.0, 0.0)]
    actions = spark.createDataFrame(acts, "symbol string, date date, category int, dividend double, allocated_price double, split_ratio double, allocated_ratio double")
    own = spark.read.parquet(f"{tmp_path}/bars")
    found = adjust.adjusted_bars(own, actions)
    assert _plan(found).split("== Initial Plan ==")[-1].count("FileScan") == 1
    near = lambda df: _rows(df.withColumn("factor", F.round("factor", 12)))
    assert near(found) == near(adjust.with_adjusted(adjust.cumulative_factor(own, adjust.event_factors(own, actions))))


def test_dates_of_bar_files():
    import pandas as pd

    days = [datetime.date(1969, 12, 31), datetime.date(1970, 1, 1), datetime.date(2000, 2, 29), datetime.date(2024, 12, 31)]
    rows = pd.DataFrame({"date": days} | {c: [1.0] * 4 for c in ("open", "high", "low", "close", "amount")} | {"volume": [1] * 4})
    assert fixed_width._bars("sh600001.day", fixed_width.encode_bars(rows))["date"].tolist() == days
