"""Views of bars, mappings, actions, seats and curves over the star-schema tables, and the same views as SQL.

Each supplier is an instrument and each ISO week a trading day. ``Views`` gives DataFrames;
``with_views`` puts the same definitions before a query for DuckDB. The bars are adjusted for the view's
corporate actions and lie in a store, which a session writes once a folder of tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators.adjust import adjusted_bars
from ..operators.events import indexed
from ..sources.shared import shared_path
from ..sources.store import buckets_for, load_store, write_store

_SYMBOL = "case l_suppkey % 5 when 0 then 'sh60' when 1 then 'sh68' when 2 then 'sz00' when 3 then 'sz30' else 'bj43' end || lpad(cast(l_suppkey as {text}), 4, '0')"
_ORDER = "{row}(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)"
_ITEMS = "from lineitem join part on l_partkey = p_partkey where l_shipdate < timestamp '2001-07-30'"



def cents_sql(x: str) -> str:
    """``adjust.whole_cents`` in SQL."""
    return f"(sign({x}) * round(abs({x}) * 100 + 1e-6) / 100 + 0::double)"


def adjusted_sql(*columns: str) -> str:
    return ", ".join(f"{cents_sql(f'{c} * factor')} as {c}_adj" for c in columns)


#: name: (tables and views it reads, text); {text}, {row}, {min_by}, {max_by} and {to_text} differ between the engines
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "bars_raw": (
        (),
        f"""select {_SYMBOL} as symbol, cast(date_trunc('week', l_shipdate) as date) as date,
            {{min_by}}(p_retailprice - 600, {_ORDER}) as open, max(p_retailprice - 600) as high, min(p_retailprice - 600) as low,
            {{max_by}}(p_retailprice - 600, {_ORDER}) as close,
            cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount, cast(sum(l_quantity) as bigint) as volume
        {_ITEMS} group by 1, 2""",
    ),
    # for DuckDB; Spark's bars come from the library's own adjustment
    "bars": (
        ("bars_raw", "actions"),
        f"""with f as (select a.symbol, a.date, case when b.close * (1 + a.split_ratio / 10 + a.allocated_ratio / 10) > 0
                then (b.close - a.dividend / 10 + a.allocated_price * a.allocated_ratio / 10) / (b.close * (1 + a.split_ratio / 10 + a.allocated_ratio / 10)) else 1 end as factor
            from actions a asof join bars_raw b on a.symbol = b.symbol and a.date > b.date where a.category = 1),
        c as (select b.*, coalesce((select product(f.factor) from f where f.symbol = b.symbol and f.date > b.date), 1) as factor from bars_raw b)
        select *, {adjusted_sql("open", "high", "low", "close")}, round(volume / factor, 0) as volume_adj from c""",
    ),
    "index_bars": (
        ("bars_raw",),
        """select 'sh000001' as symbol, date, round(cast(sum(cast(open as decimal(18,2))) as double) / count(*), 6) as open, round(cast(sum(cast(high as decimal(18,2))) as double) / count(*), 6) as high,
            round(cast(sum(cast(low as decimal(18,2))) as double) / count(*), 6) as low, round(cast(sum(cast(close as decimal(18,2))) as double) / count(*), 6) as close,
            cast(sum(cast(amount as decimal(18,2))) as double) as amount, cast(sum(volume) as bigint) as volume
        from bars_raw group by date""",
    ),
    "industries": (
        (),
        f"""select {_SYMBOL.replace("l_suppkey", "s_suppkey")} as symbol, cast(n_nationkey as {{text}}) as industry_code, n_name as industry_name
        from supplier join nation on s_nationkey = n_nationkey""",
    ),
    "blocks": (
        (),
        f"""select block_name, block_type_id, block_category, substring(symbol, 3, 6) as code, substring(symbol, 1, 2) as market from (
            select distinct {_SYMBOL} as symbol, p_brand as block_name, 1 as block_type_id, 'concept' as block_category
            from lineitem join part on l_partkey = p_partkey where l_quantity = 50
            union all
            select distinct {_SYMBOL} as symbol, p_type as block_name, 2 as block_type_id, 'style' as block_category
            from lineitem join part on l_partkey = p_partkey where l_quantity = 49
            union all
            select {_SYMBOL.replace("l_suppkey", "s_suppkey")} as symbol, r_name as block_name, 3 as block_type_id, 'index' as block_category
            from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        ) as m""",
    ),
    "names": (
        (),
        f"""select {_SYMBOL.replace("l_suppkey", "s_suppkey")} as symbol, s_name as name, 's' || cast(s_suppkey as {{text}}) as initials from supplier""",
    ),
    "actions": (
        (),
        f"""select {_SYMBOL} as symbol, cast(l_shipdate as date) as date, 1 as category, l_tax * 100 as dividend, cast(200 as double) as allocated_price,
            l_discount * 10 as split_ratio, cast(case when l_linenumber = 1 then 1 else 0 end as double) as allocated_ratio
        from lineitem where l_returnflag = 'R' and l_quantity = 1""",
    ),
    "share_events": (
        (),
        f"""select symbol, date, allocated_ratio from (
            select {_SYMBOL} as symbol, cast(l_shipdate as date) as date, l_quantity * 100 as allocated_ratio,
                row_number() over (partition by l_suppkey, cast(l_shipdate as date) order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_partkey desc, l_extendedprice desc) as nth
            from lineitem where l_linenumber = 7) as e where nth = 1""",
    ),
    "seat_trades": (
        (),
        f"""select cast(o_orderdate as date) as TRADE_DATE, substring(symbol, 3, 6) as SECURITY_CODE,
            case when l_linenumber % 2 = 0 then substring(symbol, 3, 6) || '.' || upper(substring(symbol, 1, 2)) end as SECUCODE,
            c_name as OPERATEDEPT_NAME, case when l_returnflag <> 'R' then l_extendedprice end as BUY, case when l_returnflag = 'R' then l_extendedprice end as SELL,
            case when l_returnflag <> 'R' then l_extendedprice else -l_extendedprice end as NET, o_orderpriority as EXPLANATION
        from (select *, {_SYMBOL} as symbol from lineitem) as l join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""",
    ),
    "seat_alias": ((), """select c_name as dept, c_mktsegment as nickname from customer where c_custkey % 10 = 0"""),
    "sources": ((), """select o_orderkey as k, 'file-' || cast(o_orderkey as {text}) as path, o_orderdate as mtime from orders"""),
    "manifest": (
        (),
        """select 'file-' || cast(o_orderkey as {text}) as path, case when o_orderkey % 5 = 0 then o_orderdate - interval 1 day else o_orderdate end as mtime
        from orders where o_orderkey % 3 <> 0""",
    ),
    "params": (
        (),
        """select row_number() over (order by vol_ratio, upper, lower) as param_id, vol_ratio, upper, lower from
            (select cast(column0 as double) as vol_ratio from (values (3.0), (3.5)) as a(column0)) as a,
            (select cast(column0 as double) as upper from (values (1.3), (1.4)) as b(column0)) as b,
            (select cast(column0 as double) as lower from (values (0.5), (0.6)) as c(column0)) as c""",
    ),
    "equity_curve": (
        (),
        """select date, cast(sum(delta) over (order by date) as double) / 1000000 + 1000000 as total_value from (
            select cast(o_orderdate as date) as date, sum(cast(case when o_orderstatus = 'P' then -o_totalprice * 20 else o_totalprice end as decimal(18,2))) as delta from orders group by 1) as d""",
    ),
}
_SPARK = {"text": "string", "row": "struct", "min_by": "min_by", "max_by": "max_by"}
_DUCK = {"text": "varchar", "row": "row", "min_by": "arg_min", "max_by": "arg_max"}


#: tables that a session has written, by application, folder and name
_kept: dict[tuple[str, str, str], str] = {}


class Views:
    """The views over the Parquet tables of a folder, made once each."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return {t: self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet") for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The result of ``build``, written once a session to the shared folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _kept:
            path = shared_path(self.spark, name)
            build().write.parquet(path)
            _kept[key] = path
        return self.spark.read.parquet(_kept[key])

    def table(self, name: str, build: Callable[[], DataFrame]) -> str:
        """Name of a store (bucketed by instrument) with the result of ``build``, written once a session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, f"table {name}")
        if key not in _kept:
            path = shared_path(self.spark, name)
            table = path.rsplit("/", 1)[-1].replace("-", "_")
            # a bar is made of one item or more
            write_store(build(), table, buckets_for(self.lineitem.count(), int(self.spark.conf.get("spark.sql.shuffle.partitions"))), path)
            _kept[key] = table
        return _kept[key]

    def raw_from_items(self) -> DataFrame:
        """``bars_raw`` from the items, which are dealt by instrument before they are sorted and aggregated.

        First and last item of a bar are found by several columns, so the aggregates sort. Dealt first, a task sorts one share
        of the instruments once; otherwise each task would sort all of its input, and ship bars wider than their items.
        """
        columns = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, p_retailprice"
        picked = f"select {_SYMBOL.format(**_SPARK)} as symbol, {columns} {_replace_word(_replace_word(_ITEMS, 'lineitem'), 'part')}"
        items = self.spark.sql(picked, lineitem=self.lineitem, part=self.part).repartition("symbol")
        return self.spark.sql(VIEWS["bars_raw"][1].replace(_ITEMS, "from {{items}}").replace(_SYMBOL, "symbol").format(**_SPARK), items=items)

    @cached_property
    def store(self) -> str:
        """Name of the store of adjusted bars."""
        return self.table("bars", lambda: adjusted_bars(self.raw_from_items(), self.actions))

    @cached_property
    def bars_raw(self) -> DataFrame:
        """Bars before adjustment, from the store, which keeps their columns as they were."""
        return self.bars.select("symbol", "date", "open", "high", "low", "close", "amount", "volume")

    @cached_property
    def blocks(self) -> DataFrame:
        """Memberships, written once a session: screens meet them several times."""
        return self.kept("blocks", lambda: self.view("blocks"))

    @cached_property
    def bars(self) -> DataFrame:
        return load_store(self.spark, self.store)

    @cached_property
    def numbered(self) -> DataFrame:
        """Bars with bar_idx and bars_total."""
        return load_store(self.spark, self.table("numbered", lambda: indexed(self.bars)))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in self.tables:
            raise AttributeError(name)
        if name in self.tables:
            return self.tables[name]
        return self.view(name)

    def view(self, name: str) -> DataFrame:
        if name not in self.made:
            needs, text = VIEWS[name]
            frames = {**self.tables, **{n: getattr(self, n) for n in needs}}
            used = {n: df for n, df in frames.items() if n in needs or n in text}
            quoted = text.format(**_SPARK)
            for n in used:
                quoted = _replace_word(quoted, n)
            self.made[name] = self.spark.sql(quoted, **used)
        return self.made[name]


def _replace_word(text: str, table: str) -> str:
    """``from x`` and ``join x`` become references to a DataFrame argument."""
    import re

    return re.sub(rf"\b(from|join)\s+{table}\b", rf"\1 {{{table}}}", text)


def with_views(names: str, body: str) -> str:
    """DuckDB SQL: the named views (space-separated) and what they need, then ``body``, which may go on with more WITH parts after a leading comma."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in VIEWS[name][0]:
            add(n)
        if name not in wanted:
            wanted.append(name)

    for n in names.split():
        add(n)
    parts = [f"{n} as ({VIEWS[n][1].format(**_DUCK)})" for n in wanted]
    return "with " + ",\n".join(parts) + "\n" + body
