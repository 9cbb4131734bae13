"""Queries over sources (I), universe filters (F) and price adjustment (A), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as I  # noqa: E741
from ..functions import symbols as S
from ..operators import adjust, universe
from ..sources import bars as bar_files
from ..sources import appended, fixed_width, reference, store, sync
from ..sources.shared import shared_path
from .fixtures import Views, adjusted_sql, with_views

RAW = "symbol, date, open, high, low, close, amount, volume"
#: rows a file of names or of one block's codes, about
FILE_ROWS = 4000
Q: dict[str, tuple] = {}


def _new_table(v: Views, name: str) -> tuple[str, str]:
    path = shared_path(v.spark, name)
    return path.rsplit("/", 1)[-1].replace("-", "_"), path


def i3_bars_round_trip(v: Views):
    table, path = _new_table(v, "round-trip")
    store.write_store(v.bars, table, path=path)
    return universe.with_board(store.load_store(v.spark, table)).select("symbol", "date", "close", "close_adj", "volume", "board")


def i3_replace_instruments(v: Views):
    """Instruments with numbers divisible by 20 get other bars (one close more, no bars of 1996); all others stay. Those divisible by 40 get theirs twice."""
    table, path = _new_table(v, "replaced")
    store.write_store(v.bars, table, path=path)
    other = v.bars.where(_ASKED).where("year(date) <> 1996").withColumn("close", F.col("close") + 1)
    store.replace_instruments(other.where("cast(substring(symbol, 5) as int) % 40 = 0").withColumn("close", F.lit(0.0)), table)
    store.replace_instruments(other, table)
    return store.load_store(v.spark, table).select("symbol", "date", "close", "close_adj", "volume")


def i1_bars_by_file(v: Views):
    """One file an instrument, named by its id."""
    path = shared_path(v.spark, "by-file")
    rows = v.bars.withColumn("file", F.concat("symbol", F.lit(".parquet"))).drop("symbol")
    rows.repartition("file").write.partitionBy("file").parquet(path)
    return bar_files.load_bars_by_file(v.spark, path).select("symbol", "date", "close", "close_adj", "volume")


#: the instruments that searches ask for: numbers divisible by 20
_ASKED = "cast(substring(symbol, 5) as int) % 20 = 0"


_BOARD = "case when symbol like 'sh60%' then 'main_sh' when symbol like 'sh68%' then 'star' when symbol like 'sz00%' then 'main_sz' when symbol like 'sz30%' then 'chinext' when symbol like 'bj%' then 'bj' else 'other' end"
Q["i1_i3_bars_round_trip"] = (i3_bars_round_trip, with_views("bars", f"select symbol, date, close, close_adj, volume, {_BOARD} as board from bars"))
Q["i3_replace_instruments"] = (
    i3_replace_instruments,
    with_views("bars", ", a as (select *, cast(substr(symbol, 5) as int) % 20 = 0 as asked from bars) select symbol, date, case when asked then close + 1 else close end as close, close_adj, volume from a where not (asked and year(date) = 1996)"),
)
Q["i1_bars_by_file"] = (i1_bars_by_file, with_views("bars", "select symbol, date, close, close_adj, volume from bars"))
Q["i2_load_symbol"] = (lambda v: store.load_symbol(v.spark, v.store, "sh600005", ["date", "close_adj"]), with_views("bars", "select date, close_adj from bars where symbol = 'sh600005'"))


def i4_bar_files(v: Views):
    folder = shared_path(v.spark, "bar-files")
    fixed_width.write_files(v.bars_raw, "symbol", fixed_width.encode_bars, folder, ".day").write.parquet(f"{folder}-manifest")
    return fixed_width.read_fixed_width(v.spark, f"{folder}/*.day", fixed_width.BARS_LAYOUT)


Q["i4_bar_files"] = (
    i4_bar_files,
    with_views("bars_raw", "select symbol, date, round(open, 2) as open, round(high, 2) as high, round(low, 2) as low, round(close, 2) as close, cast(cast(amount as float) as double) as amount, volume from bars_raw"),
)


def i5_name_files(v: Views):
    folder = shared_path(v.spark, "name-files")
    rows = v.names.withColumn("market", F.substring("symbol", 1, 2))
    encode = lambda g: fixed_width.encode_names([(s[2:], n) for s, n in zip(g["symbol"], g["name"], strict=True)])
    rows = fixed_width.in_parts(rows, "market", "symbol", FILE_ROWS)
    fixed_width.write_files(rows, "market", encode, folder, "m.tnf").write.parquet(f"{folder}-manifest")
    return fixed_width.read_fixed_width(v.spark, f"{folder}/*.tnf", fixed_width.NAMES_LAYOUT)


Q["i5_name_files"] = (i5_name_files, with_views("names", "select symbol, name from names"))


def _raw_blocks(v: Views, category: str):
    """Memberships with the marked seven-character codes of sh and sz, and bare ones of bj."""
    code = F.when(F.col("market") == "sh", F.concat(F.lit("1"), "code")).when(F.col("market") == "sz", F.concat(F.lit("0"), "code")).otherwise(F.col("code"))
    return v.blocks.where(F.col("block_category") == category).select("block_name", "block_type_id", code.alias("raw_code"))


def i6_block_files(v: Views):
    folder = shared_path(v.spark, "block-files")

    def encode(g):
        named = [(n[:8], int(own["block_type_id"].iloc[0]), sorted(own["raw_code"])) for n, own in g.groupby("block_name")]
        return fixed_width.encode_blocks(named)

    rows = _raw_blocks(v, "concept").withColumn("file", F.concat(F.lit("concept-"), F.hex(F.xxhash64("block_name"))))
    rows = fixed_width.in_parts(rows, "file", "raw_code", FILE_ROWS)
    fixed_width.write_files(rows, "file", encode, folder, ".dat").write.parquet(f"{folder}-manifest")
    return fixed_width.read_fixed_width(v.spark, f"{folder}/*.dat", fixed_width.BLOCKS_LAYOUT)


_MARKED = "case market when 'sh' then '1' || code when 'sz' then '0' || code else code end"
Q["i6_block_files"] = (i6_block_files, with_views("blocks", f"select block_name, block_type_id, {_MARKED} as raw_code from blocks where block_category = 'concept'"))
Q["i7_normalize_code"] = (
    lambda v: _raw_blocks(v, "style").unionByName(_raw_blocks(v, "style").withColumn("raw_code", F.substring("raw_code", -6, 6))).distinct()
    .select("block_name", "raw_code", S.normalize_code(F.col("raw_code")).alias("c")).select("block_name", "raw_code", "c.market", "c.code"),
    with_views("blocks", f""", r as (select distinct block_name, {_MARKED} as raw_code from blocks where block_category = 'style'
            union select distinct block_name, code from blocks where block_category = 'style')
        select block_name, raw_code,
            case when length(raw_code) = 7 then case substr(raw_code, 1, 1) when '0' then 'sz' else 'sh' end
                when raw_code like '6%' or raw_code like '900%' then 'sh'
                when raw_code like '00%' or raw_code like '30%' or raw_code like '200%' then 'sz'
                when substr(raw_code, 1, 2) in ('43', '83', '87', '88') then 'bj' else 'unknown' end as market,
            right(raw_code, 6) as code from r"""),
)
Q["i8_block_mappings"] = (
    lambda v: reference.build_block_mappings({c: _raw_blocks(v, c) for c in ("concept", "style", "index")}),
    with_views("blocks", "select block_name, block_type_id, block_category, code, market from blocks"),
)


def _industry_lines(v: Views):
    """The two text files of industry data, written from the views and read as lines."""
    folder = shared_path(v.spark, "industry")
    code = F.concat(F.lit("X"), F.lpad("industry_code", 4, "0"))
    entries = v.industries.where("industry_code <> '3'").select(F.concat(code, F.lit("|"), "industry_name").alias("value")).distinct()
    head = v.spark.range(1)
    sections = head.select(F.lit(0).alias("k"), F.lit("#HEAD").alias("value")).unionByName(head.select(F.lit(1).alias("k"), F.lit("X0001|wrong section").alias("value")))
    sections = sections.unionByName(head.select(F.lit(2).alias("k"), F.lit("#INDUSTRY").alias("value"))).unionByName(entries.select(F.lit(3).alias("k"), "value"))
    sections = sections.unionByName(head.select(F.lit(4).alias("k"), F.lit("#TAIL").alias("value"))).unionByName(head.select(F.lit(5).alias("k"), F.lit("X0003|wrong section").alias("value")))
    sections.repartitionByRange(1, "k").sortWithinPartitions("k", "value").select("value").write.text(f"{folder}/dictionary")
    market = F.when(F.col("symbol").startswith("sz"), "0").when(F.col("symbol").startswith("sh"), "1").otherwise("2")
    v.industries.select(F.concat_ws("|", market, F.substring("symbol", 3, 6), F.concat(code, F.lit("77"))).alias("value")).write.text(f"{folder}/map")
    return reference.read_lines(v.spark, f"{folder}/dictionary"), reference.read_lines(v.spark, f"{folder}/map")


def _dictionary(lines):
    parts = F.split("value", "\\|")
    return reference.read_section(lines, "INDUSTRY").select(parts[0].alias("industry_code"), parts[1].alias("industry_name"))


Q["i10_read_section"] = (
    lambda v: _dictionary(_industry_lines(v)[0]),
    with_views("industries", "select distinct 'X' || lpad(industry_code, 4, '0') as industry_code, industry_name from industries where industry_code <> '3'"),
)


def i9_industry_mappings(v: Views):
    dictionary, lines = _industry_lines(v)
    return reference.build_industry_mappings(lines, _dictionary(dictionary))


Q["i9_industry_mappings"] = (
    i9_industry_mappings,
    with_views("industries", "select symbol, 'X' || lpad(industry_code, 4, '0') as industry_code, case when industry_code = '3' then 'other' else industry_name end as industry_name from industries"),
)
Q["i11_changed_sources"] = (
    lambda v: sync.changed_sources(v.sources.select("path", "mtime"), v.manifest),
    with_views("sources manifest", "select s.path, s.mtime from sources s left join manifest m on s.path = m.path where m.path is null or s.mtime > m.mtime"),
)
_GROWN = "1997-01-01"


def i11_appended_bars(v: Views):
    """Bar files up to a date, then grown to all days: the second run reads their new ends, and the store has all bars adjusted."""
    table, path = _new_table(v, "followed")
    folder, raw = shared_path(v.spark, "growing"), shared_path(v.spark, "followed-raw")
    store.write_store(v.bars.limit(0), table, store.buckets_for(v.lineitem.count(), int(v.spark.conf.get("spark.sql.shuffle.partitions"))), path)
    for part, rows in enumerate((v.bars_raw.where(F.col("date") < _GROWN), v.bars_raw)):
        fixed_width.write_files(rows, "symbol", fixed_width.encode_bars, folder, ".day").write.parquet(f"{folder}-manifest-{part}")
        appended.follow(v.spark, folder, raw, v.actions, table, f"{raw}-offsets").awaitTermination()
    return store.load_store(v.spark, table).select("symbol", "date", "close", "volume", F.round("close_adj", 2).alias("close_adj"))


Q["i11_appended_bars"] = (i11_appended_bars, with_views("bars", "select symbol, date, round(close, 2) as close, volume, round(close_adj, 2) as close_adj from bars"))
Q["i13_ingest_summary"] = (
    lambda v: sync.ingest_summary(v.sources.select("path", F.when(F.col("k") % 97 == 0, "failed").otherwise("success").alias("status"))),
    with_views("sources", """, r as (select path, case when k % 97 = 0 then 'failed' else 'success' end as status from sources),
        f as (select path from r where status = 'failed' order by path limit 5)
        select status, count(*) as sources, case when status = 'failed' then (select string_agg(path, ',' order by path) from f) else '' end as examples from r group by status"""),
)
Q["i14_clean_actions"] = (
    lambda v: reference.clean_actions(
        v.actions.select(F.substring("symbol", 3, 6).alias("code"), F.when(F.dayofmonth("date") == 7, F.lit("20010231")).when(F.dayofmonth("date") == 9, F.lit("n/a")).otherwise(F.date_format("date", "yyyyMMdd")).alias("date"), "category", "dividend")
    ),
    with_views("actions", "select substr(symbol, 3, 6) as code, date, category, dividend from actions where day(date) not in (7, 9)"),
)
Q["i15_trading_calendar"] = (lambda v: bar_files.trading_calendar(v.bars), with_views("bars_raw", "select distinct date from bars_raw"))
Q["i16_latest_snapshot"] = (
    lambda v: bar_files.latest_snapshot(v.seat_trades.groupBy("TRADE_DATE", "SECURITY_CODE").agg(F.count(F.lit(1)).alias("n")), "1998-08-09", 8, "TRADE_DATE"),
    with_views("seat_trades", "select TRADE_DATE, SECURITY_CODE, count(*) as n from seat_trades where TRADE_DATE = (select max(TRADE_DATE) from seat_trades where TRADE_DATE between date '1998-08-02' and date '1998-08-09') group by 1, 2"),
)

# ---------------------------------------------------------------- universe
Q["f1_by_category"] = (
    lambda v: universe.by_category(v.bars.unionByName(v.index_bars.withColumns({c: F.lit(None).cast("double") for c in ("factor", "open_adj", "high_adj", "low_adj", "close_adj", "volume_adj")})), ["index", "nonsense"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")),
    with_views("index_bars", "select symbol, count(*) as n from index_bars group by 1"),
)
Q["f2_board"] = (lambda v: universe.with_board(v.bars).groupBy("board").agg(F.count_distinct("symbol").alias("symbols"), F.sum("volume").alias("volume")), with_views("bars", f"select {_BOARD} as board, count(distinct symbol) as symbols, cast(sum(volume) as bigint) as volume from bars group by 1"))
Q["f3_traded_today"] = (lambda v: universe.traded_today(v.bars, v.index_bars).select("symbol", "close", "volume"), with_views("bars", "select symbol, close, volume from bars where date = (select max(date) from bars) and volume > 0"))
Q["f4_date_range"] = (
    lambda v: universe.in_range(universe.date_range(v.bars, "1999-03-01", "1999-12-31").withColumn("ma20", F.round(I.sma("close_adj", 20), 6)), "1999-03-01").select("symbol", "date", "ma20"),
    with_views("bars", """, w as (select * from bars where date >= date '1999-03-01' - 380 and date <= date '1999-12-31')
        select * from (select symbol, date, round(avg(close_adj) over (partition by symbol order by date rows 19 preceding), 6) as ma20 from w) where date >= date '1999-03-01'"""),
)
Q["f5_min_listing_age"] = (lambda v: universe.min_listing_age(v.bars, 390).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first")), with_views("bars", "select symbol, count(*) as n, min(date) as first from (select *, min(date) over (partition by symbol) as f from bars) where date - f >= 390 group by 1"))
Q["f6_valid_prices"] = (
    lambda v: universe.valid_prices(v.bars.withColumn("close_adj", F.when(F.col("close_adj") > 350, F.col("close_adj")))).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")),
    with_views("bars", "select symbol, count(*) as n from bars where close_adj > 350 and volume > 0 group by 1"),
)
Q["f7_latest_n"] = (lambda v: universe.latest_n(v.bars, 10).select("symbol", "date", "rn"), with_views("bars", "select symbol, date, rn from (select *, row_number() over (partition by symbol order by date desc) as rn from bars) where rn <= 10"))
Q["f9_clean_name"] = (
    lambda v: v.names.select("symbol", S.clean_name(F.concat(F.when(F.col("initials").endswith("1"), "XD").when(F.col("initials").endswith("2"), "dr").otherwise(""), "name")).alias("name")),
    with_views("names", "select symbol, name from names"),
)
Q["f10_resolve_symbol"] = (
    lambda v: universe.resolve_symbol(v.bars.select(F.substring("symbol", 3, 6).alias("query")).distinct().unionByName(v.names.where("initials like '%7'").select(F.upper("symbol").alias("query"))).unionByName(v.names.where("initials like '%9'").select(F.concat(F.lit("60"), F.substring("symbol", 5, 4)).alias("query"))), v.names.where("initials not like '%4'"), v.bars),
    with_views("bars names", """, q as (select distinct substr(symbol, 3, 6) as query from bars union all select upper(symbol) from names where initials like '%7'
            union all select '60' || substr(symbol, 5, 4) from names where initials like '%9'),
        n as (select substr(symbol, 3, 6) as c, min(symbol) as s from names where initials not like '%4' group by 1), b as (select substr(symbol, 3, 6) as c, min(symbol) as s from bars group by 1)
        select query, case when regexp_matches(query, '^[0-9]{6}$') then coalesce(n.s, b.s, case when substr(query, 1, 2) in ('60', '68') then 'sh' when substr(query, 1, 2) in ('00', '30') then 'sz' else 'bj' end || query) else lower(query) end as symbol
        from q left join n on query = n.c left join b on query = b.c"""),
)
Q["f11_present"] = (
    lambda v: universe.present(universe.at_latest(v.bars).select("symbol", "close", "volume"), v.names.where("initials not like '%3'")),
    with_views("bars names", "select upper(b.symbol) as symbol, coalesce(n.name, '') as name, round(b.close, 2) as close, b.volume from bars b left join names n on n.symbol = b.symbol and n.initials not like '%3' where b.date = (select max(date) from bars)"),
)

# -------------------------------------------------------------- adjustment
_FACTORS = """, f as (select a.symbol, a.date, case when b.close * (1 + a.split_ratio / 10 + a.allocated_ratio / 10) > 0
            then (b.close - a.dividend / 10 + a.allocated_price * a.allocated_ratio / 10) / (b.close * (1 + a.split_ratio / 10 + a.allocated_ratio / 10)) else 1 end as factor
        from actions a asof join bars_raw b on a.symbol = b.symbol and a.date > b.date where a.category = 1)"""
_FACTORED = _FACTORS + ", c as (select b.*, coalesce((select product(f.factor) from f where f.symbol = b.symbol and f.date > b.date), 1) as factor from bars_raw b)"
Q["a1_event_factors"] = (lambda v: adjust.event_factors(v.bars_raw, v.actions).withColumn("factor", F.round("factor", 9)), with_views("bars_raw actions", _FACTORS + " select symbol, date, round(factor, 9) as factor from f"))
Q["a2_cumulative_factor"] = (
    lambda v: adjust.cumulative_factor(v.bars_raw, adjust.event_factors(v.bars_raw, v.actions)).select("symbol", "date", F.round("factor", 9).alias("factor")),
    with_views("bars_raw actions", _FACTORED + " select symbol, date, round(factor, 9) as factor from c"),
)
Q["a3_adjusted_bars"] = (
    lambda v: adjust.adjusted_bars(v.bars_raw, v.actions).select("symbol", "date", "close", "open_adj", "high_adj", "low_adj", "close_adj", "volume_adj"),
    with_views("bars_raw actions", _FACTORED + f" select symbol, date, close, {adjusted_sql('open', 'high', 'low', 'close')}, round(volume / factor, 0) as volume_adj from c"),
)
Q["a4_i12_adjust_or_passthrough"] = (
    lambda v: adjust.adjust_or_passthrough(v.bars_raw.unionByName(v.index_bars.withColumn("close", F.floor("close").cast("double"))), v.actions.unionByName(v.actions.withColumn("symbol", F.lit("sh000001")))).select("symbol", "date", F.round("factor", 9).alias("factor"), "close_adj"),
    with_views("bars_raw actions index_bars", _FACTORED + f" select symbol, date, round(factor, 9) as factor, {adjusted_sql('close')} from c union all select symbol, date, 1, floor(close) from index_bars"),
)
Q["a5_adjustment_audit"] = (
    lambda v: adjust.adjustment_audit(adjust.adjusted_bars(v.bars_raw, v.actions)).withColumn("first_factor", F.round("first_factor", 9)),
    with_views("bars_raw actions", _FACTORED + " select symbol, count(*) as days, count(*) filter (where factor <> 1) as adjusted_days, min(date) filter (where factor <> 1) as first_adjusted, round(arg_min(factor, date) filter (where factor <> 1), 9) as first_factor from c group by 1"),
)
