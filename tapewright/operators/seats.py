"""The seat/stock money-flow graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_REASON = "daily move"


def normalize_seats(seat_trades: DataFrame) -> DataFrame:
    """date, code, symbol, dept, buy, sell, net and reason; missing amounts are 0, rows without a code are left out.

    The symbol comes from "code.EX" where there is such an id, else from the code's first digit.
    """
    parts = F.split("SECUCODE", "\\.")
    code = F.col("SECURITY_CODE")
    symbol = F.when(F.contains(F.coalesce("SECUCODE", F.lit("")), F.lit(".")), F.concat(F.lower(parts[1]), parts[0])).otherwise(
        F.concat(F.when(code.startswith("0") | code.startswith("3"), "sz").otherwise("sh"), code)
    )
    return seat_trades.where(F.coalesce(code, F.lit("")) != "").select(
        F.col("TRADE_DATE").alias("date"), code.alias("code"), symbol.alias("symbol"), F.col("OPERATEDEPT_NAME").alias("dept"),
        *(F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c.lower()) for c in ("BUY", "SELL", "NET")), F.col("EXPLANATION").alias("reason"),
    )


def stock_totals(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("dept").isNotNull()).groupBy("code").agg(F.sum(F.abs("net")).alias("total"))


def seat_totals(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("dept").isNotNull()).groupBy("dept").agg(F.sum(F.abs("net")).alias("total"), F.sum("net").alias("net"), F.sum("buy").alias("buy"), F.sum("sell").alias("sell"))


def active_stocks(totals: DataFrame, min_total: float = 5e6) -> DataFrame:
    return totals.where(F.col("total") > min_total)


def active_seats(totals: DataFrame, alias: DataFrame, min_total: float = 5e6) -> DataFrame:
    """Seats above the total, or with a nickname; adds nickname."""
    named = alias.select(F.col("dept").alias("_d"), "nickname")
    return totals.join(named, F.col("dept") == F.col("_d"), "left").where((F.col("total") > min_total) | F.col("nickname").isNotNull()).drop("_d")


def node_size(total: Column, kind: str) -> Column:
    """18 to 40 for stocks, 12 to 30 for seats, by total."""
    # fixed values: smallest size, room above it, and the total that adds so many steps
    low, room, unit, step = {"stock": (18, 22.0, 4e7, 10.0), "seat": (12, 18.0, 3e7, 8.0)}[kind]
    return F.lit(low) + F.floor(F.least(F.lit(room), total / unit * step)).cast("int")


def edges(rows: DataFrame, stocks: DataFrame, seats: DataFrame) -> DataFrame:
    """src (dept), dst (code), net, buy, sell and width of the first record of each pair of active nodes."""
    live = rows.join(stocks.select(F.col("code").alias("_c")), F.col("code") == F.col("_c"), "left_semi").join(seats.select(F.col("dept").alias("_d")), F.col("dept") == F.col("_d"), "left_semi")
    # the first date, of several records that day the one with the largest amounts; null dates come first
    first = live.groupBy("dept", "code").agg(F.min_by(F.struct("net", "buy", "sell"), F.struct("date", -F.col("net"), -F.col("buy"), -F.col("sell"))).alias("_x")).select("dept", "code", "_x.*")
    return first.select(F.col("dept").alias("src"), F.col("code").alias("dst"), "net", "buy", "sell", F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.abs("net") / 2e6)).alias("width"))


def _top(rows: DataFrame, keys: list[str], label: str, order: list, k: int, name: str) -> DataFrame:
    """The first k rows of each group by ``order``, as one array of (name, net)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    best = rows.withColumn("_nth", nth).where(F.col("_nth") <= k)
    listed = F.array_sort(F.collect_list(F.struct("_nth", F.col(label).alias("name"), (F.col("net") / 1e4).alias("net"))))
    return best.groupBy(*keys).agg(F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["net"].alias("net"))).alias(name))


def stock_summary(rows: DataFrame, alias: DataFrame, k: int = 3) -> DataFrame:
    """code, net_amt (1e8, from a sum in whole cents), reason of the first record, and the top buying and selling seats; the largest |net| first."""
    seat = F.coalesce("nickname", F.concat(F.substring("dept", 1, 8), F.lit("...")))
    named = rows.join(alias.select(F.col("dept").alias("_d"), "nickname"), F.col("dept") == F.col("_d"), "left").withColumn("seat", seat)
    sums = rows.groupBy("code").agg(
        (F.round(F.sum("net"), 2) / 1e8).alias("net_amt"),
        F.coalesce(F.min_by("reason", F.struct("date", "dept", "buy", "sell")), F.lit(NO_REASON)).alias("reason"),
    )
    buys = _top(named.where("net > 0"), ["code"], "seat", [F.desc("net"), "seat"], k, "buy_seats").withColumnRenamed("code", "_b")
    sells = _top(named.where("net < 0"), ["code"], "seat", ["net", "seat"], k, "sell_seats").withColumnRenamed("code", "_s")
    joined = sums.join(buys, F.col("code") == F.col("_b"), "left").join(sells, F.col("code") == F.col("_s"), "left").drop("_b", "_s")
    return joined.orderBy(F.desc(F.abs("net_amt")), "code")


def seat_summary(rows: DataFrame, alias: DataFrame, names: DataFrame, k: int = 3) -> DataFrame:
    """nickname, buy, sell, net (1e8) and the k targets with the largest |net|; the largest |net| first.

    Sums are cut to cents, so equal targets stand in order of their names. Of a symbol with several names each is a target.
    """
    own = rows.join(alias.select(F.col("dept").alias("_d"), "nickname"), F.col("dept") == F.col("_d"))
    sums = own.groupBy("nickname").agg(*((F.round(F.sum(c), 2) / 1e8).alias(c) for c in ("buy", "sell", "net")))
    named = own.join(names.select(F.col("symbol").alias("_s"), "name"), F.col("symbol") == F.col("_s"), "left").withColumn("stock", F.coalesce("name", "code"))
    by_stock = named.groupBy("nickname", "stock").agg(F.round(F.sum("net"), 2).alias("net"))
    tops = _top(by_stock, ["nickname"], "stock", [F.desc(F.abs("net")), "stock"], k, "targets").withColumnRenamed("nickname", "_n")
    return sums.join(tops, F.col("nickname") == F.col("_n"), "left").drop("_n").orderBy(F.desc(F.abs("net")), "nickname")


def seat_graph(rows: DataFrame, alias: DataFrame, min_total: float = 5e6) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type, size, total) and edges (src, dst, net, width), named as graph libraries want them."""
    stocks = active_stocks(stock_totals(rows), min_total)
    seats = active_seats(seat_totals(rows), alias, min_total)
    nodes = stocks.select(F.col("code").alias("id"), F.lit("stock").alias("type"), node_size(F.col("total"), "stock").alias("size"), "total").unionByName(
        seats.select(F.col("dept").alias("id"), F.lit("seat").alias("type"), node_size(F.col("total"), "seat").alias("size"), "total")
    )
    return nodes, edges(rows, stocks, seats).select("src", "dst", "net", "width")
