"""Forward price adjustment for dividends, splits and rights: the latest price stays as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import ADJUSTED_PREFIXES, starts_with_any

ADJUSTED = ("factor", "open_adj", "high_adj", "low_adj", "close_adj", "volume_adj")


def event_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """symbol, date and factor of each ex-date event (category 1) after an instrument's first bar.

    P is the last close strictly before the event: (P - D/10 + A*R/10) / (P*(1 + S/10 + R/10)),
    or 1 where the divisor is not above 0. Events with no bar before them change nothing and
    are left out. The prior close comes from one window over bars and events together.
    """
    events = actions.where(F.col("category") == 1).select(
        "symbol", "date", F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("close"),
        "dividend", "allocated_price", "split_ratio", "allocated_ratio",
    )
    prices = bars.select("symbol", "date", F.lit(1).alias("_kind"), "close").withColumns({c: F.lit(None).cast("double") for c in ("dividend", "allocated_price", "split_ratio", "allocated_ratio")})
    # events sort before the bar of their own day, so the last close is strictly before them
    w = Window.partitionBy("symbol").orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    known = prices.unionByName(events).withColumn("_p", F.last("close", ignorenulls=True).over(w)).where((F.col("_kind") == 0) & F.col("_p").isNotNull())
    return known.select("symbol", "date", _factor(F.col("_p"), *(F.col(c) for c in ("dividend", "allocated_price", "split_ratio", "allocated_ratio"))).alias("factor"))


def _factor(p: Column, *terms: Column) -> Column:
    """An event's factor from the last close before it and its dividend, allocated price, split and allocated ratio."""
    d, a, s, r = (F.coalesce(c, F.lit(0.0)) for c in terms)
    below = p * (1 + s / 10 + r / 10)
    return F.when(below > 0, (p - d / 10 + a * r / 10) / F.nullif(below, F.lit(0.0))).otherwise(F.lit(1.0))


def cumulative_factor(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Bars with ``factor``: the product of the factors of all later events of the instrument.

    Factors of one day multiply first; then one running product over bars and event days together.
    """
    days = factors.groupBy("symbol", "date").agg(F.product("factor").alias("_f")).select("symbol", "date", "_f", F.lit(True).alias("_event"))
    marked = bars.withColumns({"_f": F.lit(1.0), "_event": F.lit(False)})
    both = marked.unionByName(days, allowMissingColumns=True).withColumn("_day", F.datediff("date", F.lit("1970-01-01")))
    later = Window.partitionBy("symbol").orderBy(F.desc("_day")).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("factor", F.coalesce(F.product("_f").over(later), F.lit(1.0))).where(~F.col("_event")).drop("_f", "_event", "_day")


def whole_cents(x: Column) -> Column:
    """Two digits, halves away from zero. Up to a millionth of a cent below a half counts as the half: products of doubles, whose order is open, miss it by less."""
    return F.signum(x) * F.round(F.abs(x) * 100 + 1e-6) / 100 + 0.0


def with_adjusted(bars: DataFrame) -> DataFrame:
    """Adds the adjusted prices (two digits, halves away from zero) and volume (whole) of bars that have a factor."""
    prices = {f"{c}_adj": whole_cents(F.col(c) * F.col("factor")) for c in ("open", "high", "low", "close")}
    return bars.withColumns(prices | {"volume_adj": F.round(F.col("volume") / F.nullif(F.col("factor"), F.lit(0.0)), 0)})


def adjusted_bars(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars with factor and adjusted columns; without events the factor is 1 and nothing changes.

    The same as ``cumulative_factor`` of ``event_factors``, but bars are computed and dealt once: bars and events
    lie in one table, in which an event finds the close before it and a bar the product of all later events.
    """
    terms = ("dividend", "allocated_price", "split_ratio", "allocated_ratio")
    marked = bars.withColumn("_kind", F.lit(1)).withColumn("_terms", F.lit(None).cast(f"struct<{','.join(f'{c}: double' for c in terms)}>"))
    events = actions.where(F.col("category") == 1).select("symbol", "date", F.lit(0).alias("_kind"), F.struct(*(F.col(c).cast("double").alias(c) for c in terms)).alias("_terms"))
    before = Window.partitionBy("symbol").orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    known = marked.unionByName(events, allowMissingColumns=True).withColumn("_p", F.last("close", ignorenulls=True).over(before))
    own = F.when((F.col("_kind") == 0) & F.col("_p").isNotNull(), _factor(F.col("_p"), *(F.col(f"_terms.{c}") for c in terms))).otherwise(F.lit(1.0))
    later = Window.partitionBy("symbol").orderBy(F.desc("_day")).rangeBetween(Window.unboundedPreceding, -1)
    dated = known.select(*bars.columns, "_kind", own.alias("_f"), F.datediff("date", F.lit("1970-01-01")).alias("_day"))
    return with_adjusted(dated.withColumn("factor", F.coalesce(F.product("_f").over(later), F.lit(1.0))).where("_kind = 1").drop("_kind", "_f", "_day"))


def adjust_or_passthrough(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Stocks are adjusted, all other instruments keep their prices with factor 1; one plan for both."""
    stock = starts_with_any(F.col("symbol"), ADJUSTED_PREFIXES)
    return adjusted_bars(bars, actions.where(stock))


def adjustment_audit(bars: DataFrame) -> DataFrame:
    """Per instrument: days, adjusted days, and the earliest adjusted day with its factor."""
    moved = F.col("factor") != 1
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(moved).alias("adjusted_days"),
        F.min(F.when(moved, F.col("date"))).alias("first_adjusted"),
        F.min_by(F.when(moved, F.col("factor")), F.when(moved, F.col("date"))).alias("first_factor"),
    )
