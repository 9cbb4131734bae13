"""First hits and lowest values over ranges of bars that start at a trade, by minima in levels.

Bars lie in blocks of a power of two, a block in one row with its values, the minima of pairs of them, of pairs of those and so
on. A trade meets the one or two blocks that its range touches and looks at a logarithmic number of minima in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depth(reach: int) -> int:
    """Levels above the values, so that a block holds ``reach`` bars or more."""
    return max(0, reach - 1).bit_length()


def asked(trades: DataFrame, first: int, last: int) -> DataFrame:
    """Trades a block that they touch (_block), from ``first`` to ``last`` bars after the buy."""
    bits = depth(last - first + 1)
    return trades.withColumn("_block", F.explode(F.sequence(F.shiftright(F.col("buy_idx").cast("long") + first, bits), F.shiftright(F.col("buy_idx").cast("long") + last, bits))))


def met(trades: DataFrame, own: DataFrame, value: str, first: int, last: int) -> DataFrame:
    """``trades`` by the block they touch, with its _bars (the rows of ``own``: _s, bar_idx from 0 without gaps, ...) and its _levels.

    Only the blocks that some trade touches are gathered; each has at most twice as many bars as the range.
    """
    bits = depth(last - first + 1)
    wanted = asked(trades, first, last)
    keys = wanted.select(F.col("symbol").alias("_k"), F.col("_block").alias("_b")).distinct()
    rows = own.withColumn("_of", F.shiftright(F.col("bar_idx").cast("long"), bits))
    near = rows.join(keys, (F.col("_s") == F.col("_k")) & (F.col("_of") == F.col("_b")), "left_semi")
    inside = F.struct("bar_idx", *(c for c in own.columns if c not in ("_s", "bar_idx")))
    blocks = near.groupBy("_s", "_of").agg(F.array_sort(F.collect_list(inside)).alias("_bars"))
    pairs = "transform(sequence(0, cast((size(element_at(up, -1)) + 1) div 2 as int) - 1), j -> least(get(element_at(up, -1), 2 * j), get(element_at(up, -1), 2 * j + 1)))"
    steps = f"aggregate(sequence(1, {bits}), array(_values), (up, n) -> concat(up, array({pairs})))" if bits else "array(_values)"
    levels = blocks.withColumn("_values", F.transform("_bars", lambda x: x[value])).withColumn("_levels", F.expr(steps)).drop("_values")
    return wanted.join(levels, (F.col("symbol") == F.col("_s")) & (F.col("_block") == F.col("_of"))).drop("_s", "_of")


def first_hit(limit: str, first: int, last: int) -> Column:
    """For rows of ``met``: the first bar of the block, from ``first`` bars after the buy on, whose value is at most the column ``limit``; else null.

    The walk goes right at its level, up where a pair ends, and down into the first pair whose minimum is low enough. The
    last block may give a bar after the range.
    """
    bits = depth(last - first + 1)
    low = f"get(get(_levels, at.k), at.j) <= {limit}"
    walk = f"""aggregate(sequence(1, {4 * bits + 4}), named_struct('k', 0, 'j', cast(greatest(buy_idx + {first} - shiftleft(_block, {bits}), 0) as int)), (at, n) -> case
        when at.k > {bits} then at
        when {low} then if(at.k = 0, at, named_struct('k', at.k - 1, 'j', at.j * 2))
        when at.j % 2 = 0 then named_struct('k', at.k, 'j', at.j + 1)
        else named_struct('k', at.k + 1, 'j', cast((at.j + 1) div 2 as int)) end,
        at -> if(at.k = 0 and {low}, at.j, null))"""
    return F.expr(f"get(_bars, {walk})")


def lowest(horizon: int, first: int, last: int) -> Column:
    """For rows of ``met``: the lowest value of the block from ``first`` to ``horizon`` bars after the buy; null without one."""
    bits = depth(last - first + 1)
    start = f"shiftleft(_block, {bits})"
    # places a to b of a level: an end that is not the outer half of its pair is taken, the rest goes up
    step = """named_struct('a', cast((at.a + 1) div 2 as int), 'b', cast((at.b + 1) div 2 as int) - 1,
        'm', least(at.m, if(at.a % 2 = 1, get(get(_levels, k), at.a), null), if(at.b % 2 = 0, get(get(_levels, k), at.b), null)))"""
    walk = f"""aggregate(sequence(0, {bits}), named_struct('a', cast(greatest(buy_idx + {first} - {start}, 0) as int), 'b', cast(least(buy_idx + {horizon} - {start}, {(1 << bits) - 1}) as int), 'm', cast(null as double)),
        (at, k) -> if(at.a > at.b, at, {step}), at -> at.m)"""
    return F.expr(walk)
