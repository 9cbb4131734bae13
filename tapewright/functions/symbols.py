"""Columns over instrument ids such as ``sh600000``: market, board, category, codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: id prefixes of each category and board
CATEGORY_PREFIXES = {
    "stock": ("sh60", "sh68", "sz00", "sz30", "bj"),
    "index": ("sh000", "sz399"),
    "sector": ("sh88", "sz88"),
    "fund": ("sh50", "sh51", "sh52", "sh58", "sz15", "sz16", "sz18"),
    "bond": ("sh11", "sh13", "sz12"),
}
BOARD_PREFIXES = {"main_sh": "sh60", "star": "sh68", "main_sz": "sz00", "chinext": "sz30", "bj": "bj"}
ADJUSTED_PREFIXES = ("sh60", "sh68", "sz00", "sz30", "bj43", "bj83", "bj87", "bj88", "bj92")
SH_CODES = ("6", "900")
SZ_CODES = ("00", "30", "200")
BJ_CODES = ("43", "83", "87", "88")


def starts_with_any(col: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (col.startswith(p) for p in prefixes))


def in_categories(symbol: Column, categories: list[str] | None = None) -> Column:
    """Whether an id belongs to one of the categories; none or only unknown ones mean stocks."""
    known = [c for c in categories or [] if c in CATEGORY_PREFIXES] or ["stock"]
    return reduce(lambda a, b: a | b, (starts_with_any(symbol, CATEGORY_PREFIXES[c]) for c in known))


def board(symbol: Column) -> Column:
    """main_sh, star, main_sz, chinext, bj or other."""
    out = F.lit("other")
    for name, prefix in BOARD_PREFIXES.items():
        out = F.when(symbol.startswith(prefix), name).otherwise(out)
    return out


def normalize_code(raw: Column) -> Column:
    """Struct (market, code) of a membership code.

    Seven characters or more with a leading 0 or 1 carry their market; other codes get it from
    their prefix, or ``unknown``.
    """
    marked = (F.length(raw) >= 7) & F.substring(raw, 1, 1).isin("0", "1")
    bare = F.substring(raw, 1, 6)
    by_prefix = (
        F.when(starts_with_any(bare, SH_CODES), "sh")
        .when(starts_with_any(bare, SZ_CODES), "sz")
        .when(starts_with_any(bare, BJ_CODES), "bj")
        .otherwise("unknown")
    )
    return F.struct(
        F.when(marked, F.when(F.substring(raw, 1, 1) == "0", "sz").otherwise("sh")).otherwise(by_prefix).alias("market"),
        F.when(marked, F.substring(raw, 2, 6)).otherwise(bare).alias("code"),
    )


def clean_name(name: Column) -> Column:
    """A name without its ex-dividend or ex-rights mark."""
    return F.regexp_replace(name, "(?i)^(XD|XR|DR)", "")


def guess_market(code: Column) -> Column:
    """Market of a six-digit code by its prefix alone."""
    return F.when(starts_with_any(code, ("60", "68")), "sh").when(starts_with_any(code, ("00", "30")), "sz").otherwise("bj")
