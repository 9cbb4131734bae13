"""Rolling indicators as columns over one window, so that all of them share one exchange and sort.

Every builder works on rows of an instrument in date order; give another ``w`` for
other keys. Divisions are guarded: a zero or missing divisor gives null.

Builders of sums and extremes add up their window anew at each row. ``with_means`` and ``with_extremes`` add columns to a
DataFrame at a cost a row that doesn't, or hardly, depend on the window: means from differences of one exact
running sum, extremes from windows that double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MA_LENGTHS = (5, 10, 20, 30, 60, 120, 250)


def by_date() -> WindowSpec:
    """Rows of an instrument in date order."""
    return Window.partitionBy("symbol").orderBy("date")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def last_rows(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_date()).rowsBetween(-(n - 1), 0)


def sma(col: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    """Moving average over up to n rows (partial at the start)."""
    return F.avg(_col(col)).over(last_rows(n, w))


def sma_full(col: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    """Moving average that is null until there are n values."""
    f = last_rows(n, w)
    return F.when(F.count(_col(col)).over(f) == n, F.avg(_col(col)).over(f))


def with_means(df: DataFrame, col: str, lengths: dict[str, int], scale: int = 100, full: bool = False, w: WindowSpec | None = None) -> DataFrame:
    """Adds a moving average for each name in ``lengths`` (name: rows): partial at the start, or with ``full`` null until there are that many values.

    Values are whole numbers after multiplying by ``scale`` (100 for prices in whole cents, 1 for volumes), so the
    running sum is an exact long and each average is a difference of two of its values. Nulls count neither as
    value nor as row of the average.
    """
    w = w or by_date()
    value = F.round(F.col(col) * scale).cast("long")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_upto", F.struct(F.sum(value).over(so_far).alias("s"), F.count(value).over(so_far).alias("n")))
    nothing = F.struct(F.lit(None).cast("long").alias("s"), F.lit(0).cast("long").alias("n"))
    for name, n in lengths.items():
        summed = summed.withColumn(f"_before_{name}", F.lag("_upto", n).over(w))
    out = {}
    for name, n in lengths.items():
        before = F.coalesce(F.col(f"_before_{name}"), nothing)
        count = F.col("_upto.n") - before["n"]
        out[name] = F.when(count == n if full else count > 0, (F.col("_upto.s") - F.coalesce(before["s"], F.lit(0))) / count / scale)
    return summed.withColumns(out).drop("_upto", *(f"_before_{name}" for name in lengths))


def with_extremes(df: DataFrame, highs: dict[str, tuple[str, int]], lows: dict[str, tuple[str, int]], w: WindowSpec | None = None) -> DataFrame:
    """Adds the highest (``highs``) and lowest (``lows``) value of up to n rows; each name comes with its column and n.

    An extreme of 2k rows is that of two extremes of k rows, and one of n rows is that of two of the largest power of two
    that fits, which may overlap; so n rows take log2(n) looks back, all over one sort. Nulls are passed over.
    """
    w = w or by_date()
    columns = {(c, F.greatest): max(n for k, n in highs.values() if k == c) for c in {k for k, _ in highs.values()}}
    columns |= {(c, F.least): max(n for k, n in lows.values() if k == c) for c in {k for k, _ in lows.values()}}
    level = {(c, pick, 1): F.col(c) for c, pick in columns}
    k = 1
    while any(2 * k <= most for most in columns.values()):
        grown = {}
        for nth, ((c, pick), most) in enumerate(sorted(columns.items(), key=lambda x: (x[0][0], x[0][1] is F.least))):
            if 2 * k <= most:
                own = f"_x{nth}_{2 * k}"
                grown[own] = pick(level[c, pick, k], F.lag(level[c, pick, k], k).over(w))
                level[c, pick, 2 * k] = F.col(own)
        df, k = df.withColumns(grown), 2 * k
    out = {}
    for asked, pick in ((highs, F.greatest), (lows, F.least)):
        for name, (c, n) in asked.items():
            half = 1 << (n.bit_length() - 1)
            own = level[c, pick, half]
            out[name] = own if half == n else pick(own, F.lag(own, n - half).over(w))
    made = [x for x in df.columns if x.startswith("_x")]
    return df.withColumns(out).drop(*made)


def vol_ma(n: int, w: WindowSpec | None = None) -> Column:
    return sma("volume", n, w)


def vol_ratio(n: int, w: WindowSpec | None = None) -> Column:
    """Volume over its average; 1 where the average is not above 0."""
    mean = vol_ma(n, w)
    return F.when(mean > 0, F.col("volume") / mean).otherwise(F.lit(1.0))


def over_mean(mean: str, col: str = "volume") -> Column:
    """A value over its average, which is a column; 1 where the average is not above 0."""
    return F.when(F.col(mean) > 0, F.col(col) / F.col(mean)).otherwise(F.lit(1.0))


def pct_return(col: str | Column = "close_adj", w: WindowSpec | None = None) -> Column:
    """Return on the row before, in percent."""
    before = F.lag(_col(col)).over(w or by_date())
    return ratio(_col(col) - before, before) * 100


def rolling_std(col: str | Column, n: int = 20, annualize: int | None = None, w: WindowSpec | None = None) -> Column:
    """Sample deviation over up to n rows, times the root of ``annualize`` if given."""
    out = F.stddev_samp(_col(col)).over(last_rows(n, w))
    return out * F.sqrt(F.lit(float(annualize))) if annualize else out


def rolling_max(col: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    return F.max(_col(col)).over(last_rows(n, w))


def rolling_min(col: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    return F.min(_col(col)).over(last_rows(n, w))


def slope_pct(ma: str | Column, k: int = 5, w: WindowSpec | None = None) -> Column:
    """Change of a moving average over k rows in percent; 0 where there is no row k before."""
    before = F.coalesce(F.lag(_col(ma), k).over(w or by_date()), _col(ma))
    return ratio(_col(ma) - before, before) * 100


def deviation_pct(col: str | Column, ma: str | Column) -> Column:
    return ratio(_col(col) - _col(ma), _col(ma)) * 100


def forward_return(k: int = 5, col: str | Column = "close_adj", w: WindowSpec | None = None) -> Column:
    """Return in percent from this row to the k-th after it; null near the end."""
    return ratio(F.lead(_col(col), k).over(w or by_date()) - _col(col), _col(col)) * 100


def trailing_max(col: str | Column, lo: int = 14, hi: int = 1, w: WindowSpec | None = None) -> Column:
    """Highest value of the rows lo to hi before this one."""
    return F.max(_col(col)).over((w or by_date()).rowsBetween(-lo, -hi))


def dist_from_high(n: int = 250, col: str | Column = "close_adj", w: WindowSpec | None = None) -> Column:
    high = rolling_max(col, n, w)
    return ratio(high - _col(col), high) * 100


def first_date() -> Column:
    return F.min("date").over(Window.partitionBy("symbol"))


def recency_rank() -> Column:
    """1 for the latest row of an instrument."""
    return F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))


def running_peak(col: str | Column, w: WindowSpec) -> Column:
    return F.max(_col(col)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def drawdown(col: str | Column, w: WindowSpec) -> Column:
    """Distance below the running peak, as a part of it (0 or negative)."""
    peak = running_peak(col, w)
    return ratio(_col(col) - peak, peak)


def pct_change0(col: str | Column, w: WindowSpec) -> Column:
    """Relative change on the row before; 0 on the first."""
    before = F.lag(_col(col)).over(w)
    return F.coalesce(ratio(_col(col) - before, before), F.lit(0.0))


def bull_aligned(columns: list[str]) -> Column:
    """Whether each average stands above the next longer one; less than 1e-9 is the rounding of sums."""
    out = F.lit(True)
    for short, long in zip(columns, columns[1:], strict=False):
        out = out & (F.col(short) - F.col(long) > 1e-9)
    return F.coalesce(out, F.lit(False))
