"""Historical pattern similarity: sliding windows, a coarse distance, time warping, and what came after."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I  # noqa: E741
from ..sources.shared import on_workers
from .universe import valid_prices

SIZE, FUTURE, GAP = 30, 20, 10


def minmax(arr: Column) -> Column:
    """An array scaled to 0..1; a flat one becomes zeros."""
    low, span = F.array_min(arr), F.array_max(arr) - F.array_min(arr)
    return F.transform(arr, lambda x: (x - low) / F.coalesce(F.nullif(span, F.lit(0.0)), F.lit(1.0)))


def windows(bars: DataFrame, size: int = SIZE, future: int = FUTURE, gap: int = GAP) -> DataFrame:
    """source, start_idx, start_date, end_date, prices (size + future closes) and pattern (the first ``size``, scaled).

    Bars without an adjusted close or a volume are passed over. A window starts at every bar that has size +
    future + gap bars or more after it.
    """
    w = I.by_date()
    rows = valid_prices(bars).select("symbol", "date", "close_adj").withColumns(
        {
            "start_idx": F.row_number().over(w) - 1,
            "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol")),
            "prices": F.collect_list("close_adj").over(w.rowsBetween(0, size + future - 1)),
            "end_date": F.lead("date", size - 1).over(w),
        }
    )
    kept = rows.where(F.col("start_idx") < F.col("_n") - size - future - gap)
    return kept.select(F.col("symbol").alias("source"), "start_idx", F.col("date").alias("start_date"), "end_date", "prices", minmax(F.slice("prices", 1, size)).alias("pattern"))


def targets(bars: DataFrame, symbols: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """target, start_price and target_pattern of the last ``size`` valid bars of the instruments (all, or those named) that have so many."""
    own = valid_prices(bars if symbols is None else bars.where(F.col("symbol").isin(symbols)))
    last = own.withColumn("_rn", I.recency_rank()).where(F.col("_rn") <= size)
    listed = last.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close_adj"))), lambda x: x["close_adj"]).alias("_p")).where(F.size("_p") == size)
    return listed.select(F.col("symbol").alias("target"), F.element_at("_p", 1).alias("start_price"), minmax(F.col("_p")).alias("target_pattern"))


class _Best:
    """The k smallest distances of each target so far, with all ties of the k-th."""

    def __init__(self, k: int):
        self.k, self.bound, self.held = k, np.inf, []

    def add(self, distance: np.ndarray, at: np.ndarray) -> None:
        near = distance <= self.bound
        if near.any():
            self.held.append((distance[near], at[near]))
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0), np.zeros(0, np.int64)
        distance, at = (np.concatenate(c) for c in zip(*self.held, strict=True))
        if len(distance) >= self.k:
            self.bound = np.partition(distance, self.k - 1)[self.k - 1]
            distance, at = distance[distance <= self.bound], at[distance <= self.bound]
        self.held = [(distance, at)]
        return distance, at


#: windows that meet the targets at once, the pairs of both whose bounds a task holds, and parts of a window whose means bound a distance
WINDOWS_AT_ONCE, PAIRS_AT_ONCE, PARTS = 8192, 1 << 21, 6
_FOUND = "target string, source string, start_idx int, l2 double"


def scaled_windows(prices: np.ndarray, size: int, n: int) -> np.ndarray:
    """The first n windows of ``size`` prices, each scaled to 0..1; a flat one becomes zeros."""
    rows = np.lib.stride_tricks.sliding_window_view(prices, size)[:n]
    low, span = rows.min(1, keepdims=True), np.ptp(rows, axis=1)[:, None]
    return (rows - low) / np.where(span > 0, span, 1.0)


def part_means(rows: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Means of the parts of each row, times the root of a part's length over the row's: their Euclidean distance bounds the root mean square from below."""
    size = rows.shape[1]
    edges = np.linspace(0, size, min(parts, size) + 1).astype(int)
    lengths = np.diff(edges)
    return np.add.reduceat(rows, edges[:-1], axis=1) / lengths * np.sqrt(lengths / size)


class _Search:
    """Blocks of windows against all targets: bounds by one matrix product, distances for what the bounds leave.

    ``met`` and ``measured`` count pairs of target and window, and those whose distance was computed.
    """

    def __init__(self, patterns: np.ndarray, k: int):
        self.patterns, self.means, self.k = patterns, part_means(patterns), k
        self.squares = (self.means**2).sum(1)
        self.best = [_Best(k) for _ in patterns]
        self.met = self.measured = 0

    def distances(self, t: int, rows: np.ndarray) -> np.ndarray:
        self.measured += len(rows)
        return np.sqrt(((self.patterns[t] - rows) ** 2).sum(1) / rows.shape[1])

    def add(self, rows: np.ndarray, at: np.ndarray, asked: np.ndarray) -> None:
        """rows: scaled windows; at: their numbers; asked: the targets that look at them, so many at once that a task's memory doesn't follow their number."""
        means, step = part_means(rows), max(1, PAIRS_AT_ONCE // max(1, len(rows)))
        for first in range(0, len(asked), step):
            self._meet(rows, at, means, asked[first : first + step])

    def _meet(self, rows: np.ndarray, at: np.ndarray, means: np.ndarray, asked: np.ndarray) -> None:
        # squared distances of the part means, less what rounding may add to them
        bounds = self.squares[asked, None] + (means**2).sum(1) - 2 * (self.means[asked] @ means.T) - 1e-9
        self.met += bounds.size
        for t, own in zip(asked.tolist(), bounds, strict=True):
            best, seen = self.best[t], np.zeros(0, np.int64)
            if best.bound == np.inf and len(own) > self.k:  # the windows of least bound make a first one
                seen = np.argpartition(own, self.k - 1)[: self.k]
                best.add(self.distances(t, rows[seen]), at[seen])
                own[seen] = np.inf
            left = np.flatnonzero(own <= best.bound**2)
            left = left[np.isfinite(own[left])]
            if len(left):
                best.add(self.distances(t, rows[left]), at[left])


def _scan(names: list[str], patterns: np.ndarray, k: int, scope: str, index: str, size: int, future: int, gap: int):
    """The k nearest windows for each target among the instruments of a task: rows (symbol, close_adj) by instrument and date."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, sources = _Search(patterns, k), []
        every, place = np.arange(len(names)), {name: t for t, name in enumerate(names)}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if held:
                rows, at = (np.concatenate(c) for c in zip(*held, strict=True))
                held.clear()
                search.add(rows, at, every)

        def meet(source: str, prices: np.ndarray) -> None:
            n = len(prices) - size - future - gap
            if n <= 0 or not names or scope != "all" and source != index and source not in place:
                return
            rows, at = scaled_windows(prices, size, n), (len(sources) << 32) + np.arange(n)
            sources.append(source)
            if scope != "all" and source != index:
                return search.add(rows, at, np.array([place[source]]))
            held.append((rows, at))
            if sum(len(a) for _, a in held) >= WINDOWS_AT_ONCE:
                flush()

        now, parts = None, []
        for frame in frames:
            symbols, closes = frame["symbol"].to_numpy(), frame["close_adj"].to_numpy(float)
            cuts = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist(), len(symbols)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and symbols[a] != now:
                    if parts:
                        meet(now, np.concatenate(parts))
                    now, parts = symbols[a], []
                parts.append(closes[a:b])
        if parts:
            meet(now, np.concatenate(parts))
        flush()
        for name, own in zip(names, search.best, strict=True):
            distance, at = own.cut()
            yield pd.DataFrame({"target": [name] * len(at), "source": [sources[x] for x in (at >> 32).tolist()], "start_idx": (at & 0xFFFFFFFF).astype(np.int32), "l2": distance})

    return run


def nearest_l2(aims: DataFrame, bars: DataFrame, k: int = 150, scope: str = "all", index: str = "sh000001", at_once: int = 20_000, size: int = SIZE, future: int = FUTURE, gap: int = GAP) -> DataFrame:
    """The k windows of ``bars`` nearest to each target by root mean squared difference, with l2_rank, start_date, end_date, prices, pattern and the target's columns.

    scope: ``all`` windows, or ``own`` history plus one index. Targets are taken in blocks of about ``at_once`` (SIZE
    doubles each), which go to the tasks; a block reads the bars once. A task takes windows by thousands: one matrix
    product of part means bounds the distances to all targets from below, and only windows below a target's k-th
    distance so far are measured, so results are exact. It keeps k windows a target (and ties), which are all
    that is shuffled. Closes of the winners alone are fetched.
    """
    on_workers(bars.sparkSession)
    history = valid_prices(bars).select("symbol", "date", "close_adj")
    dealt = history.repartition("symbol").sortWithinPartitions("symbol", "date").select("symbol", "close_adj")
    blocks = max(1, -(-aims.count() // at_once))
    found = None
    for block in range(blocks):
        own = aims.where(F.pmod(F.xxhash64("target"), F.lit(blocks)) == block).select("target", "target_pattern").collect()
        names, patterns = [r["target"] for r in own], np.array([r["target_pattern"] for r in own], float).reshape(-1, size)
        one = dealt.mapInPandas(_scan(names, patterns, k, scope, index, size, future, gap), _FOUND)
        found = one if found is None else found.unionByName(one)
    nth = F.row_number().over(Window.partitionBy("target").orderBy("l2", "source", "start_idx"))
    near = found.withColumn("l2_rank", nth).where(F.col("l2_rank") <= k)
    targeted = near.join(aims.select(F.col("target").alias("_t"), "start_price", "target_pattern"), F.col("target") == F.col("_t")).drop("_t")
    return _with_prices(targeted, history, size, size + future)


def _with_prices(matches: DataFrame, history: DataFrame, size: int, length: int) -> DataFrame:
    """Adds prices (the closes of ``length`` bars from each match's first), pattern (the first ``size``, scaled), start_date and end_date."""
    # bars lie in blocks of ``length``, and a match asks the one or two that it touches: rows multiplied by ``length`` look
    # small to the planner, which would broadcast them through the driver
    block = lambda c: F.floor(c / length)
    wanted = matches.select(F.col("source").alias("_s"), F.col("start_idx").alias("_i")).distinct()
    asked = wanted.withColumn("_block", F.explode(F.sequence(block(F.col("_i")), block(F.col("_i") + length - 1))))
    rows = history.withColumn("_at", F.row_number().over(I.by_date()) - 1)
    listed = F.array_sort(F.collect_list(F.struct("_at", "close_adj", "date")))
    blocks = rows.groupBy("symbol", block(F.col("_at")).alias("_of")).agg(listed.alias("_rows"))
    met = asked.hint("merge").join(blocks, (F.col("_s") == F.col("symbol")) & (F.col("_block") == F.col("_of")))
    whole = met.groupBy("_s", "_i").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_rows"))), lambda x: x["_rows"])).alias("_rows"))
    cut = whole.withColumn("_rows", F.filter("_rows", lambda x: (x["_at"] >= F.col("_i")) & (x["_at"] < F.col("_i") + length)))
    own = cut.select("_s", "_i", F.transform("_rows", lambda x: x["close_adj"]).alias("prices"), F.element_at("_rows", 1)["date"].alias("start_date"), F.element_at("_rows", size)["date"].alias("end_date"))
    joined = matches.hint("merge").join(own, (F.col("source") == F.col("_s")) & (F.col("start_idx") == F.col("_i"))).drop("_s", "_i")
    return joined.withColumn("pattern", minmax(F.slice("prices", 1, size)))


def dtw_distances(a: np.ndarray, b: np.ndarray, band: int = 4) -> np.ndarray:
    """Time-warping distance of each row of ``a`` to the same row of ``b``: absolute differences, steps within a band.

    All rows move through the table together, one cell at a time.
    """
    rows, n = a.shape
    m = b.shape[1]
    band = max(band, abs(n - m))
    before = np.full((rows, m + 1), np.inf)
    before[:, 0] = 0.0
    for i in range(n):
        now = np.full((rows, m + 1), np.inf)
        for j in range(max(0, i - band), min(m, i + band + 1)):
            best = np.minimum(np.minimum(before[:, j + 1], now[:, j]), before[:, j])
            now[:, j + 1] = np.abs(a[:, i] - b[:, j]) + best
        before = now
    return before[:, m]


def dtw(a: str, b: str, band: int = 4) -> Column:
    """The time-warping distance of two array columns, in Arrow batches."""

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        return pd.Series(dtw_distances(np.stack(x.to_list()), np.stack(y.to_list()), band))

    return distance(F.col(a), F.col(b))


def non_overlapping(candidates: DataFrame, n: int = 5, max_overlap: int = 10, length: int = SIZE + FUTURE) -> DataFrame:
    """Per target, the best n by distance, skipping those that overlap a better one of their source by more than ``max_overlap`` bars."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dtw", "source", "start_idx"], kind="stable")
        chosen: list[tuple[str, int]] = []
        keep = []
        for at, (source, start) in enumerate(zip(rows["source"], rows["start_idx"], strict=True)):
            if all(s != source or length - abs(start - b) <= max_overlap for s, b in chosen):
                chosen.append((source, start))
                keep.append(at)
                if len(keep) == n:
                    break
        return rows.iloc[keep].assign(match=range(1, len(keep) + 1))[["target", "source", "start_idx", "match"]]

    picked = candidates.select("target", "source", "start_idx", "dtw").groupBy("target").applyInPandas(pick, "target string, source string, start_idx int, match int")
    renamed = picked.select(F.col("target").alias("_t"), F.col("source").alias("_s"), F.col("start_idx").alias("_i"), "match")
    return candidates.join(renamed, (F.col("target") == F.col("_t")) & (F.col("source") == F.col("_s")) & (F.col("start_idx") == F.col("_i"))).drop("_t", "_s", "_i")


def align_matches(matches: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds aligned (prices scaled to the target's first), sample_return (percent over the future part) and similarity."""
    first = F.element_at("prices", 1)
    base = F.when(first > 0, first).otherwise(F.lit(1.0))
    start, end = F.element_at("prices", size), F.element_at("prices", -1)
    return matches.withColumns(
        {
            "aligned": F.transform("prices", lambda p: F.col("start_price") * (p / base)),
            "sample_return": F.when(start > 0, (end - start) / F.nullif(start, F.lit(0.0)) * 100).otherwise(F.lit(0.0)),
            "similarity": F.greatest(F.lit(50.0), F.least(F.lit(99.5), 100 * (1 - F.col("dtw") / (size * 0.15)))),
        }
    )


def match_summary(matches: DataFrame) -> DataFrame:
    return matches.groupBy("target").agg(
        F.count(F.lit(1)).alias("matches"), (F.count_if(F.col("sample_return") > 0) * 100.0 / F.count(F.lit(1))).alias("win_rate"),
        F.avg("sample_return").alias("avg_return"), F.max("sample_return").alias("max_gain"), F.min("sample_return").alias("max_loss"),
    )


def similar_patterns(bars: DataFrame, aims: DataFrame, k: int = 150, n: int = 5, scope: str = "all") -> DataFrame:
    """The whole chain for the targets ``aims`` (see ``targets``)."""
    near = nearest_l2(aims, bars, k, scope)
    return align_matches(non_overlapping(near.withColumn("dtw", dtw("target_pattern", "pattern")), n))
