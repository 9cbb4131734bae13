"""Quality rules, with an isolation forest on their statistics for what no single rule catches.

Each text is reduced to the counts that rules look at. Two rules reject by themselves (too few words, too many words
in repeated windows). All other texts are judged by a forest of random trees: a tree splits a
small sample of good rows by random cuts of random statistics, and a text that such cuts part from
the others in few steps is unlike them. The mean path length over all trees becomes a score, and above a
threshold the text goes. Thresholds are calibrated on labelled rows, one a band of lengths, since short texts
scatter more: the best cut among those that cost no more than a given share of the good rows.

The forest and the thresholds are a few thousand numbers, fitted on all labelled rows. Statistics are computed
where texts are read; what meets the labels, and may be shuffled for that, is these 18 numbers a row and never a text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import remove, scratch, small_batches, stored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("log_words", "chars_a_word", "symbols_a_word", "dup_lines", "repeat_words", "upper", "digits", "bare_words", "closed_words", "bangs", "top_word", "log_words_a_line", "closed_lines")
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: upper ends of the bands of lengths (words); longer texts are the last band
BANDS = (40, 120, 400)

_SPACE, _SYMBOL, _UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), list(chars)) for chars in (b" \t\n\x0b\x0c\r", SYMBOLS, bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"))
_INSIDE = (np.arange(256) & 0xC0) == 0x80  # bytes after the first of a code point


def repeated(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more, the first ones included.

    Hashes tell first whether any window comes twice; only then are windows numbered, exactly, by pairs of numbers.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    own = ids[:n]
    for k in range(1, WINDOW):
        own = np.unique(own * len(number) + ids[k : k + n], return_inverse=True)[1]
    again = np.bincount(own)[own] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[WINDOW:] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The COUNTS and RATES of a text; a null or empty one has zeros."""
    if not text:
        return [0] * len(COUNTS), [0.0] * len(RATES)
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [line for line in text.split(b"\n") if line.strip()]
    n = len(words)
    chars = int(kinds.sum() - kinds[_INSIDE].sum() - kinds[_SPACE].sum())
    counts = [n, chars, int(kinds[_SYMBOL].sum()), len(lines) - len(set(lines)), repeated(words)]
    if not n:
        return counts, [0.0] * len(RATES)
    seen = Counter(words)
    letters = max(int(kinds[_UPPER].sum() + kinds[_LOWER].sum()), 1)
    bare = sum(times for word, times in seen.items() if not word.isalnum() and not any(b > 47 and (b < 58 or b > 64) for b in word))
    closed = sum(times for word, times in seen.items() if word[-1] in b".,;:?!")
    return counts, [
        np.log1p(n), chars / n, counts[2] / n, counts[3] / len(lines), counts[4] / n,
        kinds[_UPPER].sum() / letters, kinds[_DIGIT].sum() / max(chars, 1), bare / n, closed / n, kinds[33] / n, max(seen.values()) / n,
        np.log(n / len(lines)), sum(line.rstrip()[-1] in b".?!\"'" for line in lines) / len(lines),
    ]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def mean_path(n: np.ndarray | int) -> np.ndarray:
    """The mean path length in a random tree over n rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Flattened trees of one depth (children of k at 2k + 1 and 2k + 2) and a threshold a band of lengths."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; values at or below go left
    path: np.ndarray  # trees x leaves: steps, and what a leaf's rows would take on
    sample: int
    thresholds: list[float] = field(default_factory=lambda: [np.inf] * (len(BANDS) + 1))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; rows that are parted from the sample in few steps are near 1."""
        total, rows, inner = np.zeros(len(x)), np.arange(len(x)), self.feature.shape[1]
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += path[node - inner]
        return 2 ** -(total / max(len(self.feature), 1) / max(float(mean_path(self.sample)), 1e-9))

    def keeps(self, x: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return self.scores(x) <= np.array(self.thresholds)[np.searchsorted(BANDS, n_words)]


def fit(x: np.ndarray, trees: int = 150, sample: int = 256, seed: int = 12, drawn: list[np.ndarray] | None = None) -> Forest:
    """Random trees over random rows (of ``x``, or those that ``drawn`` has for each tree): a node's statistic and its cut between the least and the largest value there are random."""
    rng, sample = np.random.default_rng(seed), min(sample, len(x) if drawn is None else max(map(len, drawn), default=0))
    depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
    inner = 2**depth - 1
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), sample)
    if not sample:
        return out
    for t in range(trees):
        held = {0: x[rng.choice(len(x), sample, replace=False)] if drawn is None else drawn[t]}
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = held.pop(node, None)
                if rows is None:
                    continue
                low, high = rows.min(0), rows.max(0)
                open_ = np.flatnonzero(high > low)
                if len(rows) < 2 or not len(open_):  # a leaf: every way below leads to its path
                    first = (node + 1) * 2 ** (depth - level) - 1 - inner
                    out.path[t, first : first + 2 ** (depth - level)] = level + mean_path(len(rows))
                    continue
                f = int(rng.choice(open_))
                cut = min(rng.uniform(low[f], high[f]), np.nextafter(high[f], low[f]))
                out.feature[t, node], out.cut[t, node] = f, cut
                left = rows[:, f] <= cut
                held[2 * node + 1], held[2 * node + 2] = rows[left], rows[~left]
        for node, rows in held.items():
            out.path[t, node - inner] = depth + mean_path(len(rows))
    return out


def threshold(scores: np.ndarray, good: np.ndarray, most_lost: float, times: np.ndarray | None = None) -> float:
    """The score above which most bad rows for the good ones lost lie, losing ``most_lost`` of the good rows at most. times: rows that each score stands for."""
    if not good.any() or good.all():
        return np.inf
    times = np.ones(len(scores)) if times is None else times
    cuts, at = np.unique(scores, return_inverse=True)
    lost, caught = (1 - np.cumsum(np.bincount(at, times * own, len(cuts))) / (times * own).sum() for own in (good, ~good))
    worth = np.where(lost <= most_lost, caught - lost, -1)
    best = int(worth.argmax())
    if worth[best] <= 0:
        return np.inf
    above = cuts[best + 1] if best + 1 < len(cuts) else cuts[best] + 1e-3
    return float((cuts[best] + above) / 2)


def calibrate(forest: Forest, scores: np.ndarray, band: np.ndarray, good: np.ndarray, times: np.ndarray, most_lost: float = 0.01, least_good: int = 100, least_bad: int = 5) -> Forest:
    """Sets a threshold a band from scores that stand for ``times`` rows each; a band with fewer good or bad rows than that takes the threshold of all rows."""
    whole = threshold(scores, good, most_lost, times)
    for k in range(len(BANDS) + 1):
        own = band == k
        few = times[good & own].sum() < least_good or times[~good & own].sum() < least_bad
        forest.thresholds[k] = whole if few else threshold(scores[own], good[own], most_lost, times[own])
    return forest


#: scores are counted by so many bins of 1
SCORE_BINS = 100_000


def _rates(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(RATES))


def _tally(forest: Forest):
    def run(batches):
        for batch in batches:
            x = _rates(batch.column(2))
            bins = np.rint(forest.scores(x) * SCORE_BINS).astype(np.int64)
            band = np.searchsorted(BANDS, batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(band, pa.int64()), pa.array(bins, pa.int64()), pa.array(batch.column(0).to_numpy() > 0, pa.bool_())], names=["band", "bin", "good"])

    return run


def _measured(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    both = [statistics(t) for t in batch.column(name).cast(pa.binary()).to_pylist()]
    return np.array([c for c, _ in both], np.int64).reshape(-1, len(COUNTS)), np.array([r for _, r in both], float).reshape(-1, len(RATES))


MEASURED = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", x array<double>"


def measure(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the COUNTS and the RATES (x), for ``train_measured`` and ``judge_measured``."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            counts, rates = _measured(batch, "text")
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(rates) + 1) * len(RATES), pa.int32()), pa.array(rates.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts.T), x], names=["doc_id", *COUNTS, "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEASURED)


def train(docs: DataFrame, labels: DataFrame, trees: int = 150, sample: int = 256, **params) -> Forest:
    """``train_measured`` on the statistics of ``docs``."""
    return train_measured(measure(docs), labels, trees, sample, **params)


def train_measured(measured: DataFrame, labels: DataFrame, trees: int = 150, sample: int = 256, **params) -> Forest:
    """A forest over the good rows and its thresholds, from all labelled rows of ``measure``.

    Each tree draws its ``sample`` rows from all good ones, by a hash of the tree and the document; thresholds come from the scores of
    all labelled rows, counted by bins. labels: doc_id and quality; of two labels of one document the lower counts, rows without a
    quality are left out. Rows that a rule rejects anyway play no part. Without good and bad rows nothing is rejected by the forest.
    """
    spark = measured.sparkSession
    small_batches(spark)
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))

    base = scratch(spark, "rules")
    fine = measured.where(f"not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words)")
    rows = stored(fine.join(marked, "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "n_words", "x"), base)
    good = rows.where("quality > 0")
    share = min(1.0, 3 * sample / max(good.count(), 1))  # three times what a tree takes: trees * sample * 3 rows at most reach the driver, about
    dealt = good.select("x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "doc_id").withColumn("_u", F.xxhash64("doc_id", "tree"))
    drawn: list[list] = [[] for _ in range(trees)]
    for r in dealt.where(F.col("_u") < int(share * 2**64) - 2**63 if share < 1 else F.lit(True)).collect():
        drawn[r["tree"]].append((r["_u"], r["x"]))
    forest = fit(np.zeros((0, len(RATES))), trees, sample, drawn=[np.array([x for _, x in sorted(d)[:sample]], float).reshape(-1, len(RATES)) for d in drawn], **params)
    found = rows.select("quality", "n_words", "x").mapInArrow(_tally(forest), "band long, bin long, good boolean").groupBy("band", "bin", "good").count().collect()
    remove(spark, base)
    column = lambda name, kind: np.array([r[name] for r in found], kind)
    return calibrate(forest, column("bin", float) / SCORE_BINS, column("band", int), column("good", bool), column("count", float))


JUDGED = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"


def _judged(forest: Forest, counts: np.ndarray, rates: np.ndarray) -> list[pa.Array]:
    failed = np.array([base_failed(int(c[0]), int(c[-1])) for c in counts], bool)
    scores = forest.scores(rates)
    kept = ~failed & (scores <= np.array(forest.thresholds)[np.searchsorted(BANDS, counts[:, 0])])
    return [*(pa.array(counts[:, k], pa.int64()) for k in range(len(COUNTS))), pa.array(failed, pa.bool_()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())]


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """One row per row of ``docs``: doc_id, the COUNTS, base_failed, anomaly (the forest's score) and kept.

    A text of fewer than ten words, null and empty ones among them, or with over a fifth of its words in repeated windows of
    five fails; what the forest finds unlike the good rows isn't kept either. Repeated rows get equal answers;
    other columns are ignored; an empty table gives no rows.
    """
    return judge_measured(measure(docs), forest)


def judge_measured(measured: DataFrame, forest: Forest) -> DataFrame:
    """``judge`` for rows of ``measure``."""
    small_batches(measured.sparkSession)
    names = ["doc_id", *(c.split()[0] for c in JUDGED.split(", "))]

    def run(batches):
        for batch in batches:
            counts = np.column_stack([batch.column(1 + k).to_numpy() for k in range(len(COUNTS))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *_judged(forest, counts, _rates(batch.column(len(COUNTS) + 1)))], names=names)

    return measured.mapInArrow(run, f"doc_id long, {JUDGED}")


def keep(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield batch.filter(_judged(forest, *_measured(batch, "text"))[-1])

    return docs.mapInArrow(run, docs.schema)
