"""Quality scores by histogram gradient-boosted trees over document statistics.

Each text is reduced to a row of statistics by numpy inside the tasks. The trees are
fitted on a bounded sample of labelled rows (``sample_rows``, those whose ids have
the smallest hash): statistics are cut into at most 64 bins, and a node's split is
found from histograms of gradients. The fitted trees are flattened into arrays of
one shape, and scoring walks all rows through a tree level by level with numpy.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

STATISTICS = (
    "log_bytes", "letters", "upper", "digits", "spaces", "newlines", "marks", "symbols", "bangs", "other_bytes",
    "log_words", "word_bytes", "distinct_words", "top_word", "log_lines", "line_bytes", "distinct_lines", "short_lines",
    "bare_words", "loud_words", "symbol_words",
)

_KIND = np.full(256, 8, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:?'\"-()", b"#$%&*|<>@^~=+_\\/[]{}`", b"!")):
    _KIND[np.frombuffer(_chars, np.uint8)] = _k


def statistics(text: bytes | None) -> list[float]:
    """The STATISTICS of one text; a null or empty one has zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    size = len(text)
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=9) / size
    words = text.split()
    lines = text.split(b"\n")
    count = Counter(words)
    n = max(len(words), 1)
    bare = loud = symbol = 0
    for word, times in count.items():
        if word.isalpha():
            bare += times
        if len(word) > 1 and word.isupper():
            loud += times
        if word[-1] in b"#$%&*|!" or word[0] in b"#$%&*|":
            symbol += times
    return [
        np.log1p(size), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8],
        np.log1p(len(words)), sum(map(len, words)) / n, len(count) / n, max(count.values(), default=0) / n,
        np.log1p(len(lines)), size / len(lines), len(set(lines)) / len(lines), sum(len(x) < 24 for x in lines) / len(lines),
        bare / n, loud / n, symbol / n,
    ]


@dataclass
class Trees:
    """Flattened trees of one depth: a node's children stand at 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; values at or below go left
    leaf: np.ndarray  # trees x leaves
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 8) -> Trees:
    """Boosts ``trees`` trees on the logistic loss; a node that can't be split sends all rows left."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], 1) if n else np.zeros((0, width), np.int64)
    share = (y.sum() + 1) / (n + 2)
    inner = 2**depth - 1
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log(share / (1 - share))))
    raw = np.full(n, out.base)
    flat = binned + np.arange(width) * bins
    for t in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (nodes, width, bins)
            g, h, c = (np.bincount(key, np.repeat(w, width), nodes * width * bins).reshape(shape).cumsum(2) for w in (grad, hess, np.ones(n)))
            total_g, total_h, total_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
            gain[(c < least) | (total_c - c < least)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    out.feature[t, first + k], out.cut[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t][node]] > out.cut[t][node])
        leaves = inner + 1
        g, h = np.bincount(node - inner, grad, leaves), np.bincount(node - inner, hess, leaves)
        out.leaf[t] = rate * g / (h + ridge)
        raw += out.leaf[t][node - inner]
    return out


def _rows(batches):
    for batch in batches:
        x = np.array([statistics(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
        yield batch.column(0), x


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, **params) -> Trees:
    """Trees from the documents that ``labels`` (doc_id, quality) marks, at most ``sample_rows`` of them.

    Rows of labels without a quality are left out, and of two labels of one document
    the lower counts. With no labelled document every score is one half.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))  # bounded by sample_rows

    def run(batches):
        for quality, x in _rows(batches):
            yield pa.RecordBatch.from_arrays([quality, pa.array(x.tolist(), pa.list_(pa.float64()))], names=["quality", "x"])

    rows = docs.select("doc_id", "text").join(some, "doc_id").select(F.col("quality").cast("double").alias("quality"), "text").mapInArrow(run, "quality double, x array<double>").collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(STATISTICS))
    y = np.array([r["quality"] for r in rows], np.float64)
    order = np.lexsort(x.T) if len(x) else np.zeros(0, np.int64)  # rows come in any order; sums don't
    return fit(x[order], y[order], **params)


def score(docs: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1, higher is better) and predicted of every row; only the text is looked at.

    Null and empty texts have zeros as statistics and are scored like any other. Repeated
    rows get equal scores; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for ids, x in _rows(batches):
            p = trees.scores(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``threshold``."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(trees.scores(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
