"""Mixing to target weights with soft domain membership.

A classifier learnt from the labelled table gives every document a posterior over
domains (words that tell the domains apart, and coarse document statistics, in a
multinomial logistic model). Every document then gets a nonnegative rate, how often it
is to be used, so that the expected tokens of each domain match their targets:
weighted least squares over the rates, solved by scaled projected gradient steps until
the targets are met or a duality gap proves that the bounds allow no more. A step needs two small aggregations over all
documents (sums over the domains); the rate of a document is a function of its posterior and the steps
so far.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import remove, scratch, small_batches, stored
from .quality import STATISTICS, statistics

DOMAINS = ("clean", "low", "toxic")
EDGES = ".,;:!?'\"()[]#$%&*|<>-_"
_SHARES = [k for k, name in enumerate(STATISTICS) if not name.startswith("log_") and not name.endswith("bytes")]


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain (0 clean, 1 low, 2 toxic) of labels (doc_id, quality, toxic); the worst of several labels counts."""
    toxic, quality = F.coalesce("toxic", F.lit(0)), F.coalesce("quality", F.lit(1))
    domain = F.when(toxic == 1, 2).when(quality == 0, 1).otherwise(0)
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull()))
    return known.groupBy("doc_id").agg(F.max(domain).alias("domain"))


def _marks(text: str | None) -> set[str]:
    """What the classifier may look at: the different words without the marks at their ends, and the statistics in steps of a tenth."""
    marks = {w.strip(EDGES) for w in set(text.lower().split())} if text else set()
    stats = statistics(text.encode() if text else None)
    marks.update(f"\x02{k}:{int(10 * stats[k] + 0.5)}" for k in _SHARES)
    return marks


@dataclass
class Classifier:
    place: dict[str, int]
    weights: np.ndarray  # marks x domains
    bias: np.ndarray

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        out = np.tile(self.bias, (len(texts), 1))
        for row, text in enumerate(texts):
            own = [self.place[m] for m in _marks(text) & self.place.keys()]
            if own:
                out[row] += self.weights[own].sum(0)
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)


def fit(rows: list[tuple[int, list[int]]], n_marks: int, domains: int, steps: int = 250, rate: float = 0.1, ridge: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic weights by full-batch Adam; rows: (domain, places of the marks that are there)."""
    weights, bias = np.zeros((n_marks, domains)), np.zeros(domains)
    if not rows:
        return weights, bias
    y = np.eye(domains)[[d for d, _ in rows]]
    lengths = np.array([len(m) + 1 for _, m in rows])
    flat = np.concatenate([[n_marks, *m] for _, m in rows]).astype(np.int64)  # place n_marks: the bias
    of, starts = np.repeat(np.arange(len(rows)), lengths), np.cumsum(lengths) - lengths
    w = np.zeros((n_marks + 1, domains))
    w[-1] = np.log(y.mean(0) + 1e-3)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    decay = np.full((n_marks + 1, 1), ridge / len(rows))
    decay[-1] = 0
    for t in range(1, steps + 1):
        z = np.add.reduceat(w[flat], starts, axis=0)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = ((p - y) / len(rows))[of]
        grad = np.stack([np.bincount(flat, error[:, k], n_marks + 1) for k in range(domains)], 1) + decay * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-10)
    return w[:-1], w[-1]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, most_marks: int = 2048, least_rows: int = 8) -> Classifier:
    """Learns from at most ``sample_rows`` labelled documents (those with the smallest hash of the id).

    The ``most_marks`` marks whose share differs most between one domain and the rest, in
    standard errors, are kept; a mark needs ``least_rows`` documents.
    """
    spark, domains = docs.sparkSession, len(DOMAINS)
    small_batches(spark)
    some = F.broadcast(domain_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))  # bounded by sample_rows
    sample = docs.select("doc_id", "text").join(some, "doc_id").select("domain", "text")

    def spread(batches):
        for batch in batches:
            for domain, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                marks = ["", *_marks(text)]
                yield pa.RecordBatch.from_arrays([pa.array([domain] * len(marks), pa.int32()), pa.array(marks, pa.string())], names=["domain", "mark"])

    counts = sample.mapInArrow(spread, "domain int, mark string").groupBy("mark").agg(*(F.count(F.when(F.col("domain") == k, 1)).alias(f"n{k}") for k in range(domains)))
    path = scratch(spark, "marks")
    counts = stored(counts, path)
    rows_of = counts.where("mark = ''").first()
    size = [rows_of[f"n{k}"] for k in range(domains)] if rows_of else [0] * domains
    total = sum(size)
    seen = reduce(lambda a, b: a + b, (F.col(f"n{k}") for k in range(domains)))

    def away(k: int) -> Column:
        inside, outside = size[k], total - size[k]
        if not inside or not outside:
            return F.lit(0.0)
        share = (seen + 0.5) / (total + 1.0)
        return F.abs(F.col(f"n{k}") / float(inside) - (seen - F.col(f"n{k}")) / float(outside)) / F.sqrt(share * F.abs(1 - share) * (1.0 / inside + 1.0 / outside) + 1e-12)

    telling = counts.where((F.col("mark") != "") & (seen >= least_rows)).withColumn("_z", F.greatest(*(away(k) for k in range(domains)))).where("_z > 3")
    place = {r["mark"]: k for k, r in enumerate(telling.orderBy(F.desc("_z"), "mark").limit(most_marks).collect())}
    remove(spark, path)

    def places(batches):
        for batch in batches:
            own = [sorted(place[m] for m in _marks(t) & place.keys()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["domain", "marks"])

    rows = sorted((r["domain"], r["marks"]) for r in sample.mapInArrow(places, "domain int, marks array<int>").collect())
    return Classifier(place, *fit(rows, len(place), domains))


def posteriors(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, tokens (white-space words) and p_<domain> of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            p = classifier.posteriors(texts)
            tokens = [len(t.split()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), *(pa.array(p[:, k], pa.float64()) for k in range(p.shape[1]))], names=["doc_id", "tokens", *(f"p_{d}" for d in DOMAINS)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


#: parts of a step that are tried at once
PARTS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)
#: multiples of the gradient step that are tried beside it
TIMES = (1.0, 8.0, 64.0, 512.0, 4096.0)
#: the bound of rates without one, for the duality gap alone
FAR = 100.0
STORE_EVERY = 6


def rates(soft: DataFrame, targets: dict[str, float], anchor: str = "clean", most: float | None = None, close: float = 1e-5, slack: float = 1e-3, most_steps: int = 200) -> tuple[DataFrame, list[dict[str, float]], float]:
    """Adds ``rate`` to (doc_id, tokens, p_<domain>...), and tells the expected share of each domain after each step and the residual.

    targets: the domains' weights. The anchor's expected tokens stay as they are, which sets
    the total. most: an upper bound for each rate, if any. Minimised is the sum over
    domains of (expected - target)^2 / mass, over rates from 0 to ``most``. A step moves a document by
    a combination of its posteriors and projects the rate into its bounds. Tried are parts of the step that
    the second derivatives over the documents free to move suggest, multiples of the gradient step, and the plain one, which
    can't overshoot because the posteriors of a document sum to one; the best one is taken. Ends when no
    domain is off by more than ``close`` of all tokens, or when the rates are optimal: the problem is convex, so
    the gradient times the way to the farthest rates that it favours bounds what any rates could gain (up to FAR where ``most``
    is None), and that gap is at most ``slack`` of the sum. If neither holds after ``most_steps`` steps, or a step
    gains nothing that a double can tell, a warning tells the gap. The residual
    is the largest share by which a domain is off in the end. Documents without tokens keep rate 1, and a domain without mass is left out.
    """
    names = list(targets)
    t = F.col("tokens").cast("double")
    mass_row = soft.agg(F.sum("tokens").alias("all"), *(F.sum(t * F.col(f"p_{d}")).alias(d) for d in names)).first()
    total = float(mass_row["all"] or 0)
    if not total or not mass_row[anchor]:
        return soft.withColumn("rate", F.lit(1.0)), [], 0.0
    mass = {d: mass_row[d] / total for d in names}
    wanted = {d: mass[anchor] * targets[d] / targets[anchor] for d in names}
    live = [d for d in names if mass[d] > 0]
    sums_to = lambda weights: reduce(lambda a, b: a + b, (F.col(f"p_{d}") * float(w) for d, w in zip(live, weights, strict=True)))
    inside = lambda x: F.greatest(F.lit(0.0), x if most is None else F.least(F.lit(float(most)), x))
    off_of = lambda now: np.array([now[d] - wanted[d] for d in live])
    scale = np.array([mass[d] for d in live])
    away = lambda off: float((off**2 / scale).sum())
    rate, now, told = F.lit(1.0), dict(mass), [dict(mass)]
    while abs(off_of(now)).max() > close:
        off, held, r = off_of(now), soft.withColumn("_now", rate), F.col("_now")
        down = sums_to(off / scale)
        free = ((r > 0) | (down < 0)) & (F.lit(True) if most is None else (r < most) | (down > 0))
        gain = F.sum(t * (down * r - F.least(F.lit(0.0), down * float(FAR if most is None else most)))).alias("gain")
        pairs = [(i, j) for i in range(len(live)) for j in range(i + 1)]
        row = held.agg(gain, *(F.sum(F.when(free, t * F.col(f"p_{live[i]}") * F.col(f"p_{live[j]}"))).alias(f"h{i}_{j}") for i, j in pairs)).first()
        gap = 2 * (row["gain"] or 0.0) / total / away(off)
        if gap <= slack:
            break
        second = np.zeros((len(live), len(live)))
        for i, j in pairs:
            second[i, j] = second[j, i] = (row[f"h{i}_{j}"] or 0.0) / total
        newton = np.linalg.lstsq(second + 1e-9 * np.eye(len(live)), off, rcond=None)[0]
        moves = [*(times * off / scale for times in TIMES), *(part * newton for part in PARTS)]
        tried = held.select("tokens", *(f"p_{d}" for d in live), *(inside(r - sums_to(move)).alias(f"r{k}") for k, move in enumerate(moves)))
        row = tried.agg(*(F.sum(t * F.col(f"p_{d}") * F.col(f"r{k}")).alias(f"{d}_{k}") for k in range(len(moves)) for d in live)).first()
        ends = [{d: (row[f"{d}_{k}"] or 0.0) / total for d in live} | {d: 0.0 for d in names if d not in live} for k in range(len(moves))]
        best = min(range(len(moves)), key=lambda k: away(off_of(ends[k])))
        if len(told) > most_steps or away(off_of(ends[best])) >= (1 - 1e-12) * away(off):
            warnings.warn(f"rates are not at their best after {len(told) - 1} steps: other rates could lower the sum by up to {gap:.2e} of itself", stacklevel=2)
            break
        rate, now = inside(rate - sums_to(moves[best])), ends[best]
        told.append(dict(now))
        if len(told) % STORE_EVERY == 0:  # keeps the expression short
            soft = stored(soft.withColumn("_rate", rate), scratch(soft.sparkSession, "rates"))
            rate = F.col("_rate")
    return soft.withColumn("rate", F.when(F.col("tokens") > 0, rate).otherwise(F.lit(1.0))).drop("_rate"), told, float(abs(off_of(now)).max())


def uniform(*key) -> Column:
    """A fixed number from 0 to 1 for a key."""
    return F.pmod(F.xxhash64(F.lit("mixing"), *key), F.lit(1 << 30)) / float(1 << 30)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], anchor: str = "clean", most: float | None = None, sample_rows: int = 12_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens, p_<domain>, rate, copies and residual.

    copies is the rate rounded up or down by a fixed number of the row, so that the
    expected copies equal the rate. residual is one number for all rows: the largest share of all
    tokens by which a domain's expected tokens miss their target in the end (above 1e-5 only if the
    bounds on the rates leave no better ones, which the duality gap proves). Null and empty texts have no tokens, rate 1 and one copy.
    Repeated rows get equal answers; other columns are ignored; an empty table gives no
    rows; without labels every rate is 1.
    """
    spark = docs.sparkSession
    classifier = train(docs, labels, sample_rows)
    soft = stored(posteriors(docs, classifier), scratch(spark, "posteriors"))
    if not classifier.place:
        out, residual = soft.withColumn("rate", F.lit(1.0)), None
    else:
        out, _, residual = rates(soft, targets, anchor, most)
    return out.withColumn("residual", F.lit(residual).cast("double")).withColumn("copies", F.floor(F.col("rate") + uniform("doc_id")))

