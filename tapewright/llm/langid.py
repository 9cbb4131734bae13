"""Language identification by interpolated Kneser-Ney character models.

Training counts the character n-grams of the words of every learning document
(each task counts words first, so a frequent word is cut into n-grams once), sums
them with one aggregation, and fits a model for each language. Words are padded,
so the model also learns how words begin and end.

Continuation counts, discounts, totals and back-offs are aggregations over all
n-grams. The probabilities are resolved for all languages at once and written to the
shared folder, from which each worker loads them into sorted arrays of n-gram hashes;
scoring looks the hashes of a text's n-grams up by binary
search, from the longest order down. The language with the lowest cross-entropy
per character wins. A scale fitted on all learning documents turns the entropies into a
probability, and their entropies also give each language a bound above which a text is flagged as rejected.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import remove, scratch, small_batches, stored

BEGIN, END = "\x02", "\x03"
LETTERS = re.compile(r"[^\W\d_]+")
FLUSH_WORDS = 200_000
UNDETERMINED = "und"
FLOOR = 1e-9


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters of a text."""
    return LETTERS.findall(text.lower()) if text else []


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


#: independent factors: with multiples of one number, n-grams of one weighted sum would share a hash
_ODD = np.random.default_rng(7).integers(0, 2**64, 8, np.uint64) | np.uint64(1)


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """A hash of the n-gram that ends at each place (those before place order - 1 are meaningless)."""
    out = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for back in range(order):
            out[back:] += (points[: len(points) - back] + np.uint64(7)) * _ODD[back]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


@dataclass
class Model:
    """Log-probabilities of each language in sorted hash arrays, one pair of arrays an order."""

    languages: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]  # [k - 1]: hashes of k-grams, log p (n x languages)
    contexts: list[tuple[np.ndarray, np.ndarray]]  # [k - 1]: hashes of contexts of k characters, log back-off
    floor: np.ndarray
    scale: float = 1.0
    bound: np.ndarray | None = None
    path: str | None = None  # where the tables lie, if grams and contexts are not here
    words: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def loaded(self) -> Model:
        """This model with its tables; 8 bytes a hash and 4 a language."""
        if self.path is None:
            return self
        from pyarrow import fs, parquet

        store, base = fs.FileSystem.from_uri(self.path)
        rows = parquet.read_table(base, filesystem=store).combine_chunks()
        size, is_context = rows["size"].to_numpy(), rows["is_context"].to_numpy()
        hashes = rows["hash"].to_numpy().view(np.uint64)
        values = (rows["v"].chunk(0).flatten().to_numpy() if len(rows) else np.zeros(0, np.float32)).reshape(len(rows), len(self.languages))

        def of(k: int, context: bool) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero((size == k) & (is_context == context))
            at = at[np.argsort(hashes[at], kind="stable")]
            return hashes[at], values[at]

        grams, contexts = [of(k, False) for k in range(1, self.order + 1)], [of(k, True) for k in range(1, self.order)]
        return replace(self, grams=grams, contexts=contexts, path=None)

    def gram_scores(self, points: np.ndarray) -> np.ndarray:
        """log p of the character at each place given those before it, for each language."""
        out = np.zeros((len(points), len(self.languages)), np.float32)
        left = np.arange(len(points))
        for order in range(self.order, 0, -1):
            keys, values = self.grams[order - 1]
            hashes = gram_hashes(points, order)[left]
            at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            found = keys[at] == hashes if len(keys) else np.zeros(len(left), bool)
            out[left[found]] += values[at[found]]
            left = left[~found]
            if not len(left):
                return out
            if order > 1:
                keys, values = self.contexts[order - 2]
                hashes = gram_hashes(points, order - 1)[left - 1]
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                found = keys[at] == hashes if len(keys) else np.zeros(len(left), bool)
                out[left[found]] += values[at[found]]
        out[left] += self.floor
        return out

    def entropies(self, texts: list[str | None], most: int = 300_000) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text for each language, and the texts' characters (0: no letter)."""
        own = [words_of(t) for t in texts]
        if self.scores is None or len(self.words) > most:
            self.words, self.scores = {}, np.zeros((0, len(self.languages) + 1), np.float32)
        new = list({w for words in own for w in words if w not in self.words})
        for low in range(0, len(new), 50_000):
            part = new[low : low + 50_000]
            pad = BEGIN * (self.order - 1)
            points = _code_points("".join(f"{pad}{w}{END}" for w in part))
            lengths = np.array([len(w) + self.order for w in part])
            ends = np.cumsum(lengths)
            logs = self.gram_scores(points)
            inside = np.ones(len(points), bool)
            for k in range(self.order - 1):
                inside[ends - lengths + k] = False
            logs[~inside] = 0
            sums = np.add.reduceat(logs, ends - lengths, axis=0)
            size = np.array([len(w) + 1 if any(map(str.isalpha, w)) else 0 for w in part], np.float32)
            self.words.update(zip(part, range(len(self.scores), len(self.scores) + len(part)), strict=True))
            self.scores = np.vstack([self.scores, np.hstack([sums, size[:, None]]).astype(np.float32)])
        counts = np.array([len(w) for w in own])
        total = np.zeros((len(texts), len(self.languages) + 1))
        if counts.sum():
            get = self.words.__getitem__
            flat = self.scores[np.fromiter((get(w) for words in own for w in words), np.int64, int(counts.sum()))].astype(np.float64)
            some = np.flatnonzero(counts)
            total[some] = np.add.reduceat(flat, (np.cumsum(counts) - counts)[some], axis=0)
        size = total[:, -1]
        return -total[:, :-1] / np.maximum(size, 1)[:, None], size

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, probability, cross-entropy and whether it is above the language's bound."""
        entropy, size = self.entropies(texts)
        best = entropy.argmin(axis=1)
        raw = np.exp(-np.clip((entropy - entropy.min(axis=1, keepdims=True)) * self.scale, 0, 700))
        score = raw[np.arange(len(best)), best] / raw.sum(axis=1)
        lowest = entropy[np.arange(len(best)), best]
        none = size == 0
        score[none] = 0.0
        rejected = none | (lowest > self.bound[best] if self.bound is not None else False)
        return [UNDETERMINED if n else self.languages[b] for b, n in zip(best, none, strict=True)], score, lowest, rejected


def _count(order: int):
    names = ["lang", "gram", "n"]
    types = [pa.string(), pa.string(), pa.int64()]

    def cut(held: dict[str, Counter]):
        for lang, words in held.items():
            grams: dict[str, int] = defaultdict(int)
            pad = BEGIN * (order - 1)
            for word, n in words.items():
                padded = f"{pad}{word}{END}"
                for at in range(len(word) + 1):
                    grams[padded[at : at + order]] += n
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([lang] * len(grams), list(grams), list(grams.values())), types, strict=True)], names=names)

    def run(batches):
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[lang].update(words_of(text))
            if sum(map(len, held.values())) > FLUSH_WORDS:
                yield from cut(held)
                held = defaultdict(Counter)
        yield from cut(held)

    return run


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs`` (lang, text)."""
    small_batches(docs.sparkSession)
    cut = docs.select("lang", "text").mapInArrow(_count(order), "lang string, gram string, n long")
    return cut.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: dict[str, int], order: int) -> tuple[list[dict[str, float]], list[dict[str, float]], float]:
    """Interpolated probabilities by order, back-off weights by context, and the floor, of one language.

    counts: how often each n-gram of length ``order`` occurs. Orders below count in how many
    different n-grams, one character longer, they end. Characters that were never seen share
    the floor with one more symbol than were seen. ``write_tables`` does the same for all
    languages by aggregations.
    """
    levels: list[dict[str, int]] = [{} for _ in range(order)]
    levels[order - 1] = counts
    for k in range(order - 1, 0, -1):
        lower: dict[str, int] = defaultdict(int)
        for gram in levels[k]:
            lower[gram[1:]] += 1
        levels[k - 1] = lower
    uniform = 1.0 / (len(levels[0]) + 1)
    probability: list[dict[str, float]] = []
    back_off: list[dict[str, float]] = []
    root = 1.0
    for k in range(1, order + 1):
        own = levels[k - 1]
        ones, twos = sum(n == 1 for n in own.values()), sum(n == 2 for n in own.values())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        total: dict[str, int] = defaultdict(int)
        kinds: dict[str, int] = defaultdict(int)
        for gram, n in own.items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        gamma = {c: discount * kinds[c] / total[c] for c in total}
        if k == 1:
            root = gamma.get("", 1.0)
            probability.append({g: (n - discount) / total[""] + root * uniform for g, n in own.items()})
        else:
            back_off.append(gamma)
            below = probability[-1]
            probability.append({g: (n - discount) / total[g[:-1]] + gamma[g[:-1]] * below[g[1:]] for g, n in own.items()})
    return probability, back_off, max(root * uniform, FLOOR)


def _hash_all(grams: list[str], order: int) -> np.ndarray:
    if not grams:
        return np.zeros(0, np.uint64)
    points = _code_points("".join(grams))
    return gram_hashes(points, order)[order - 1 :: order]


def resolve(models: dict[str, tuple], order: int) -> Model:
    """One table for all languages: an n-gram that any has seen gets the log p of each, backed off where need be."""
    languages = sorted(models)
    floor = np.log([models[x][2] for x in languages])

    def log_p(which: int, gram: str) -> float:
        probability, back_off, _ = models[languages[which]]
        out = 0.0
        while gram:
            k = len(gram)
            if gram in probability[k - 1]:
                return out + np.log(probability[k - 1][gram])
            if k > 1:
                out += np.log(back_off[k - 2].get(gram[:-1], 1.0))
            gram = gram[1:]
        return out + floor[which]

    grams, contexts = [], []
    for k in range(1, order + 1):
        seen = sorted({g for x in languages for g in models[x][0][k - 1]})
        hashes = _hash_all(seen, k)
        values = np.array([[log_p(i, g) for i in range(len(languages))] for g in seen], np.float32).reshape(len(seen), len(languages))
        by = np.argsort(hashes, kind="stable")
        grams.append((hashes[by], values[by]))
        if k < order:
            seen = sorted({c for x in languages for c in models[x][1][k - 1]})
            hashes = _hash_all(seen, k)
            values = np.log(np.array([[models[x][1][k - 1].get(c, 1.0) for x in languages] for c in seen], np.float64)).astype(np.float32).reshape(len(seen), len(languages))
            by = np.argsort(hashes, kind="stable")
            contexts.append((hashes[by], values[by]))
    return Model(languages, order, grams, contexts, floor.astype(np.float32))


def _hashed(batches):
    for batch in batches:
        size, text = batch.column(0).to_numpy(), np.array(batch.column(2).to_pylist(), object)
        hashes = np.zeros(len(size), np.uint64)
        for k in np.unique(size):
            hashes[size == k] = _hash_all(text[size == k].tolist(), int(k))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes.view(np.int64)), batch.column(3)], names=["size", "is_context", "hash", "v"])


def write_tables(counts: DataFrame, order: int) -> Model:
    """The model of all rows of ``counts`` (lang, gram, n), with its tables in the shared folder.

    Every step is an aggregation over the n-grams or a join of n-grams with their contexts or with
    the n-grams they end in; the driver sees a few numbers a language and order.
    """
    spark = counts.sparkSession
    base = scratch(spark, "langid")
    counts = stored(counts, f"{base}/tmp/counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return Model([], order, [], [], np.zeros(0, np.float32))
    each = range(len(languages))
    n, v, total, kinds = ([f"{c}{i}" for i in each] for c in ("n", "v", "t", "k"))
    seen = {order: stored(counts.groupBy("gram").agg(*(F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(n[i]) for i, x in enumerate(languages))), f"{base}/tmp/grams-{order}")}
    for k in range(order - 1, 0, -1):
        seen[k] = stored(seen[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(*(F.count_if(F.col(c) > 0).alias(c) for c in n)), f"{base}/tmp/grams-{k}")
    sums = lambda: [x for i in each for x in (F.sum(n[i]).alias(total[i]), F.count_if(F.col(n[i]) > 0).alias(kinds[i]))]

    parts, floor, below = [], [], None
    for k in range(1, order + 1):
        once = seen[k].agg(*sums(), *(F.count_if(F.col(n[i]) == times).alias(f"{name}{i}") for i in each for name, times in (("ones", 1), ("twos", 2)))).first()
        discount = [once[f"ones{i}"] / (once[f"ones{i}"] + 2 * once[f"twos{i}"]) if once[f"ones{i}"] and once[f"twos{i}"] else 0.5 for i in each]
        if k == 1:
            rest = [discount[i] * once[kinds[i]] / once[total[i]] / (once[kinds[i]] + 1) for i in each]
            floor = [float(np.log(max(r, FLOOR))) for r in rest]
            values = [F.when(F.col(n[i]) > 0, F.log((F.col(n[i]) - discount[i]) / float(once[total[i]]) + rest[i])).otherwise(F.lit(floor[i])) for i in each]
            now = seen[k].select("gram", *(x.alias(v[i]) for i, x in enumerate(values)))
        else:
            context = stored(seen[k].groupBy(F.substring("gram", 1, k - 1).alias("_context")).agg(*sums()), f"{base}/tmp/contexts-{k - 1}")
            gamma = [F.when(F.col(total[i]) > 0, discount[i] * F.col(kinds[i]) / F.col(total[i])) for i in each]
            back_off = [F.coalesce(F.log(g), F.lit(0.0)) for g in gamma]
            parts.append(context.select(F.lit(k - 1).alias("size"), F.lit(True).alias("is_context"), F.col("_context").alias("gram"), F.array(*(x.cast("float") for x in back_off)).alias("v")))
            lower = below.select(F.col("gram").alias("_below"), *v)
            met = seen[k].join(context, F.substring("gram", 1, k - 1) == F.col("_context")).join(lower, F.substring("gram", 2, k - 1) == F.col("_below"))
            # a language that has seen an n-gram has seen what it ends in, so there v is the log of its probability
            values = [F.when(F.col(n[i]) > 0, F.log((F.col(n[i]) - discount[i]) / F.col(total[i]) + gamma[i] * F.exp(v[i]))).otherwise(back_off[i] + F.col(v[i])) for i in each]
            now = met.select("gram", *(x.alias(v[i]) for i, x in enumerate(values)))
        below = stored(now, f"{base}/tmp/values-{k}")
        parts.append(below.select(F.lit(k).alias("size"), F.lit(False).alias("is_context"), "gram", F.array(*(F.col(c).cast("float") for c in v)).alias("v")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every.mapInArrow(_hashed, "size int, is_context boolean, hash long, v array<float>").write.parquet(f"{base}/tables")
    remove(spark, f"{base}/tmp")
    return Model(languages, order, [], [], np.array(floor, np.float32), path=f"{base}/tables")


#: scales that are tried, bins of an entropy of 1, and parts of a loss of 1 (whole numbers add up alike in any order)
SCALES = np.geomspace(0.5, 200, 60)
BINS, LOSS_PARTS = 4096, 10_000


def _tally(of_worker):
    """Per task: kind -1 has the summed loss of each scale (k), kind of a language its documents by bin of their own entropy (k)."""

    def run(batches):
        own, losses, bins = of_worker(), np.zeros(len(SCALES), np.int64), Counter()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            entropy, size = own.entropies(batch.column(1).to_pylist())
            some = np.flatnonzero(size > 0)
            if not len(some):
                continue
            right = np.array([own.languages.index(langs[i]) for i in some])
            entropy = entropy[some]
            z = -(entropy - entropy.min(axis=1, keepdims=True))
            for k, scale in enumerate(SCALES):
                lost = np.log(np.exp(z * scale).sum(axis=1)) - z[np.arange(len(some)), right] * scale
                losses[k] += int(np.rint(lost * LOSS_PARTS).astype(np.int64).sum())
            bins.update(zip(right.tolist(), np.floor(entropy[np.arange(len(some)), right] * BINS).astype(int).tolist(), strict=True))
        if bins:
            rows = [(-1, k, int(x)) for k, x in enumerate(losses)] + [(lang, k, n) for (lang, k), n in bins.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["kind", "k", "n"])

    return run


def calibrate(model: Model, docs: DataFrame, quantile: float = 0.999) -> Model:
    """Fits the scale by the likelihood of the languages of all rows of ``docs`` (lang, text), and the bound of each language by a quantile.

    Losses and bins of entropies are summed over all rows; the driver sees a number a scale and bin. A bound lies at most one bin (1 / BINS) above the quantile.
    """
    known = docs.where(F.col("lang").isin(model.languages))
    rows = known.mapInArrow(_tally(_in_worker(docs, model)), "kind long, k long, n long").groupBy("kind", "k").agg(F.sum("n").alias("n")).collect()
    if rows:
        losses = {r["k"]: r["n"] for r in rows if r["kind"] < 0}
        model.scale = float(min((losses[k], s) for k, s in enumerate(SCALES))[1])
        model.bound = np.full(len(model.languages), np.inf)
        for lang in range(len(model.languages)):
            counts = sorted((r["k"], r["n"]) for r in rows if r["kind"] == lang)
            if counts:
                upto = np.cumsum([n for _, n in counts])
                model.bound[lang] = (counts[int(np.searchsorted(upto, quantile * upto[-1]))][0] + 1) / BINS + 0.25
    return model


def train(docs: DataFrame, order: int = 4) -> Model:
    """A model from all n-grams of all rows of ``docs`` with a language and a text; all of them calibrate its scores too."""
    rows = docs.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = write_tables(gram_counts(rows, order), order)
    return calibrate(model, rows) if model.languages else model


_models: dict[int, Model] = {}


def _in_worker(docs: DataFrame, model: Model):
    """A function that gives a Python worker the model; its tables are loaded once."""
    packed = zlib.compress(pickle.dumps(model), 1)
    key = zlib.crc32(packed)
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # without tables, if they are in the shared folder

    def get() -> Model:
        if key not in _models:
            _models.clear()
            _models[key] = pickle.loads(zlib.decompress(shared.value)).loaded()
        return _models[key]

    return get


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, entropy and rejected of every row; only the text is looked at.

    A text that is null or has no letter is ``und`` with score 0 and counts as rejected; so
    does every text if nothing was learnt. Repeated rows get equal answers; other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    of_worker = _in_worker(docs, model)

    def run(batches):
        own = of_worker()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if own.languages:
                langs, score, entropy, rejected = own.predict(texts)
            else:
                langs, score, entropy, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")
