"""Groups of spelling variants by pivotal bigrams.

Words are counted per task and summed. A word's bigrams are ordered by how many words have them, rare ones
first; its prefix is the first three, and with them all that are as common as the third. Of the prefix two
disjoint bigrams of least summed frequency are its pivots, found by dynamic programming. One edit
breaks at most one of two disjoint bigrams, so of two near words the one whose prefix ends earlier
has a pivot that stands in the other's prefix, moved by one place at most.

Pivots meet prefixes in one join. Position limits are part of its key: an edit lies to one side of a pivot that it
leaves alone, so all that stands to the other side is equal, and so is one half of the side with the edit,
counted in the shorter word. Keys are hashes of pivot, equal side and half; so a bigram that very many words share
makes no large group of candidates. Survivors are verified by their edit distance within the join, so no pairs but
near ones leave it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import scratch, small_batches, stored

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: bigrams that one edit can break, and one more
PREFIX = 3
#: different words that a task holds before it passes them on
HELD_WORDS = 200_000
FLUSH_ROWS = 200_000


def runs(text: str | None) -> Counter:
    """The maximal runs of letters in lower case (A to Z alone are lowered) and how often each occurs."""
    return Counter(RUN.findall(text.encode().lower().decode())) if text else Counter()


def without_letter(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, typo_every: int | None = None) -> DataFrame:
    """word and n: the runs of letters A to Z and U+00C0 to U+00FF of whole texts, with A to Z in lower case.

    Kept are words of ``least_letters`` code points that occur ``least_count`` times in all texts. typo_every: of a run
    for which it divides h, the crc32 of ``<doc_id>:<run>``, the letter at h modulo the run's length is taken out (a test of
    the grouping; a null id is empty there). Null texts have no words; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = runs(text)
                if typo_every is not None:
                    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                    for word in [w for w in own if zlib.crc32(w.encode(), start) % typo_every == 0]:
                        held[without_letter(word, zlib.crc32(word.encode(), start))] += own.pop(word)
                held.update(own)
                if len(held) > HELD_WORDS:
                    yield flush()
                    held.clear()
        yield flush()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    long_enough = counted.where(F.length("word") >= least_letters)  # before the shuffle
    return long_enough.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def pivots(prefix: list[tuple[int, int]]) -> tuple[int, int]:
    """Two disjoint bigrams of least summed frequency; prefix: (place, frequency) in order of place."""
    cheapest: list[tuple[int, int]] = []  # (frequency, place) of the cheapest single bigram among the first k + 1
    best: tuple[int, int, int] | None = None
    at = 0
    for place, frequency in prefix:
        while at < len(prefix) and prefix[at][0] <= place - 2:  # those that end before this one starts
            own = (prefix[at][1], prefix[at][0])
            cheapest.append(min(own, cheapest[-1]) if cheapest else own)
            at += 1
        if cheapest:
            pair = (cheapest[-1][0] + frequency, cheapest[-1][1], place)
            best = pair if best is None else min(best, pair)
    return best[1], best[2]


def prefix_of(word: str, frequency: dict[str, int]) -> list[tuple[int, int]]:
    """(place, frequency) of the prefix bigrams in order of place; the order of bigrams is (frequency, bigram)."""
    ranked = sorted((frequency[word[k : k + 2]], word[k : k + 2], k) for k in range(len(word) - 1))
    last = ranked[min(PREFIX, len(ranked)) - 1][:2]
    return sorted((k, f) for f, g, k in ranked if (f, g) <= last)


def keys(word: str, place: int) -> Iterator[int]:
    """Hashes of the bigram at ``place`` with all that stands to one side and one half of the rest, for rests of this length and of one less."""
    for side, kept, rest in ((0, word[: place + 2], word[place + 2 :]), (1, word[place:], word[:place])):
        for shorter in {len(rest), max(len(rest) - 1, 0)}:
            half = shorter // 2
            for part, text in ((0, rest[:half]), (1, rest[len(rest) - (shorter - half) :])):
                yield xxhash.xxh3_64_intdigest(f"{side}{part}{shorter} {kept} {text}".encode()) - (1 << 63)


def _keyed(frequency: dict[str, int], is_pivot: bool):
    schema = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = prefix_of(word, frequency)
                own = {k for place in (pivots(prefix) if is_pivot else (p for p, _ in prefix)) for k in keys(word, place)}
                for column, values in zip(out, (own, [word] * len(own), [n] * len(own)), strict=True):
                    column.extend(values)
                if len(out[0]) > FLUSH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def near_words(words: DataFrame) -> DataFrame:
    """word, near, n and near_n: all ordered pairs of words (at least five letters) of edit distance one.

    The bigrams' frequencies (at most one row a pair of letters, 8,100 for this alphabet) go to the tasks. Keys and words meet in
    a merge join: a word has dozens of keys, which Spark doesn't see when it sizes a side for a broadcast.
    """
    bigrams = words.select(F.explode(F.array_distinct(F.expr("transform(sequence(1, length(word) - 1), k -> substring(word, k, 2))"))).alias("bigram"))
    frequency = {r["bigram"]: r["n"] for r in bigrams.groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = words.select("word", "n")
    asks = rows.mapInArrow(_keyed(frequency, True), "key long, word string, n long")
    index = rows.mapInArrow(_keyed(frequency, False), "_key long, near string, near_n long")
    is_near = (F.col("key") == F.col("_key")) & (F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    met = asks.join(index.hint("merge"), is_near)
    both = met.select(F.explode(F.array(F.struct("word", "near", "n", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("near_n").alias("n"), F.col("n").alias("near_n")))).alias("p")).select("p.*")
    return both.distinct()


def roots(forms: DataFrame, most_count: int, path: str) -> DataFrame:
    """word and root of words that have a form, by doubling the steps: a pointer skips to where its target's pointer stands.

    A form occurs twice as often as its word, so a chain has at most log2(most_count) steps, and the rounds are the logarithm
    of that. Each round is written.
    """
    pointers = forms.select("word", F.col("form").alias("root"))
    for nth in range(max(most_count.bit_length(), 1).bit_length()):
        pointers = stored(pointers, f"{path}-{nth}")
        onward = pointers.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        pointers = pointers.join(onward.hint("merge"), F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"))
    return pointers


def group(words: DataFrame) -> DataFrame:
    """One row per row of ``words`` (word, n; words are distinct and have five letters or more): word, form, root, n, n_near and form_n.

    Near words differ by one inserted, deleted or replaced code point. A word's form is the near word of largest n
    (ties: the smallest in code-point order), if it occurs twice as often as the word or more; else null. The root is
    where the chain of forms ends, the word itself if it has none. Shorter words are refused, since
    they may lack two disjoint bigrams in three. An empty table gives no rows.
    """
    spark = words.sparkSession
    small_batches(spark, 4096)
    path = scratch(spark, "spelling")
    words = stored(words.select("word", "n"), f"{path}/words")
    size = words.agg(F.max("n").alias("n"), F.min(F.length("word")).alias("letters")).first()
    if size["letters"] is not None and size["letters"] < LEAST_LETTERS:
        raise ValueError(f"words have at least {LEAST_LETTERS} letters here")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"), F.first("n").alias("n"))
    is_form = -F.col("best.less") >= 2 * F.col("n")
    near = stored(best.select(F.col("word").alias("_word"), "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), f"{path}/near")
    ends = roots(near.where(F.col("form").isNotNull()).select(F.col("_word").alias("word"), "form"), size["n"] or 1, f"{path}/roots").select(F.col("word").alias("_end"), "root")
    return (
        words.join(near.hint("merge"), F.col("word") == F.col("_word"), "left").join(ends.hint("merge"), F.col("word") == F.col("_end"), "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


def variants(docs: DataFrame, typo_every: int | None = None) -> DataFrame:
    """The groups of the words of ``docs``: ``group`` of ``count_words``."""
    return group(count_words(docs, typo_every=typo_every))
