"""Many search terms at once over names, by an inverted index of grams of one to three letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, lengths: tuple[int, ...]) -> Column:
    """The different grams of a text; one shorter than a length has none of it."""

    def of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda k: F.substr(text, k, F.lit(n)))
        return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, lengths)))


def postings(names: DataFrame) -> DataFrame:
    """gram, key and text: each name (key, text) under every gram of one to three letters that it holds, in lower case.

    To be written once (by gram) and searched often; a name of m letters has 3 m rows at most. Names without a text have none.
    """
    named = names.select("key", "text").distinct()
    return named.select(F.explode(_grams(F.lower("text"), tuple(range(1, GRAM + 1)))).alias("gram"), "key", "text")


def search_terms(terms: DataFrame, index: DataFrame) -> DataFrame:
    """term, key and text of all names that hold a term of ``terms`` (term), in any case.

    A term asks the postings of its rarest gram of three letters (a shorter term is a gram itself); names found there
    are verified as a whole. A gram that no name holds ends its terms' search. Empty and null terms find nothing.
    """
    own = terms.select("term").where(F.length("term") > 0).distinct()
    size = F.least(F.length("term"), F.lit(GRAM))
    asked = own.select("term", F.explode(_grams(F.lower("term"), tuple(range(1, GRAM + 1)))).alias("_gram")).where(F.length("_gram") == size)
    counts = index.groupBy(F.col("gram").alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    # a gram without names counts 0, so it is the rarest and meets no posting
    rated = asked.join(counts, F.col("_gram") == F.col("_g"), "left").groupBy("term").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_rarest"))
    met = rated.select("term", F.col("_rarest.gram").alias("_gram")).join(index, F.col("_gram") == F.col("gram"))
    return met.where(F.contains(F.lower("text"), F.lower("term"))).select("term", "key", "text")
