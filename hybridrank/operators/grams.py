"""Finding the texts that contain a pattern, by an inverted index of its rarest gram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest grams that are looked up.
LONGEST = 3


def grams(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters of a text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: text.substr(i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def containing(patterns: DataFrame, pattern: str, texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(pattern, key, text)`` of every text that contains a pattern; empty patterns are in none.

    ``patterns`` holds different patterns, ``texts`` different texts with a
    short ``key``.  A pattern is looked up by the rarest of its grams, of
    ``LONGEST`` characters or of its own length, and must then occur whole; so
    nothing is lost, and frequent grams do not swell the join.  The index holds
    keys, not texts, and only the grams that some pattern has.
    """
    asked = patterns.select(F.col(pattern).alias("__p")).where("__p <> ''").distinct()
    asked = asked.select("__p", F.explode(_own(F.col("__p"))).alias("gram"))
    wanted = asked.select("gram").distinct()
    index = texts.select(F.col(key).alias("__k"), F.explode(F.concat(*[grams(F.col(text), n) for n in range(1, LONGEST + 1)])).alias("gram")).join(wanted, "gram", "left_semi")
    many = index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rare = asked.join(many, "gram", "left").groupBy("__p").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g")).select("__p", F.col("g.gram").alias("gram"))
    met = rare.join(index, "gram").select("__p", "__k")
    found = met.join(texts.select(F.col(key).alias("__k"), F.col(text).alias("__t")), "__k").where(F.col("__t").contains(F.col("__p")))
    return found.select(F.col("__p").alias(pattern), F.col("__k").alias(key), F.col("__t").alias(text))


def _own(pattern: Column) -> Column:
    """The grams a pattern is looked up by."""
    size, out = F.least(F.length(pattern), F.lit(LONGEST)), F.lit(None).cast("array<string>")
    for n in range(1, LONGEST + 1):
        out = F.when(size == n, grams(pattern, n)).otherwise(out)
    return out
