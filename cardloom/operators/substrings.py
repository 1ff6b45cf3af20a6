"""Which texts hold which needles, for many of both, by postings of character n-grams instead of all pairs.

A needle of three characters or more is looked up by the rarest of its trigrams, and the few texts that have it are
tested. A shorter needle is a gram itself, so the posting is the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, size: Column) -> Column:
    """Distinct substrings of so many characters; none for a shorter text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def substring_pairs(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Distinct ``text, needle`` where the text holds the needle, from ``texts (text)`` and ``needles (needle)``; case counts.

    Nulls are left out; the empty needle, whose one gram every text has, is in all. Repeats are looked at once.
    """
    held = texts.select("text").filter("text IS NOT NULL").distinct()
    asked = needles.select("needle").filter("needle IS NOT NULL").distinct().withColumn("size", F.least(F.length("needle"), F.lit(GRAM)))
    sizes = F.array(*[F.lit(k) for k in range(GRAM + 1)])
    postings = held.select("text", F.explode(sizes).alias("size")).join(F.broadcast(asked.select("size").distinct()), "size").select("text", F.explode(grams(F.col("text"), F.col("size"))).alias("gram"))
    common = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    parts = asked.select("needle", F.explode(grams(F.col("needle"), F.col("size"))).alias("gram")).join(common, "gram", "left")
    # a gram that no text has comes first, and finds nothing
    rarest = parts.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select("needle", "g.gram")
    return postings.join(rarest, "gram").filter(F.contains("text", F.col("needle"))).select("text", "needle")
