"""Which texts hold which terms, whatever the case: an equi-join on grams, where a nested loop would compare all pairs.

A term meets only the texts that hold its rarest gram (three signs, or the whole of a shorter term), and each such meeting is verified.
Gram counts, and with them the anchors, come from the texts at hand; texts and terms may both grow; what grows with the texts is merged, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import text_of

GRAM = 3


def grams(c: Column, size: Column | int) -> Column:
    """Distinct substrings of ``size`` signs; none of a shorter text."""
    n = F.lit(size) if isinstance(size, int) else size
    at = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when((n > 0) & (F.length(c) >= n), F.array_distinct(F.transform(at, lambda k: F.substring(c, k, n)))).otherwise(F.array().cast("array<string>"))


def matches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_, said_): lower-cased distinct ``terms`` (column term_) within lower-cased distinct ``texts`` (said_). Empty terms match nothing."""
    wanted = terms.where("term_ <> ''").select("term_", F.explode(grams(F.col("term_"), F.least(F.lit(GRAM), F.length("term_")))).alias("gram"))
    every = F.concat(*(grams(F.col("said_"), k) for k in range(1, GRAM + 1)))
    held = texts.select("said_", F.explode(every).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    count = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no text holds rules its term out
    least = wanted.join(count, "gram", "left").groupBy("term_").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return least.join(held.hint("merge"), "gram").where(F.contains("said_", F.col("term_"))).select("term_", "said_")


def contains_join(rows: DataFrame, text: Column | str, terms: DataFrame, term: Column | str) -> DataFrame:
    """``rows`` joined with ``terms`` wherever the lower-cased text holds the lower-cased term; all columns of both."""
    said, asked = rows.withColumn("said_", F.lower(text_of(text))), terms.withColumn("term_", F.lower(text_of(term)))
    pairs = matches(said.select("said_").distinct(), asked.select("term_").distinct())
    return said.hint("merge").join(pairs.hint("merge"), "said_").join(asked, "term_").drop("said_", "term_")
