"""Table-generating functions that cut texts up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, words


def word_chunks(df: DataFrame, text: str = "text", size: int = 500, at_least: int | None = None) -> DataFrame:
    """Adds chunk (from 0) and content: successive groups of ``size`` words, joined by blanks.

    Texts without words give no rows; with ``at_least``, only chunks whose stripped length exceeds it stay.
    """
    w = F.col("_words")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - 1), F.lit(size)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))
    out = df.withColumn("_words", words(F.col(text))).where(F.size("_words") > 0).select(*df.columns, F.posexplode(parts).alias("chunk", "content"))
    return out if at_least is None else out.where(F.length(strip(F.col("content"))) > at_least)


def char_windows(df: DataFrame, text: str = "text", size: int = 6000, stride: int = 5500) -> DataFrame:
    """Adds window (from 0) and content: ``size`` characters from every ``stride``-th; the last may lie within its predecessor. Empty texts give no rows."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(stride))
    parts = F.transform(starts, lambda i: F.substring(F.col(text), i + 1, F.lit(size)))
    return df.where(F.length(text) > 0).select(*df.columns, F.posexplode(parts).alias("window", "content"))


def tail(c: Column, n: int = 3000) -> Column:
    """The last n characters."""
    return F.right(c, F.lit(n))


def first_of_prefix(df: DataFrame, text: str = "question", order: str = "id", n: int = 50) -> DataFrame:
    """Of rows whose texts begin with the same n characters, the first by ``order``.

    The first is found by a minimum, which is combined before the shuffle, and not by a window over a prefix that
    many rows may share.
    """
    prefix = F.substring(F.coalesce(F.col(text), F.lit("")), 1, n)
    firsts = df.groupBy(prefix.alias("_prefix")).agg(F.min(order).alias("_first"))
    out = df.join(firsts.select("_first"), F.col(order) == F.col("_first"), "left_semi")
    return out


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
