"""Vector search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays as doubles; null where a length is 0 or the sizes differ."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    double = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = total(F.zip_with(double(a), double(b), lambda x, y: x * y))
    norm = lambda x: F.sqrt(total(F.transform(double(x), lambda v: v * v)))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot, norm(a) * norm(b)))


def top_k(df: DataFrame, query: Sequence[float], k: int = 3, at_least: float = 0.5, embedding: str = "embedding", id: str = "id") -> DataFrame:
    """The k rows most similar to the query whose similarity exceeds ``at_least``; id breaks ties. A top-k, so each task sends k rows."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn("similarity", F.round(cosine(F.col(embedding), vector), 6)).where(F.col("similarity") > at_least)
    return scored.orderBy(F.col("similarity").desc(), id).limit(k)


def context(found: DataFrame, *parts: str) -> DataFrame:
    """One row: a line for each hit, in order of rank, with a blank line between."""
    line = F.concat_ws(" ", *[F.col(p).cast("string") for p in parts])
    rows = found.withColumn("line", line)
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("r"), F.col("line")))), lambda x: x["line"]), "\n\n").alias("context"))
