"""The newest rows of each key. Each window is by key, so no task holds more than a key's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _newest(key: str, time: str, tie: str):
    return Window.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc())


def newest(df: DataFrame, n: int, key: str = "user_id", time: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest n rows of each key, with their place ``rn``; the rank filter runs before the shuffle as well."""
    return df.withColumn("rn", F.row_number().over(_newest(key, time, tie))).where(F.col("rn") <= n)


def recent_mean(df: DataFrame, n: int = 5, key: str = "user_id", score: str = "score", **by: str) -> DataFrame:
    """By key: tests looked at, and the mean of their scores, as text without decimals."""
    return newest(df, n, key, **by).groupBy(key).agg(F.count("*").alias("tests"), F.format_string("%.0f", F.avg(score).cast("double")).alias("mean"))


def weak_topics(df: DataFrame, rows: int = 15, top: int = 3, key: str = "user_id", topic: str = "chapter", **by: str) -> DataFrame:
    """By key: the most frequent topics of the newest rows; at ties the one seen last comes first. Null and empty topics don't count."""
    counted = newest(df, rows, key, **by).where(F.col(topic) != "").groupBy(key, topic).agg(F.count("*").alias("count"), F.min("rn").alias("seen"))
    place = Window.partitionBy(key).orderBy(F.col("count").desc(), "seen")
    return counted.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top).drop("seen")


def ordinals(df: DataFrame, key: str = "user_id", time: str = "created_at", tie: str = "id") -> DataFrame:
    """Adds ``ordinal``: the place of each row from the oldest, starting with 1."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).asc_nulls_first(), F.col(tie).asc())))


def trend(df: DataFrame, last: int = 12, key: str = "user_id", score: str = "score", time: str = "created_at", tie: str = "id", point=None) -> DataFrame:
    """The newest ``last`` rows of each key from the oldest of them: index, n, labelled (every ceil(n / 6)-th), point.

    Keys of one row have no trend.
    """
    from ..functions.scoring import trend_point

    kept = newest(df, last, key, time, tie).withColumn("n", F.count("*").over(Window.partitionBy(key))).where("n >= 2")
    index = F.col("n") - F.col("rn")
    out: Column = (point or trend_point)(F.col(score), index, F.col("n"))
    return kept.withColumn("index", index).withColumn("labelled", index % F.ceil(F.col("n") / 6) == 0).withColumn("point", out).drop("rn")
