"""Sinks: appends, keyed replacements, views that only read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> DataFrame:
    """Append as Parquet; one row: success, counted while it is written. Tasks that fail are tried again by Spark and leave nothing behind."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("success")).write.mode("append").parquet(path)
    return df.sparkSession.createDataFrame([(seen.get["success"],)], "success long")


def replace(df: DataFrame, path: str) -> None:
    """Replace a table by a frame that doesn't read it."""
    df.write.mode("overwrite").parquet(path)


def read_only(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A temporary view, which can be read and not written."""
    df.createOrReplaceTempView(name)
    return spark.table(name)


def split_status(df: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """Rows to insert, and one row of counts: success, failed."""
    good = F.coalesce(valid, F.lit(False))
    return df.where(good), df.agg(F.count_if(good).alias("success"), F.count_if(~good).alias("failed"))
