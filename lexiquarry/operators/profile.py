"""Counts, histograms and grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scoring import half_up
from ..functions.text import blank, local_date


def gaps(df: DataFrame) -> DataFrame:
    """One row over active rows: total, missing_answer, missing_chapter (null or empty)."""
    return df.where("is_active").agg(F.count("*").alias("total"), F.count_if(blank(F.col("correct_answer"))).alias("missing_answer"), F.count_if(blank(F.col("chapter"))).alias("missing_chapter"))


def presence(df: DataFrame, *columns: str) -> DataFrame:
    """One row: how often each column is neither null nor empty."""
    return df.agg(*[F.count_if(F.coalesce(F.col(c) != "", F.lit(False))).alias(f"has_{c}") for c in columns])


def counts(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Rows by trimmed value, in order of it; null and blank values are left out."""
    rows = df if where is None else df.where(where)
    return rows.select(F.trim(column).alias(column)).where(F.col(column) != "").groupBy(column).agg(F.count("*").alias("count")).orderBy(column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.trim(column).alias(column)).where(F.col(column) != "").distinct().orderBy(column)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows by trimmed value; null, empty and blank values are one, ''."""
    return df.groupBy(F.trim(F.coalesce(F.col(column), F.lit(""))).alias(column)).agg(F.count("*").alias("count"))


def upload_history(df: DataFrame, file: str = "source_pdf_filename", subject: str = "subject", time: str = "created_at") -> DataFrame:
    """By file: its distinct non-blank subjects in order, rows, first and last time; the newest first. Blank file names are left out."""
    subjects = F.array_sort(F.collect_set(F.when(F.trim(subject) != "", F.col(subject))))
    grouped = df.where(F.col(file) != "").groupBy(file).agg(F.array_join(subjects, ",").alias("subjects"), F.count("*").alias("count"), F.min(time).alias("first_upload"), F.max(time).alias("last_upload"))
    return grouped.orderBy(F.col("last_upload").desc_nulls_last(), file)


def scoreboard(df: DataFrame, key: str = "user_id", score: str = "score", time: str = "created_at", tie: str = "id") -> DataFrame:
    """By key: tests, best, mean (halves up), change between the newest and the oldest score (0 for one test)."""
    when = F.struct(F.col(time), F.col(tie))
    return df.groupBy(key).agg(
        F.count("*").alias("tests"),
        F.max(score).alias("best"),
        half_up(F.avg(score)).alias("mean"),
        (F.max_by(score, when) - F.min_by(score, when)).alias("change"),
    )


def tally(df: DataFrame, status: str, *values: str) -> DataFrame:
    """One row: how many rows have each status."""
    return df.agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])


def daily_usage(log: DataFrame, key: str, time: str, tokens: str) -> DataFrame:
    """Tokens by key and date at +05:30; entries of no tokens or fewer count nothing."""
    return log.where(F.col(tokens) > 0).groupBy(key, local_date(F.col(time)).alias("usage_date")).agg(F.sum(tokens).alias("tokens_used"))


def budget(usage: DataFrame, plans: DataFrame | None, key: str, limit: int = fixed.FREE_TOKENS) -> DataFrame:
    """Adds blocked and left: usage at the limit or beyond blocks. Keys with a plan other than 'free' are exempt."""
    rows = usage if plans is None else usage.join(plans.select(key, "plan"), key, "left")
    exempt = F.lit(False) if plans is None else F.coalesce(F.col("plan"), F.lit("free")) != "free"
    out = rows.withColumn("blocked", ~exempt & (F.col("tokens_used") >= limit))
    return out.withColumn("left", F.when(~exempt, F.greatest(F.lit(0).cast("long"), limit - F.col("tokens_used").cast("long")))).drop("plan")
