"""Views of the test tables as the tables of a question bank, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import table


def bank(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as questions: lang is the subject, source the chapter and file, labels the flags."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    quality, toxic = F.col("quality"), F.col("toxic")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("subject"),
        F.when(quality.isNull(), None).when(quality == 0, F.when(toxic == 1, "  ").otherwise("")).otherwise(F.concat(F.lit(" "), F.col("source"))).alias("chapter"),
        F.col("text").alias("question"),
        F.when(toxic == 1, "").when(toxic == 0, "a").alias("correct_answer"),
        (F.coalesce(quality, F.lit(1)) == 1).alias("is_active"),
        F.col("source").alias("source_pdf_filename"),
        F.when(F.col("n_chars") > 2000, F.concat(F.lit("img/"), F.col("source"), F.lit(".png"))).otherwise("").alias("diagram_url"),
        "n_chars",
    )


BANK = """bank AS (
  SELECT doc_id AS id, lang AS subject,
    CASE WHEN quality IS NULL THEN NULL WHEN quality = 0 THEN CASE WHEN toxic = 1 THEN '  ' ELSE '' END ELSE ' ' || source END AS chapter,
    text AS question, CASE WHEN toxic = 1 THEN '' WHEN toxic = 0 THEN 'a' END AS correct_answer,
    coalesce(quality, 1) = 1 AS is_active, source AS source_pdf_filename,
    CASE WHEN n_chars > 2000 THEN 'img/' || source || '.png' ELSE '' END AS diagram_url, n_chars
  FROM documents LEFT JOIN labels USING (doc_id))"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Events as test results: score 0 to 720, subject scores, chapter by event type."""
    e = table(spark, sf, "events")
    score = F.floor(F.col("value") * 10 % 721).cast("int")
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), score.alias("score"), F.col("event_type").alias("chapter"), F.col("value"), F.get_json_object("props", "$.k").cast("long").alias("k"))


RESULTS = """results AS (
  SELECT event_id AS id, user_id, ts AS created_at, floor(value * 10 % 721)::INTEGER AS score, event_type AS chapter, value,
    json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""
