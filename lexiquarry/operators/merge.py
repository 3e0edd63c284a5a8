"""Changes to tables, as functions from frames to frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_of


def insert(table: DataFrame, rows: DataFrame, optional: Sequence[str] = ()) -> DataFrame:
    """The table with the rows added, all of them active; columns that they lack, or that are ``optional`` and blank, are null."""
    new = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in optional if c in rows.columns})
    if "is_active" in table.columns:
        new = new.withColumn("is_active", F.lit(True))
    return table.unionByName(new, allowMissingColumns=True).select(*table.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """For each key the row with the greatest ``order``; a new row wins ties. Found by a maximum, which combines before the shuffle."""
    rest = [c for c in table.columns if c not in keys]
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.select(*table.columns).withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max(F.struct(F.col(order), F.col("_new"), *[F.col(c).alias(f"_{c}") for c in rest])).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best._{c}").alias(c) for c in table.columns])


def patch(table: DataFrame, changes: DataFrame, id: str = "id", nullable: Sequence[str] = ()) -> DataFrame:
    """The table with non-null values of ``changes`` put in.

    A ``nullable`` column may also be set to null: where changes has a true ``set_<column>``, its value counts, null or not.
    """
    columns = [c for c in changes.columns if c != id and not c.startswith("set_")]
    named = changes.select(F.col(id), F.lit(True).alias("_found"), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != id])

    def value(c: str) -> Column:
        if c not in columns:
            return F.col(c)
        plain = F.coalesce(F.col(f"_{c}"), F.col(c))
        return F.when(F.coalesce(F.col(f"_set_{c}"), F.lit(False)), F.col(f"_{c}")).otherwise(plain) if c in nullable and f"set_{c}" in changes.columns else plain

    return table.join(named, id, "left").select(*[value(c).alias(c) for c in table.columns])


def not_found(table: DataFrame, changes: DataFrame, id: str = "id") -> DataFrame:
    """Ids to change that the table lacks."""
    return changes.select(id).distinct().join(table.select(id), id, "left_anti")


def bulk_update(table: DataFrame, ids: DataFrame, values: dict[str, Column], id: str = "id") -> DataFrame:
    """The table with ``values`` put into the rows of ``ids``."""
    flagged = table.join(ids.select(id).distinct().withColumn("_hit", F.lit(True)), id, "left")
    return flagged.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def updated(table: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """One row: updated, how many rows of the table ``bulk_update`` would change."""
    return table.join(ids.select(id), id, "left_semi").agg(F.count("*").alias("updated"))


def delete(table: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return table.join(ids.select(id), id, "left_anti")


def backfill(table: DataFrame, column: str, compute: Callable[[DataFrame], DataFrame], id: str = "id") -> DataFrame:
    """Fills nulls of ``column``: compute gets the rows that lack it and returns (id, column)."""
    filled = compute(table.where(F.col(column).isNull())).select(F.col(id), F.col(column).alias("_new"))
    return table.join(filled, id, "left").select(*[F.coalesce(column, "_new").alias(column) if c == column else F.col(c) for c in table.columns])


def cached(requests: DataFrame, cache: DataFrame, text: str, value: str, key: Callable[[Column], Column] = key_of) -> tuple[DataFrame, DataFrame]:
    """Requests with the cache's values, and the distinct keys that it lacks (with one text each, to compute)."""
    keyed = requests.withColumn("question_hash", key(F.col(text)))
    hits = keyed.join(cache.select("question_hash", value), "question_hash", "left")
    misses = keyed.join(cache, "question_hash", "left_anti").groupBy("question_hash").agg(F.min(text).alias(text))
    return hits, misses


def answer_key(language: Column, text: Column) -> Column:
    """Key of the answer cache: language and the trimmed lower-case text."""
    return key_of(F.concat(language, F.lit(":"), F.lower(F.trim(text))))


def transfer(usage: DataFrame, moves: DataFrame, key: str = "key", date: str = "usage_date", tokens: str = "tokens_used") -> DataFrame:
    """Usage after the guests of ``moves`` (guest, user) have become users: theirs goes to the user, and the guest keeps 0. Again, it changes nothing more."""
    moved = usage.join(moves, F.col(key) == F.col("guest")).select(F.col("user").alias(key), F.col(date), F.col(tokens))
    left = usage.join(moves.withColumnRenamed("guest", "_g"), F.col(key) == F.col("_g"), "left").select(F.col(key), F.col(date), F.when(F.col("_g").isNull(), F.col(tokens)).otherwise(0).alias(tokens))
    return left.unionByName(moved).groupBy(key, date).agg(F.sum(tokens).alias(tokens))
