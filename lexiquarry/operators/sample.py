"""Deterministic samples: rows in order of the hash of seed and id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def draw(seed: Column | str, id: str = "id") -> Column:
    """Sort key of a row in a sample."""
    return F.md5(F.concat_ws(":", F.lit(seed) if isinstance(seed, str) else seed, F.col(id).cast("string")))


def stratified(df: DataFrame, sizes: Mapping[str, int] = fixed.SAMPLE_SIZES, pool: int = 200, seed: str = "0", stratum: str = "subject", id: str = "id") -> DataFrame:
    """Rows without replacement: ``sizes`` of each stratum, out of the ``pool`` first ids of it. Inactive rows are included.

    Each stratum is a top-k and a top-k of that, so no task holds a stratum.
    """
    out = None
    for value, n in sizes.items():
        own = df.where(F.col(stratum) == value).orderBy(id).limit(pool).orderBy(draw(seed, id), id).limit(n)
        out = own if out is None else out.unionByName(own)
    return out


def pooled(df: DataFrame, selections: Sequence[tuple[str, Sequence[str]]], count: int, seed: str = "0", stratum: str = "subject", chapter: str = "chapter", id: str = "id") -> DataFrame:
    """A sample of 1 to 200 rows of the union of (subject, chapters) selections; no chapters means all. A subject counts once, by its last selection."""
    wanted = None
    for subject, chapters in dict(selections).items():
        own = F.col(stratum) == subject
        if chapters := [c.strip() for c in chapters if c.strip()]:
            own &= F.col(chapter).isin(chapters)
        wanted = own if wanted is None else wanted | own
    rows = df.where(F.lit(False) if wanted is None else wanted)
    return rows.orderBy(draw(seed, id), id).limit(min(200, max(1, count)))


def available(df: DataFrame, count: int) -> DataFrame:
    """One row: rows to choose from, and how many a sample of ``count`` gets."""
    n = F.count("*")
    return df.agg(n.alias("available"), F.least(n, F.lit(min(200, max(1, count))).cast("long")).alias("returned"))


def test_sets(df: DataFrame, tests: int = 6, size: int = 45, stratum: str = "subject", id: str = "id", seed: str = "set") -> DataFrame:
    """Independent samples for numbered tests of each subject: subject, test_number, question_ids (in order), question_count. Subjects of fewer rows than ``size`` are skipped.

    Each task keeps ``size`` ids of a subject and test, by a bounded sketch of the least keys: a window's rank
    limit, which Spark applies before the shuffle too.
    """
    copies = df.select(F.col(stratum), F.col(id), F.explode(F.sequence(F.lit(1), F.lit(tests))).alias("test_number"))
    keyed = copies.withColumn("key", draw(F.concat(F.lit(f"{seed}:"), F.col("test_number").cast("string")), id))
    order = Window.partitionBy(stratum, "test_number").orderBy("key", id)
    best = keyed.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= size)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rn", id))), lambda x: x[id])
    return best.groupBy(stratum, "test_number").agg(ids.alias("question_ids"), F.count("*").alias("question_count")).where(F.col("question_count") == size)


def catalogue(sets: DataFrame, subject: str, stratum: str = "subject") -> DataFrame:
    """The numbered tests of one subject in order of their numbers, without their questions."""
    return sets.where(F.col(stratum) == subject).drop(stratum, "question_ids").orderBy("test_number")
