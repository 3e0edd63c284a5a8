"""Repairs of stored questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, embedded_answer, without_answer

OPTIONS = ("option_a", "option_b", "option_c", "option_d")


def answers_from_options(df: DataFrame, answer: str = "correct_answer") -> DataFrame:
    """Cleans answer markers out of the options; the first letter found fills an empty answer. Adds changed."""
    letter = F.coalesce(*[embedded_answer(F.col(o)) for o in OPTIONS])
    fill = blank(F.col(answer)) & letter.isNotNull()
    dirty = F.lit(False)
    for o in OPTIONS:
        dirty = dirty | ~without_answer(F.col(o)).eqNullSafe(F.col(o))
    return df.select(*[c for c in df.columns if c not in (*OPTIONS, answer)], *[without_answer(F.col(o)).alias(o) for o in OPTIONS], F.when(fill, letter).otherwise(F.col(answer)).alias(answer), (dirty | fill).alias("changed"))
