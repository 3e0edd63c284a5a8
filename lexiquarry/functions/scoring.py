"""Scores of tests: percentages, bands, durations, ranks and chances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def half_up(c: Column) -> Column:
    """Nearest integer; halves go up, negative ones too."""
    return F.floor(c + F.lit(0.5))


def percent(score: Column) -> Column:
    return half_up(score / fixed.FULL_SCORE * 100)


def band(score: Column) -> Column:
    """Colour band of the percentage before it is rounded."""
    p = score / fixed.FULL_SCORE * 100
    return F.when(p >= 70, "high").when(p >= 50, "good").when(p >= 30, "fair").otherwise("low")


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))).otherwise(F.concat(m.cast("string"), F.lit("m "), s.cast("string"), F.lit("s")))


def valid(score: Column) -> Column:
    """0 is no valid score."""
    return (score > 0) & (score <= fixed.FULL_SCORE)


def rank_band(score: Column) -> Column:
    """Struct of the expected first and last rank and the percentile."""
    def row(first: int, last: int, pct: float) -> Column:
        return F.struct(F.lit(first).alias("rank_from"), F.lit(last).alias("rank_to"), F.lit(pct).alias("percentile"))

    *bands, (_, *rest) = fixed.RANK_BANDS
    out = F
    for low, *values in bands:
        out = out.when(score >= low, row(*values))
    return out.otherwise(row(*rest))


def chances(score: Column, category: Column) -> Column:
    """Struct of the two chances. Outside the general category 400 points give "possible", above the high band too."""
    base = F.when(score >= 550, "high").when(score >= 450, "moderate").otherwise("low")
    reserved = F.when(score >= 400, "possible").when(score >= 350, F.when(base == "low", "check-cutoff").otherwise(base)).otherwise(base)
    seat = F.when(score >= 620, "likely").when(score >= 550, "possible").otherwise("unlikely")
    return F.struct(F.when(category == "general", base).otherwise(reserved).alias("admission"), seat.alias("government_seat"))


def trend_point(score: Column, index: Column, n: Column, width: float = 100.0, height: float = 100.0) -> Column:
    """Coordinates of a point of a trend line of n >= 2 points."""
    return F.struct((index / (n - 1) * width).alias("x"), (height - score / fixed.FULL_SCORE * height).alias("y"))


def chart_point(score: Column, index: Column, n: Column, width: float = 880.0, height: float = 200.0, top: float = 16.0, bottom: float = 30.0, side: float = 10.0) -> Column:
    """``trend_point`` inside a chart's padding; scores below 0 lie on its base."""
    return F.struct((side + index / (n - 1) * (width - 2 * side)).alias("x"), (top + (height - top - bottom) * (1 - F.greatest(F.lit(0), score) / fixed.FULL_SCORE)).alias("y"))
