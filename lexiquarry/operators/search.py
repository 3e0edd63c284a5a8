"""Filtered search with paging and totals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import blank


@dataclass(frozen=True)
class SearchSpec:
    """What to look for. None leaves a condition out; ``chapters`` are trimmed, blanks dropped, and none left means no condition.

    text: a substring in any case of any of ``text_columns``; ``%`` and ``_`` are wildcards, as in ILIKE.
    active: 'true' or 'false'; any other text sets no condition. missing_answer and missing_chapter keep rows in which
    that column is null or empty; has_diagram keeps rows with a non-empty ``diagram_columns`` entry.
    """

    subject: str | None = None
    chapters: Sequence[str] = ()
    text: str | None = None
    active: str | None = None
    missing_answer: bool = False
    missing_chapter: bool = False
    has_diagram: bool = False
    sort: str = "id"
    direction: str = "asc"
    page: int = 1
    page_size: int = fixed.PAGE_SIZE
    columns: Sequence[str] = ()
    subjects: Sequence[str] = ()
    text_columns: Sequence[str] = ("question", "option_a", "option_b", "option_c", "option_d")
    diagram_columns: Sequence[str] = ("diagram_url", "option_a_diagram_url", "option_b_diagram_url", "option_c_diagram_url", "option_d_diagram_url")
    sortable: Sequence[str] = ("id", "subject", "chapter", "year", "created_at")
    extra: Sequence[Column] = field(default=())


def checked_subject(subject: str, subjects: Sequence[str]) -> str:
    """The subject, or ValueError if it is none of ``subjects``."""
    if subject not in subjects:
        raise ValueError(f"subject must be one of {', '.join(subjects)}")
    return subject


def contains(needle: str, *columns: Column) -> Column:
    """Whether a column contains the needle in any case; backslashes are ordinary characters."""
    pattern = "%" + needle.replace("\\", "\\\\") + "%"
    return reduce(lambda a, b: a | b, [F.coalesce(c.ilike(pattern), F.lit(False)) for c in columns])


def any_present(*columns: Column) -> Column:
    """Whether a column is neither null nor empty."""
    return reduce(lambda a, b: a | b, [F.coalesce(c != "", F.lit(False)) for c in columns])


def tagged(tag: str, *columns: Column) -> Column:
    """'all', or one of the columns equals the tag."""
    return F.lit(True) if tag == "all" else reduce(lambda a, b: a | b, [F.coalesce(c == tag, F.lit(False)) for c in columns])


def condition(df: DataFrame, spec: SearchSpec) -> Column:
    """All conditions of the search, AND-ed; a search with an unknown subject ignores it."""
    out = [F.lit(True), *spec.extra]
    if spec.subject and (not spec.subjects or spec.subject in spec.subjects):
        out.append(F.col("subject") == spec.subject)
    if chapters := [c.strip() for c in spec.chapters if c.strip()]:
        out.append(F.col("chapter").isin(chapters))
    if spec.active in ("true", "false"):
        out.append(F.col("is_active") == (spec.active == "true"))
    if spec.missing_answer:
        out.append(blank(F.col("correct_answer")))
    if spec.missing_chapter:
        out.append(blank(F.col("chapter")))
    if spec.has_diagram:
        out.append(any_present(*[F.col(c) for c in spec.diagram_columns if c in df.columns]))
    if spec.text:
        out.append(contains(spec.text, *[F.col(c) for c in spec.text_columns if c in df.columns]))
    return reduce(lambda a, b: a & b, out)


def ordering(spec: SearchSpec) -> list[Column]:
    """Unknown columns sort by id; only 'desc' is descending. Nulls come last going up and first going down; id breaks ties."""
    c = F.col(spec.sort if spec.sort in spec.sortable else "id")
    first = c.desc_nulls_first() if spec.direction == "desc" else c.asc_nulls_last()
    return [first, F.col("id").asc()]


def total(df: DataFrame, spec: SearchSpec) -> DataFrame:
    """One row: total, pages (at least 1)."""
    n = F.count("*")
    return df.where(condition(df, spec)).agg(n.alias("total"), F.greatest(F.lit(1).cast("long"), F.ceil(n / spec.page_size)).alias("pages"))


def page(df: DataFrame, spec: SearchSpec) -> DataFrame:
    """One page of the rows found, in order; a top-k, never a sort of all that is found."""
    found = df.where(condition(df, spec)).orderBy(*ordering(spec)).offset((max(1, spec.page) - 1) * spec.page_size).limit(spec.page_size)
    return found.select(*spec.columns) if spec.columns else found


def _precedes(spec: SearchSpec, value, id_) -> Column:
    """Whether a row stands before the place (value, id) in the search's order."""
    column, down = spec.sort if spec.sort in spec.sortable else "id", spec.direction == "desc"
    c, same_id = F.col(column), F.col("id") < F.lit(id_)
    if value is None:
        return (c.isNull() & same_id) if down else c.isNotNull() | same_id
    inside = F.coalesce((c > F.lit(value)) if down else (c < F.lit(value)), F.lit(False)) | F.coalesce((c == F.lit(value)) & same_id, F.lit(False))
    return c.isNull() | inside if down else inside


def deep_page(df: DataFrame, spec: SearchSpec, ranges: int = 32, least: int = 100_000) -> DataFrame:
    """``page`` for pages however far down: the same rows, without a top-k that grows with the page.

    ``ranges`` places, of the rows with the least hashes, cut the order into ranges; one pass counts the rows of each, and only the ranges that hold
    the page are looked at again, until they have at most ``least`` rows (or the page's own). The driver gets places and counts only, ``ranges`` at
    a time. Ids must not be null, and tell rows apart.
    """
    found, skip = df.where(condition(df, spec)), (max(1, spec.page) - 1) * spec.page_size
    column = spec.sort if spec.sort in spec.sortable else "id"
    rows = None
    while rows is None or rows > max(least, spec.page_size):
        places = found.orderBy(F.xxhash64("id"), "id").limit(ranges).orderBy(*ordering(spec)).select(F.col(column).alias("value"), F.col("id").alias("place")).collect()
        if not places:
            break
        range_ = reduce(lambda a, b: a + b, [(~_precedes(spec, r.value, r.place)).cast("int") for r in places])
        counts = dict(found.groupBy(range_.alias("range")).count().collect())
        at, before, first, last, in_range = 0, 0, None, 0, 0
        for k in sorted(counts):
            if at + counts[k] > skip and at < skip + spec.page_size:
                first, before = (k, at) if first is None else (first, before)
                last, in_range = k, in_range + counts[k]
            at += counts[k]
        if first is None:
            found, skip = found.limit(0), 0
            break
        if rows is not None and in_range >= rows:
            break
        found, skip, rows = found.where(range_.between(first, last)), skip - before, in_range
    found = found.orderBy(*ordering(spec)).offset(skip).limit(spec.page_size)
    return found.select(*spec.columns) if spec.columns else found
