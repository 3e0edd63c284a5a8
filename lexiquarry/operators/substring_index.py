"""Substring search over stored trigram postings."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .search import contains

SIZE = 3


def _numbered(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's number among them; all are below ``top``."""
    if top > 1 << 24:
        return np.unique(values, return_inverse=True)
    number = np.zeros(top, np.int32)
    number[values] = 1
    distinct = np.flatnonzero(number)
    number[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, number[values]


def _grams(texts: Sequence[str], places: Sequence[int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The trigrams of the texts in order, where the places of each begin and end, and these places: each once for a trigram."""
    letters, chars = _numbered(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), 0x110000)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    chars, n = chars.astype(np.int64), len(letters)
    inside = text[: -SIZE + 1] == text[SIZE - 1 :]
    codes, gram = _numbered(((chars[:-2] * n + chars[1:-1]) * n + chars[2:])[inside], n**SIZE)
    width = max(places, default=0) + 1
    pairs, _ = _numbered(gram.astype(np.int64) * width + np.asarray(places, np.int64)[text[: -SIZE + 1][inside]], len(codes) * width)
    joined = letters[np.stack([codes // n**2, codes // n % n, codes % n], 1)].astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i : i + SIZE] for i in range(0, len(joined), SIZE)], np.searchsorted(pairs, np.arange(len(codes) + 1) * width), pairs % width


def postings(df: DataFrame, columns: Sequence[str], id: str = "id", most: int = 2 << 20) -> DataFrame:
    """(gram, ids): for each trigram of lower-case texts the rows that hold it, in a list for every ``most`` characters of a partition.

    A longer text goes in pieces, so a row may be in two lists of a trigram. Written with ``store``, rows lie in order of their grams in each file, so
    a reader skips all parts of it but those of a needle's grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = batch.column(0), [], 0

            def lists() -> pa.RecordBatch:
                grams, ends, found = _grams([t for _, t in held], [k for k, _ in held])
                return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(found)))], ["gram", "ids"])

            for c in batch.columns[1:]:
                for k, text in enumerate(c):
                    text = text.as_py()
                    for start in range(0, len(text) - SIZE + 1, most):
                        held.append((k, text[start : start + most + SIZE - 1]))
                        size += len(held[-1][1])
                        if size >= most:
                            yield lists()
                            held, size = [], 0
            if held:
                yield lists()

    lower = df.select(F.col(id).alias("id"), *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"c{k}") for k, c in enumerate(columns)])
    return lower.mapInArrow(run, StructType().add("gram", StringType()).add("ids", ArrayType(lower.schema["id"].dataType)))


def store(found: DataFrame, path: str) -> None:
    """Write ``postings`` in order of their grams, each partition by itself, in row groups small enough to skip."""
    found.sortWithinPartitions("gram").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(path)


def needle_grams(needle: str) -> list[str]:
    """Trigrams that a row must have to hold the needle; none where all its plain parts are shorter than three characters."""
    parts = re.split("[%_]", needle.lower())
    return sorted({p[i : i + SIZE] for p in parts for i in range(len(p) - SIZE + 1)})


def candidates(found: DataFrame, needle: str) -> DataFrame | None:
    """Ids of the rows that have all trigrams of the needle; None if it has none, and all rows must be looked at.

    Trigrams may come from different columns, so a candidate is no hit yet.
    """
    grams = needle_grams(needle)
    if not grams:
        return None
    each = found.where(F.col("gram").isin(grams)).select("gram", F.explode("ids").alias("id"))
    return each.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("id")


def search(df: DataFrame, found: DataFrame, needle: str, columns: Sequence[str], id: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that hold the needle as ``search.contains`` has it, and one row: checked, how many of them were looked at."""
    some = candidates(found, needle)
    own = df if some is None else df.join(some.withColumnRenamed("id", id), id, "left_semi")
    return own.where(contains(needle, *[F.col(c) for c in columns])), own.agg(F.count("*").alias("checked"))
