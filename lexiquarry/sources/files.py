"""Sources: tables, listings of files, documents and JSON payloads."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import without_fences


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """Files that match: path, modificationTime, length, content (read only where a query needs it). Empty files are left out."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def configured(files: DataFrame, config: DataFrame) -> DataFrame:
    """Files of a list (file, year, format); those that are missing are skipped."""
    return files.withColumn("file", F.substring_index("path", "/", -1)).join(config, "file")


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """Path of each file, and that of a copy in the task's own temporary folder, which lasts until the next one."""
    with tempfile.TemporaryDirectory() as folder:
        for batch in batches:
            for path, content in zip(*batch.columns):
                Path(f"{folder}/copy").write_bytes(content.as_buffer() or b"")
                yield path.as_py(), f"{folder}/copy"


def page_texts(files: DataFrame, reader: Callable[[Any], list[str]], separator: str = "\n", skip_empty: bool = True, by_path: bool = False) -> DataFrame:
    """path, pages, text: pages joined by the separator, as ``reader`` (a PDF library of the caller's) finds them; text is null where it fails.

    ``reader`` gets bytes or a path, as ``render`` of ``page_images`` does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, copy in _copies(batches):
            try:
                pages = reader(copy if by_path else Path(copy).read_bytes())
                found = {"path": path, "pages": len(pages), "text": separator.join(p for p in pages if p or not skip_empty)}
            except Exception:  # a damaged file mustn't end the job
                found = {"path": path, "pages": 0, "text": None}
            yield pa.RecordBatch.from_pylist([found], pa.schema([("path", pa.string()), ("pages", pa.int32()), ("text", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "path string, pages int, text string")


def page_images(files: DataFrame, render: Callable[[Any], Iterator[bytes]], most: int = 16 << 20, by_path: bool = False) -> DataFrame:
    """path, page (from 1), image: a base64 text for each page that ``render`` (a PDF library of the caller's) draws, none from where it fails on.

    ``render`` gets a file's bytes, or with ``by_path`` the path of a temporary copy, of which it need not hold more than a page; Python holds
    the file's bytes once. Images leave a task when they have ``most`` bytes or are 1,000, however many pages a file has.
    """

    def drawing(copy: str) -> Iterator[bytes]:
        yield from render(copy if by_path else Path(copy).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frame(path: str, last: int, images: list[bytes]) -> pa.RecordBatch:
            numbers = pa.array(range(last - len(images) + 1, last + 1), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([path] * len(images), pa.string()), numbers, pa.array(images, pa.binary())], ["path", "page", "image"])

        for path, copy in _copies(batches):
            held, size, n, pages = [], 0, 0, drawing(copy)
            while True:
                try:
                    image = bytes(next(pages))
                except Exception:  # the end, or a damaged file, which mustn't end the job
                    break
                held.append(image)
                n, size = n + 1, size + len(image)
                if size >= most or len(held) == 1000:
                    yield frame(path, n, held)
                    held, size = [], 0
            yield frame(path, n, held)

    drawn = files.select("path", "content").mapInArrow(run, "path string, page int, image binary")
    # Spark breaks base64 texts into lines
    return drawn.withColumn("image", F.translate(F.base64("image"), "\r\n", ""))


def payload(c: Column) -> Column:
    """Bytes of a base64 text; null where it is none."""
    return F.try_to_binary(c, F.lit("base64"))


def json_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A row for each struct of a JSON array in a model's output, fenced or not; output that doesn't parse gives none."""
    parsed = F.from_json(without_fences(F.col(column)), f"array<struct<{schema}>>")
    return df.withColumn("_rows", parsed).select(*[c for c in df.columns if c != column], F.explode("_rows").alias("_row")).select(*[c for c in df.columns if c != column], "_row.*")


def extracted_questions(rows: DataFrame, page: str = "page") -> DataFrame:
    """Names and defaults of extracted questions: source_page, a blank answer, has_diagram as a truth value."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(F.col(page).alias("source_page"), *[text(c) for c in ("question", "option_a", "option_b", "option_c", "option_d")], F.lit("").alias("correct_answer"), F.coalesce(F.col("has_diagram").cast("boolean"), F.lit(False)).alias("has_diagram"))
