"""What the two classifiers share: bounded training samples, and scoring of whole texts batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out, rows: int, max_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of ``rows`` labelled doc_ids at most, of ``max_bytes`` each at most, that ``held_out`` leaves.

    The doc_ids are those with the least hashes, so the sample doesn't depend on partitions. They are chosen from
    the labels alone; the ``rows`` chosen are broadcast to the documents, whose texts aren't shuffled. Longer
    texts aren't cut; they stay out of the sample, which then is smaller. doc_ids that are null or bear both labels
    stay out; of rows that share a doc_id one counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)").where(~held_out)
    agreed = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    chosen = agreed.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    found = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    got = found.orderBy("doc_id").limit(rows).select("text", "label").toArrow()
    return [t.as_py().encode() for t in got.column("text")], got.column("label").to_numpy().astype(np.int64)


def scored(docs: DataFrame, held_out, fn: Callable[[list[bytes]], list[float]], threshold: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: ``keep`` columns, doc_id, held_out, score = fn(texts), predicted."""
    runtime.ready(docs.sparkSession)
    rest = [c for c in keep if c not in ("doc_id", "text")]
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), *rest)
    fields = "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in [*rest, *["text"] * ("text" in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                scores = np.asarray(fn([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]), np.float64)
                columns = {c: part.column(c) for c in [*rest, *["text"] * ("text" in keep), "doc_id", "held_out"]}
                yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))})

    return frame.mapInArrow(run, fields + "doc_id long, held_out boolean, score double, predicted int")


def held_out_rule(modulus: int, remainder: int):
    """crc32 of doc_id as text, modulo ``modulus``, equals ``remainder`` (null for a null doc_id)."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder
