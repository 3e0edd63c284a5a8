"""Hook for services outside: embeddings, extraction, classification."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def external(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], inputs: Sequence[str], schema: str) -> DataFrame:
    """df with the columns that fn computes from batches of ``inputs``, in the same order."""
    kept = [c for c in df.columns]
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = fn(pdf[list(inputs)])
            yield pd.concat([pdf[kept].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, f"{own}, {schema}")


def stub_embedding(size: int = 8) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A deterministic stand-in for an embedding service: bytes of the text's hash."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = pdf.iloc[:, 0].fillna("").map(lambda t: [b / 255 for b in hashlib.sha256(t.encode()).digest()[:size]])
        return pd.DataFrame({"embedding": digests})

    return fn


def extract_pages(pages: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: Sequence[str] = ("doc", "page")) -> DataFrame:
    """Per page: fn's columns and failed, pages in order. Garbled pages aren't sent out; they and pages for which fn gives nulls are flagged."""
    from ..functions.text import garbled

    first = schema.split()[0]
    bad = garbled(F.col("text"))
    good = external(pages.where(~bad), fn, ["text"], schema).withColumn("failed", F.col(first).isNull())
    return good.unionByName(pages.where(bad).withColumn("failed", F.lit(True)), allowMissingColumns=True).orderBy(*order)
