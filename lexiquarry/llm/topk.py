"""Exact top-k search by inner product: tiled matrix products, partial selection in each tile, tree merging of the lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import runtime

#: Vectors of a shard, queries of a block, shards that meet a block of queries in one task, and lists that one merge takes.
SHARD, QUERIES, SHARDS, FAN = 2048, 2048, 8, 16
#: Components beyond these ends count as the ends.
LARGEST = float(1 << 62)
_EXACT, _LONG = 1 << 53, 1 << 63


def _packed(vectors: DataFrame, scale: float, rows: int, name: str) -> DataFrame:
    """(shard, data), written: ids in ascending order and whole-number vectors of ``rows`` rows at most."""
    runtime.ready(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def emit() -> pa.RecordBatch:
            nonlocal held, seq
            whole = pa.Table.from_batches(held)
            now, held = whole.slice(0, rows), whole.slice(rows).to_batches()
            ids, lists = now.column("vec_id").to_numpy(), now.column("v").combine_chunks()
            lengths = lists.value_lengths().to_numpy()
            values = np.zeros((len(ids), max(1, int(lengths.max()))))
            with np.errstate(over="ignore"):
                values[np.arange(values.shape[1]) < lengths[:, None]] = np.clip(np.floor(scale * lists.flatten().to_numpy()), -LARGEST, LARGEST)
            by, seq = np.argsort(ids, kind="stable"), seq + 1
            return pa.RecordBatch.from_pydict({"shard": pa.array([(part << 32) + seq]), "data": pa.array([B.dumps(ids=ids[by], width=np.array(values.shape[1:]), values=values[by])], pa.binary())})

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= rows:
                yield emit()
        if sum(b.num_rows for b in held):
            yield emit()

    return runtime.materialise(vectors.mapInArrow(run, "shard long, data binary"), name)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors, exact as longs; sums beyond a long count as its ends. The shorter vector ends in zeros."""
    n = min(queries.shape[1], vectors.shape[1])
    a, b = queries[:, :n], vectors[:, :n]
    if n * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a).dot(whole(b).T), -_LONG, _LONG - 1).astype(np.int64)


def highest(row: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k highest of each row, ties to the smaller vec_id, in this order."""
    by = np.lexsort((vec_id, ~score, row))
    row, vec_id, score = row[by], vec_id[by], score[by]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], vec_id[first], score[first]


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, vec_id, score): for each query its k highest among ``ids``, without its own; only scores from the k-th on are sorted."""
    scores = products(queries, vectors)
    own = query_ids[:, None] == ids
    look = min(scores.shape[1], k + int(own.sum(1).max(initial=0)))
    least = np.partition(scores, scores.shape[1] - look, axis=1)[:, scores.shape[1] - look]
    row, column = np.nonzero((scores >= least[:, None]) & ~own)
    return highest(row, ids[column], scores[row, column], k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, shard: int = SHARD, queries: int = QUERIES, shards: int = SHARDS, fan: int = FAN) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` selects its ``k`` rows of highest inner product, ties to the smaller vec_id.

    ``vectors`` (vec_id, embedding): components count as floor(scale * x), in doubles; scores are exact. Candidates are all rows
    with another vec_id. Rows without a vec_id, without a vector, or with a null or non-finite component take no part; shorter vectors end in zeros;
    a query row that is there twice is answered twice; equal candidates each take a place; fewer candidates give fewer rows, none give none. Other
    columns are ignored.

    Vectors are packed into shards of ``shard`` rows and queries into blocks of ``queries``. A task gets about one block and ``shards`` shards, takes
    one matrix product for each and keeps ``k`` candidates a query; lists of a block are merged ``fan`` at a time, level by level, so no
    task holds more than a block's queries times ``fan`` lists.
    """
    whole = F.col("embedding").cast("array<double>")
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sharded = _packed(own.select("vec_id", "v"), scale, shard, "shards")
    asked = own.where("asks").select("vec_id", "v")
    blocks = max(1, -(-asked.select("vec_id").count() // queries))
    asked = _packed(asked.repartition(blocks, F.xxhash64("vec_id")), scale, queries, "queries")
    groups = max(1, -(-sharded.count() // shards))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("shard"), F.lit(n)).cast("int")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, node, data in zip(left["shard"], left["node"], left["data"]):
            q = B.loads(data)
            mine, found = q["values"].reshape(len(q["ids"]), -1), [(np.zeros(0, np.int64),) * 3]
            for other in right["data"]:
                x = B.loads(other)
                found.append(tile(q["ids"], mine, x["ids"], x["values"].reshape(len(x["ids"]), -1), k))
            row, vec_id, score = highest(*(np.concatenate(c) for c in zip(*found)), k)
            out.append((block, node, B.dumps(ids=q["ids"], row=row, vec_id=vec_id, score=score)))
        return pd.DataFrame(out, columns=["block", "node", "data"])

    left = asked.select("shard", dealt(blocks).alias("part"), "data").select("*", every(groups).alias("node"))
    right = sharded.select(dealt(groups).alias("node"), "data").select("*", every(blocks).alias("part"))
    lists = left.groupBy("part", "node").cogroup(right.groupBy("part", "node")).applyInPandas(compare, "block long, node int, data binary")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [B.loads(x) for x in pdf["data"]]
        row, vec_id, score = highest(*(np.concatenate([g[c] for g in got]) for c in ("row", "vec_id", "score")), k)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "node": pdf["node"].iloc[:1], "data": [B.dumps(ids=got[0]["ids"], row=row, vec_id=vec_id, score=score)]})

    while groups > 1:
        groups = -(-groups // fan)
        lists = lists.withColumn("node", F.floor(F.col("node") / fan).cast("int")).groupBy("block", "node").applyInPandas(merge, "block long, node int, data binary")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                x = B.loads(data.as_py())
                rank = np.arange(1, len(x["row"]) + 1) - np.searchsorted(x["row"], x["row"])
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(x["ids"][x["row"]]), "rank": pa.array(rank.astype(np.int32)), "vec_id": pa.array(x["vec_id"]), "score": pa.array(x["score"])})

    return lists.select("data").mapInArrow(rows, "query_id long, rank int, vec_id long, score long")
