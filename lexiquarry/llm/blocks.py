"""Document blocks: compressed groups of whole documents that fit a worker, and exchanges of packed arrays between them.

Operators that look every document up against statistics of the whole corpus work in rounds. Each
block asks with packed arrays of distinct hashes, cut into parts by hash; the reducers of a part
see the requests of all blocks and answer each block with an array in the order of its request.
So a round moves some bytes for each distinct key of a block, rather than a row for each token,
and neither the driver nor a broadcast ever holds anything that grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: UTF-8 bytes of text in a block (a longer document makes a block by itself).
BLOCK_BYTES = 4 << 20
#: Rows in a block at most, so that block and row fit one long.
BLOCK_ROWS = 1 << 16
NULL_ID = -(1 << 63)


def pack(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text"), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, n, payload): the given columns of ``docs`` in blocks, written to the shared folder."""
    runtime.ready(docs.sparkSession)
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in columns if c not in ("doc_id", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def emit() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << 24) + seq], pa.int64()), "n": pa.array([sum(b.num_rows for b in held)], pa.int32()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for whole in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < whole.num_rows:
                before = lengths[at - 1] if at else 0
                rows = sum(b.num_rows for b in held)
                to = min(max(at + 1, int(np.searchsorted(lengths, before + block_bytes - size, "right"))), at + BLOCK_ROWS - rows)
                # copied, so that the rest of the batch isn't written with it
                held.append(whole.take(pa.array(range(at, to))))
                size += int(lengths[to - 1] - before)
                at = to
                if size >= block_bytes or at < whole.num_rows:
                    yield emit()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield emit()

    return runtime.materialise(wanted.mapInArrow(run, "block long, n int, payload binary"), "blocks")


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def texts(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """doc_ids (null: least) and texts as UTF-8 (null: empty)."""
    ids = table.column("doc_id").fill_null(NULL_ID).to_numpy()
    return ids, [b"" if t is None else t for t in table.column("text").cast(pa.binary()).to_pylist()]


def runs(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of about ``most`` units together."""
    at = size = 0
    for i, n in enumerate(lengths):
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(lengths):
        yield at, len(lengths)


def dumps(**arrays: np.ndarray) -> bytes:
    """One compressed buffer of named arrays."""
    import pickle

    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps({k: (str(v.dtype), v.tobytes()) for k, v in arrays.items()}, protocol=5))


def loads(data: bytes) -> dict[str, np.ndarray]:
    import pickle

    import zstandard

    return {k: np.frombuffer(v, dtype) for k, (dtype, v) in pickle.loads(zstandard.ZstdDecompressor().decompress(data)).items()}


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of a well-mixed 64-bit hash, by its upper half."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cuts(sorted_keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted keys: parts are ranges, so a request is a slice."""
    p = part_of(sorted_keys, parts)
    first = np.flatnonzero(np.diff(p, prepend=-1)) if len(p) else np.zeros(0, np.int64)
    return [(int(p[a]), int(a), int(b)) for a, b in zip(first, [*first[1:], len(p)])]


def parts_for(blocks: DataFrame) -> int:
    """Parts of an exchange: one for every two blocks, so that a part's requests are bounded by what two blocks ask."""
    return max(8, -(-blocks.count() // 2))


def ask(blocks: DataFrame, fn: Callable[..., Iterator[tuple[int, bytes]]], answers: DataFrame | None = None) -> DataFrame:
    """(p, block, data): fn(table[, answers by part]) yields a request for each part."""
    return _each(blocks, answers, "p int, block long, data binary", lambda block, got: (pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int32()), "block": pa.array([block], pa.int64()), "data": pa.array([d], pa.binary())}) for p, d in got), fn)


def finish(blocks: DataFrame, answers: DataFrame, fn: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """Rows of fn(table, answers by part) of every block."""
    return _each(blocks, answers, schema, lambda _, got: iter([got]), fn)


def both(*answers: DataFrame) -> DataFrame:
    """Answers of several rounds as one; a block gets them by (round, part)."""
    out = None
    for k, df in enumerate(answers):
        own = df.select("block", "p", "data", F.lit(k).alias("round"))
        out = own if out is None else out.unionByName(own)
    return out


def _each(blocks, answers, schema, put, fn):
    asked, rounds = answers is not None, False
    if not asked:
        df = blocks.select("block", "payload", F.lit(None).cast("array<struct<p:int,data:binary>>").alias("answers"))
    else:
        rounds = "round" in answers.columns
        got = answers.groupBy("block").agg(F.collect_list(F.struct("p", "data", *["round"] * rounds)).alias("answers"))
        df = blocks.select("block", "payload").join(got, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, payload, back = (b.column(c)[i].as_py() for c in ("block", "payload", "answers"))
                table = unpack(payload)
                if not asked:
                    yield from put(block, fn(table))
                else:
                    yield from put(block, fn(table, {(x["round"], x["p"]) if rounds else x["p"]: x["data"] for x in back or ()}))

    return df.mapInArrow(run, schema)


def reduce(requests: DataFrame, parts: int, fn: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
    """(block, p, data): fn(part, requests of all blocks) returns an answer for each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "p": pdf["p"].to_numpy(), "data": fn(int(pdf["p"].iloc[0]), list(pdf["data"]))})

    # a partition for each part: they are small in bytes, and would be put together, but not quick
    return requests.repartition(parts, "p").groupBy("p").applyInPandas(run, "block long, p int, data binary")
