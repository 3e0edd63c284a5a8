"""Suffix-array dedup with a logarithmic family of stored indexes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import recurrence as R
from . import runtime
from .hashing import anchors

MIN_BYTES = 100
#: Batches that a table is added in.
BATCHES = 4
#: Regions of a part of the index, about.
PART_REGIONS = 4_000
#: Regions of one anchor that one part takes; those of an anchor with more are settled by their windows' hashes.
HOT_REGIONS = 1_000


class Level(NamedTuple):
    """A suffix array: the starts of distinct suffixes in ``pool``, in the order of their first ``length`` bytes."""

    pool: np.ndarray
    starts: np.ndarray

    def keys(self, length: int) -> np.ndarray:
        """The suffixes' first ``length`` bytes. (numpy's comparison of such strings ignores only trailing zeros, which equal lengths make exact.)"""
        if not len(self.starts):
            return np.zeros(0, f"S{length}")
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.pool, length)[self.starts]).view(f"S{length}").ravel()

    def store(self) -> bytes:
        return B.dumps(pool=self.pool, starts=self.starts)


def load(data: bytes) -> Level:
    return Level(**B.loads(data))


def merged(older: Level, newer: Level, length: int) -> Level:
    """One suffix array of two that share no suffix."""
    a, b = older.keys(length), newer.keys(length)
    at = np.searchsorted(a, b) + np.arange(len(b))
    starts = np.empty(len(a) + len(b), np.int64)
    old = np.ones(len(starts), bool)
    old[at] = False
    starts[at], starts[old] = newer.starts + len(older.pool), older.starts
    return Level(np.concatenate((older.pool, newer.pool)), starts)


def scanned(texts: list[bytes], doc: np.ndarray, pos: np.ndarray, levels: list[Level], length: int) -> tuple[np.ndarray, Level]:
    """For each text, a bit for each suffix that starts earlier in the batch or in a level; and the suffix array of the batch's new ones.

    texts: regions that begin at ``pos`` of document ``doc``; a suffix counts with its first ``length`` bytes. The batch's
    suffixes are sorted; then neighbours, and neighbours in each level by a merge of both orders, are matches if
    their common prefix has ``length`` bytes.
    """
    pool = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = np.maximum(0, sizes - length + 1)
    owner = np.repeat(np.arange(len(texts)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = pos[owner] + inner
    by = np.lexsort((begin, doc[owner]))
    owner, inner, begin = owner[by], inner[by], begin[by]
    starts = (np.cumsum(sizes) - sizes)[owner] + inner
    keys = Level(pool, starts).keys(length)
    order = np.argsort(keys, kind="stable")
    keys, owner, inner, begin, starts = keys[order], owner[order], inner[order], begin[order], starts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    heads = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    first = heads[run]
    hit = (doc[owner] != doc[owner[first]]) | (begin != begin[first])
    known = np.zeros(len(heads), bool)
    for level in levels:
        other = level.keys(length)
        if len(other):
            known |= other[np.minimum(np.searchsorted(other, keys[heads]), len(other) - 1)] == keys[heads]
    hit |= known[run]
    bits = np.zeros(len(texts), np.uint64)
    np.bitwise_or.at(bits, owner[hit], np.uint64(1) << inner[hit].astype(np.uint64))
    return bits, Level(pool, starts[heads[~known]])


class SuffixIndex:
    """Suffix arrays of batches, stored as tables; n batches lie in the tables that the binary digits of n name.

    The suffixes are dealt into parts by their anchor; each part has a suffix array in each level. A batch is added by
    one job: the parts of the batch get suffix arrays, are scanned against the stored levels, and are merged with
    the levels of their own size, the results of which are one new table. So each suffix is merged about log2(n) times.
    """

    def __init__(self, spark: SparkSession, length: int, parts: int) -> None:
        self.spark, self.length, self.parts = spark, length, max(1, parts)
        #: (batches, rows (part, data)) of each level, the largest first.
        self.levels: list[tuple[int, DataFrame]] = []
        self.written: list[DataFrame] = []

    def add(self, regions: DataFrame) -> DataFrame:
        """(h, r, bits): for each region (h, r, doc, pos, text) one bit for each of its suffixes that starts earlier, here or in a former batch.

        Batches are added in the order of the corpus: no document of a batch stands before one of a former batch.
        """
        length = self.length
        joined, size = 0, 1
        while joined < len(self.levels) and self.levels[-1 - joined][0] == size:
            joined, size = joined + 1, 2 * size
        stay = len(self.levels) - joined
        stored = None
        for k, (_, rows) in enumerate(self.levels):
            own = rows.select("part", F.lit(k).alias("level"), "data")
            stored = own if stored is None else stored.unionByName(own)
        if stored is None:
            stored = self.spark.createDataFrame([], "part int, level int, data binary")
        batch = regions.select(F.pmod(F.xxhash64("h"), F.lit(self.parts)).cast("int").alias("part"), "h", "r", "doc", "pos", "text")

        def extend(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            levels = [(k, load(d)) for k, d in sorted(zip(old["level"], old["data"]))]
            bits, level = scanned(list(new["text"]), new["doc"].to_numpy(np.int64), new["pos"].to_numpy(np.int64), [x for _, x in levels], length)
            for k, other in reversed(levels):
                if k >= stay:
                    level = merged(other, level, length)
            out = pd.DataFrame({"h": new["h"], "r": new["r"], "bits": bits.view(np.int64)})
            return pd.concat([out.assign(part=key[0], data=None), pd.DataFrame({"part": [key[0]], "data": [level.store()], "h": [0], "r": [0], "bits": [0]})])[["part", "data", "h", "r", "bits"]]

        done = runtime.materialise(batch.groupBy("part").cogroup(stored.groupBy("part")).applyInPandas(extend, "part int, data binary, h long, r long, bits long"), "level", settle=True)
        self.written.append(done)
        self.levels = [*self.levels[:stay], (size, done.where("data IS NOT NULL").select("part", "data"))]
        return done.where("data IS NULL").select("h", "r", "bits")

    def discard(self) -> None:
        """Delete the index and the answers that it has given."""
        runtime.discard(*self.written)


def _gram(length: int) -> int:
    """At most 64 windows share an anchor, as one bit of a long stands for each."""
    return max(length - 63, -(-length // 3))


def _laid_out(table: pa.Table) -> tuple[np.ndarray, list[bytes], bytes, np.ndarray]:
    """doc_ids, texts, the texts as one buffer, and their offsets in it."""
    ids, texts = B.texts(table)
    return ids, texts, b"".join(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def repeats(docs: DataFrame, length: int = MIN_BYTES, keep: tuple[str, ...] = (), batches: int = BATCHES, text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans, kept (the remaining bytes), and ``keep`` columns;
    with ``text`` also kept_text, without the characters that a span cuts in two.

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document
    with a smaller doc_id or, in the same document, at an earlier byte; strings may overlap and are judged on the
    input. Null texts count as empty; null doc_ids as the smallest; texts shorter than ``length`` stay whole.
    Rows that share a doc_id count as one document's: of their strings at equal starts none is earlier.

    Every string belongs to the anchor that its content selects, so equal strings meet at equal
    anchors. Anchors that occur once are left out; equal regions (all strings of an anchor's occurrence) collapse to
    their first, whose followers are removed whole. First regions of anchors that have several go, in
    ``batches`` by doc_id, into a ``SuffixIndex``, which tells the strings of each that start earlier. An anchor with more than
    ``HOT_REGIONS`` different regions would fill one part: these are settled string by string, by hashes, in an aggregate.
    """
    if length < 12:
        raise ValueError("length must be 12 bytes at least")
    packed = B.pack(docs, ("doc_id", "text", *keep))

    def ask(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        _, _, buf, offset = _laid_out(table)
        raw = np.frombuffer(buf, np.uint8)
        h, n = np.unique(anchors(raw, offset, length, _gram(length))[0], return_counts=True)
        zero = np.zeros(len(h), np.int64)
        yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "block": pa.array(zero + block), "low": pa.array(zero), "high": pa.array(zero), "many": pa.array(np.minimum(n, 2), pa.int32())})

    def regions(block: int, table: pa.Table, got: pa.Array) -> Iterator[pa.RecordBatch]:
        ids, _, buf, offset = _laid_out(table)
        raw = np.frombuffer(buf, np.uint8)
        all_ = anchors(raw, offset, length, _gram(length))
        s = R.Regions(raw, length, all_, np.isin(all_[0], got.to_numpy().view(np.uint64)), ids, offset, places=True)
        yield s.rows(block)

    def cut(table: pa.Table, starts: np.ndarray, windows: np.ndarray) -> pa.Array:
        buf = _laid_out(table)[2]
        return pa.array([buf[a : a + n + length - 1] for a, n in zip(starts.tolist(), windows.tolist())], pa.binary())

    found, first = R.firsts(packed, ask, regions, documents=False)
    every = R.leads(packed, found, first, cut, "text binary")
    leads = every.where(F.col("n") <= HOT_REGIONS)
    about = leads.agg(F.count("*").alias("n"), F.percentile_approx("doc", [i / batches for i in range(1, batches)] or [1.0], 1000).alias("cuts")).first()
    index, bits = SuffixIndex(docs.sparkSession, length, about["n"] // PART_REGIONS), None
    cuts = sorted({*about["cuts"][: batches - 1]}) if about["n"] else []
    for low, high in zip([None, *cuts], [*cuts, None]):
        own = leads if low is None else leads.where(F.col("doc") > low)
        got = index.add(own if high is None else own.where(F.col("doc") <= high))
        bits = got if bits is None else bits.unionByName(got)

    def hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            raw = [x.as_py() for x in b.column("text")]
            ends = np.cumsum([len(x) for x in raw])
            starts = np.concatenate([np.arange(e - len(x), e - length + 1) for x, e in zip(raw, ends)])
            ws = R.spans(np.frombuffer(b"".join(raw), np.uint8), starts, starts + length).view(np.int64)
            cut = np.concatenate(([0], np.cumsum([len(x) - length + 1 for x in raw])))
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in ("h", "r", "doc", "pos")} | {"ws": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ws))})

    hot = every.where(F.col("n") > HOT_REGIONS).select("h", "r", "doc", "pos", "text").mapInArrow(hashed, "h long, r long, doc long, pos long, ws array<bigint>")
    settled = runtime.materialise(R.by_windows(hot, places=True), "hot", settle=True)
    told = R.answers(found, R.told(found, first, bits.unionByName(settled)))
    runtime.discard(found, first, every, settled)
    index.discard()
    order = [c for c in keep if c != "doc_id"]

    def apply(_: int, table: pa.Table, scan: bytes | None, got: pa.StructArray | None) -> Iterator[pa.RecordBatch]:
        ids, texts, _, offset = _laid_out(table)
        repeated = R.repeated(scan, got, ids, offset, places=True)
        out = []
        for i, raw in enumerate(texts):
            starts = np.flatnonzero(repeated[offset[i] : offset[i + 1]])
            if not len(starts):
                out.append((len(raw), 0, [], [raw]))
                continue
            # maximal runs of removed bytes: windows that overlap or touch
            new = np.ones(len(starts), bool)
            new[1:] = starts[1:] > starts[:-1] + length
            head = np.flatnonzero(new)
            cut = list(zip(starts[head].tolist(), (starts[np.append(head[1:], len(starts)) - 1] + length).tolist()))
            kept, at = [], 0
            for a, b in cut:
                kept.append(raw[at:a])
                at = b
            out.append((len(raw), sum(b - a for a, b in cut), cut, [*kept, raw[at:]]))
        n, removed, cuts, kept = zip(*out)
        columns = {c: table.column(c).combine_chunks() for c in order} | {
            "doc_id": table.column("doc_id").combine_chunks(),
            "n_bytes": pa.array(n, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array([len(x) for x in cuts], pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in x] for x in cuts], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array([b"".join(x) for x in kept], pa.binary()),
        }
        if text:
            columns["kept_text"] = pa.array(["".join(y.decode(errors="ignore") for y in x) for x in kept], pa.string())
        yield pa.RecordBatch.from_pydict(columns)

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in order)
    schema = fields + "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, kept binary" + ", kept_text string" * text
    return R.with_blocks(packed, told, apply, schema)
