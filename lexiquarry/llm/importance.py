"""Target-distribution importance resampling over bucket-partitioned inverted postings."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import runtime

BUCKETS = 10_000
#: Ranges of buckets, and blocks of documents whose postings of a range meet in one task.
RANGES, GROUP = 16, 16
#: 0-9, a-z and all bytes from 0x80 stay, A-Z are lower-cased, all else separates words.
_TABLE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_KEPT_FEATURES = 1 << 20


class _Buckets(dict):
    """Bucket of each feature, worked out when it is first seen."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _KEPT_FEATURES:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.buckets
        return out


def _features(text: bytes, longest: int, known: _Buckets) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all runs of 1 to ``longest`` words."""
    words = text.translate(_TABLE).split()
    out = [np.fromiter(map(known.__getitem__, words), np.int32, len(words))]
    for n in range(2, longest + 1):
        runs = max(0, len(words) - n + 1)
        out.append(np.fromiter((known[b" ".join(words[i : i + n])] for i in range(runs)), np.int32, runs))
    return len(words), np.concatenate(out)


def _postings(docs: DataFrame, longest: int, buckets: int, name: str) -> DataFrame:
    """(block, part, n, data), written: the postings (bucket, doc, count) of each block of documents, cut into ranges of buckets.

    The row of part -1 has the block's doc_ids and their numbers of words and features; n is the number of features of a row.
    """
    runtime.ready(docs.sparkSession)

    def rows(block: int, table: pa.Table, known: _Buckets) -> Iterator[tuple]:
        ids, texts = B.texts(table)
        found = [_features(t, longest, known) for t in texts]
        sizes = np.fromiter((len(f) for _, f in found), np.int64, len(found))
        every = np.concatenate([f for _, f in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        keys, counts = np.unique(every * len(texts) + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
        bucket, doc = np.divmod(keys, len(texts))
        null = table.column("doc_id").is_null().to_numpy()
        yield block, -1, int(sizes.sum()), B.dumps(ids=ids, null=null, words=np.fromiter((n for n, _ in found), np.int64, len(found)), features=sizes)
        edges = np.searchsorted(bucket * RANGES // buckets, np.arange(RANGES + 1))
        for p, a, b in zip(range(RANGES), edges, edges[1:]):
            if a < b:
                yield block, p, int(counts[a:b].sum()), B.dumps(bucket=np.diff(bucket[a:b], prepend=0).astype(np.int32), doc=doc[a:b].astype(np.uint16), count=counts[a:b].astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, known = TaskContext.get().partitionId(), 0, _Buckets(buckets)
        for batch in batches:
            lengths = [len(t) if t else 0 for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in B.runs(lengths, B.BLOCK_BYTES):
                for x in range(a, b, B.BLOCK_ROWS):
                    table = pa.Table.from_batches([batch.slice(x, min(b, x + B.BLOCK_ROWS) - x)])
                    columns = zip(*rows((part << 24) + seq, table, known))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "part", "n", "data"])
                    seq += 1

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return runtime.materialise(wanted.mapInArrow(run, "block long, part int, n long, data binary"), name)


def _totals(postings: DataFrame, of: str) -> DataFrame:
    """(part, bucket, source, target): features of each bucket in one of the corpora, a row a bucket and task at most before they are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                x = B.loads(data.as_py())
                bucket = np.cumsum(x["bucket"])
                counted = np.bincount(bucket, x["count"])
                held = sums.get(p, np.zeros(0))
                whole = np.zeros(max(len(held), len(counted)))
                whole[: len(held)] += held
                whole[: len(counted)] += counted
                sums[p] = whole
        for p, whole in sums.items():
            some = np.flatnonzero(whole)
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(some), p, np.int32)), "bucket": pa.array(some.astype(np.int32)), "n": pa.array(whole[some].astype(np.int64))})

    zero = F.lit(0).cast("long")
    rows = postings.where("part >= 0").select("part", "data").mapInArrow(run, "part int, bucket int, n long")
    return rows.select("part", "bucket", (F.col("n") if of == "source" else zero).alias("source"), (F.col("n") if of == "target" else zero).alias("target"))


def weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``, written: doc_id, n_words, n_features, weight.

    Features are all runs of 1 to ``longest`` words (digits, letters and all characters beyond ASCII; A-Z lower-cased), each in the bucket crc32 % ``buckets``.
    A bucket's gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) with its features in documents (s of S) and target texts (t of T).
    weight is the floored mean gain of a document's features; 0 without any. Null texts have none; null doc_ids stay null;
    repeated rows count as often as they occur; other columns are ignored; an empty target or documents table counts as no features.

    Postings (bucket, doc, count) are shuffled by ranges of buckets, where the counts of both corpora meet and give the gains, and are
    turned into sums by document there; the sums are added up by document. Both are packed: a row holds one block's postings of a range. A range is
    dealt to one task for every ``GROUP`` blocks, so a bucket that a third of all postings belong to is split as all others are; what each of these tasks
    needs besides is the gains of its range, at most buckets / RANGES rows.
    """
    own = _postings(docs, longest, buckets, "postings")
    other = _postings(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets, "target")
    totals = _totals(own, "source").unionByName(_totals(other, "target")).groupBy("part", "bucket").agg(F.sum("source").alias("s"), F.sum("target").alias("t"))
    totals = runtime.materialise(totals, "totals")
    sums = totals.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    wide = lambda c: c.cast("double")
    ratio = wide(F.col("t") + 1) * wide(F.lit(sums[0] + buckets)) / (wide(F.col("s") + 1) * wide(F.lit(sums[1] + buckets)))
    gains = totals.select("part", F.struct("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).alias("x")).groupBy("part").agg(F.collect_list("x").alias("gains"))

    numbered = own.where("part >= 0").select("part", "block", "data")
    order = own.where("part < 0").select("block")
    groups = max(1, -(-order.count() // GROUP))
    numbered = numbered.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    copies = gains.select("part", "gains", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))

    def contribute(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"block": [], "data": []})
        gain = np.zeros(buckets)
        for x in right["gains"].iloc[0]:
            gain[x["bucket"]] = x["gain"]
        out = []
        for data in left["data"]:
            x = B.loads(data)
            out.append(B.dumps(sums=np.bincount(x["doc"], gain[np.cumsum(x["bucket"])] * x["count"]).astype(np.int64)))
        return pd.DataFrame({"block": left["block"].to_numpy(), "data": out})

    parts = numbered.groupBy("part", "group").cogroup(copies.groupBy("part", "group")).applyInPandas(contribute, "block long, data binary")
    gathered = parts.groupBy("block").agg(F.collect_list("data").alias("sums"))
    whole = own.where("part < 0").select("block", "data").join(gathered, "block", "left")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, got in zip(batch.column("data").to_pylist(), batch.column("sums").to_pylist()):
                x = B.loads(data)
                total = np.zeros(len(x["ids"]), np.int64)
                for part in got or ():
                    added = B.loads(part)["sums"]
                    total[: len(added)] += added
                n = x["features"]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(x["ids"], mask=x["null"]), "n_words": pa.array(x["words"]), "n_features": pa.array(n), "weight": pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))})

    return runtime.materialise(whole.mapInArrow(reduce, "doc_id long, n_words long, n_features long, weight long"), "weights")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    ``weights``, drawn without replacement: the score adds -1000 ln(-ln(u)), floored, for a u that sha256 of ``seed:doc_id`` gives, and of the N documents with
    ``least_words`` words or more the floor(percent N / 100) highest scores are drawn, ranked from 1, ties to the smaller doc_id (a null one first; its key is
    ``seed:null``); equal rows of one doc_id get ranks in any order. rank is null for all others.

    Ranks come from the number of documents of each score (scores are whole numbers over a bounded range, so these are some
    ten thousand rows whatever the corpus) and the order within a score; documents are never sorted in one task.
    """
    found = weights(docs, target, longest, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    found = found.withColumn("score", (F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))).cast("long"))
    able = found.where(F.col("n_words") >= least_words)
    per_score = able.groupBy("score").agg(F.count("*").alias("n"))
    counts = runtime.materialise(per_score, "scores")
    drawn = (counts.agg(F.sum("n")).first()[0] or 0) * percent // 100
    higher = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    highest = counts.withColumn("above", F.coalesce(F.sum("n").over(higher), F.lit(0))).where(F.col("above") < drawn).select("score", "above")
    highest = runtime.materialise(highest, "highest")
    least = highest.agg(F.min("score")).first()[0]
    top = F.col("n_words") >= least_words if least is not None else F.lit(False)
    top = top & (F.col("score") >= (least or 0))
    within = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), F.col("weight").desc())
    ranked = found.where(top).join(highest, "score").withColumn("rank", F.col("above") + F.row_number().over(within))
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return ranked.unionByName(found.where(~top).select(*out, F.lit(None).cast("long").alias("rank")))
