"""What the two substring dedups share: windows owned by content-chosen anchors, equal regions collapsed, verdicts sent back to blocks.

A window of ``length`` units belongs to the anchor that its content selects, so equal windows have equal anchors at
equal places. A region is a run of windows with one anchor; it is known by the anchor's hash ``h`` and the hash ``r`` of
its units and of the anchor's place in it. All frames here hold one row for each distinct anchor or region of a block at most,
so copies meet in a row a block, and everything between the blocks is plain joins and aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import runtime
from .hashing import PIECE, mix, prefix_sums, span_hash

REGION = "block long, idx int, h long, r long, doc long, pos long, last_doc long, last_pos long"
_ALL = np.uint64(2**64 - 1)


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[starts:ends], in ascending order of their starts; each span is looked at whole."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    most = int((ends - starts).max())
    for base in range(0, len(values), PIECE):
        own = slice(*np.searchsorted(starts, (base, base + PIECE)))
        sums = prefix_sums(values[base : base + PIECE + most].astype(np.uint64) + np.uint64(1))
        out[own] = span_hash(sums, starts[own] - base, ends[own] - base)
    return out


class Regions:
    """Regions of one block that ``chosen`` selects: anchor hash, hash, document and start of each, and the distinct ones."""

    def __init__(self, values: np.ndarray, length: int, found: tuple[np.ndarray, ...], chosen: np.ndarray, ids: np.ndarray, offset: np.ndarray, places: bool) -> None:
        self.hash, at, self.lo, self.hi = (x[chosen] for x in found)
        self.r = spans(values, self.lo, self.hi + length) ^ mix((at - self.lo).astype(np.uint64))
        self.kinds, self.which = np.unique(self.r, return_inverse=True)
        self.doc, self.pos = _places(self.lo, ids, offset, places)

    def rows(self, block: int) -> pa.RecordBatch:
        """A row for each distinct region: its first and last place. A last row, of idx -1, is the ``scan`` that ``first_of`` and ``repeated`` read."""
        by = np.lexsort((self.pos, self.doc, self.which))
        new = np.diff(self.which[by], prepend=-1) != 0
        first = by[new]
        last = by[np.append(np.flatnonzero(new)[1:], len(by)) - 1] if len(by) else by
        columns = {
            "block": np.full(len(first), block),
            "idx": self.which[first].astype(np.int32),
            "h": self.hash[first].view(np.int64),
            "r": self.r[first].view(np.int64),
            "doc": self.doc[first],
            "pos": self.pos[first],
            "last_doc": self.doc[last],
            "last_pos": self.pos[last],
        }
        out = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()} | {"scan": pa.nulls(len(first), pa.binary())})
        scan = B.dumps(lo=np.diff(self.lo, prepend=0).astype(np.int64), n=(self.hi - self.lo + 1).astype(np.uint8), which=self.which.astype(np.int32))
        row = {c: pa.nulls(1, out.schema.field(c).type) for c in out.schema.names} | {"block": pa.array([block]), "idx": pa.array([-1], pa.int32()), "scan": pa.array([scan], pa.binary())}
        return pa.Table.from_batches([out, pa.RecordBatch.from_pydict(row, out.schema)]).combine_chunks().to_batches()[0]


def first_of(scan: bytes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first region of each wanted kind (idx) begins in its block, and its number of windows."""
    s = B.loads(scan)
    lo, n, which = np.cumsum(s["lo"]), s["n"].astype(np.int64), s["which"]
    one = np.zeros(int(which.max()) + 1, np.int64)
    one[which[::-1]] = np.arange(len(which))[::-1]
    return lo[one[wanted]], n[one[wanted]]


def _places(lo: np.ndarray, ids: np.ndarray, offset: np.ndarray, places: bool) -> tuple[np.ndarray, np.ndarray]:
    """doc_id of each region, and its start in the text (0 unless ``places`` count)."""
    doc = np.searchsorted(offset, lo, "right") - 1
    return ids[doc], lo - offset[doc] if places else np.zeros(len(lo), np.int64)


def repeated(scan: bytes | None, answers: pa.StructArray | None, ids: np.ndarray, offset: np.ndarray, places: bool) -> np.ndarray:
    """Whether the window at each unit of a block, whose texts lie between ``offset``, starts earlier too."""
    out = np.zeros(int(offset[-1]) + 1, bool)
    if scan is None or answers is None or not len(answers):
        return out
    s = B.loads(scan)
    lo, n = np.cumsum(s["lo"]), s["n"].astype(np.int64)
    idx, doc, pos, bits = (answers.field(c).to_numpy(zero_copy_only=False) for c in ("idx", "doc", "pos", "bits"))
    at = np.full(int(s["which"].max()) + 1, -1)
    at[idx] = np.arange(len(idx))
    a = at[s["which"]]
    lo, n, a = lo[a >= 0], n[a >= 0], a[a >= 0]
    own, start = _places(lo, ids, offset, places)
    later = (own > doc[a]) | (own == doc[a]) & (start > pos[a])
    mask = np.where(later, _ALL, bits[a].view(np.uint64))
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(lo, n) + inner] = (np.repeat(mask, n) >> inner.astype(np.uint64)) & np.uint64(1)
    return out


def recurring(anchors: DataFrame, documents: bool) -> DataFrame:
    """(block, got): the anchors of each block that occur again: in another document (``documents``), or anywhere.

    anchors: (h, block, low, high, many), a row for each anchor of a block; low and high are its least and greatest doc_id.
    """
    by = Window.partitionBy("h")
    again = F.min("low").over(by) < F.max("high").over(by) if documents else F.sum("many").over(by) > 1
    return anchors.withColumn("again", again).where("again").groupBy("block").agg(F.collect_list("h").alias("got"))


def several(first: DataFrame) -> DataFrame:
    """``first`` (h, r, ...) of those anchors that have n > 1 distinct regions."""
    return first.join(first.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h")


def cut_out(packed: DataFrame, found: DataFrame, regions: DataFrame, carry: tuple[str, ...], cut, more: str, name: str) -> DataFrame:
    """(carry..., more), written: ``regions`` (block, idx, carry...) with the column that cut(table, starts, windows) takes from their block."""
    wanted = regions.groupBy("block").agg(F.collect_list(F.struct("idx", *carry)).alias("wanted"))

    def run(_: int, table: pa.Table, scan: bytes, got: pa.StructArray):
        column = cut(table, *first_of(scan, got.field("idx").to_numpy()))
        yield pa.RecordBatch.from_pydict({c: got.field(c) for c in carry} | {more.split()[0]: column})

    own = found.where("idx < 0").select("block", "scan").join(wanted, "block")
    return runtime.materialise(with_blocks(packed, own, run, ", ".join(f"{c} long" for c in carry) + f", {more}", "inner"), name, settle=True)


def leads(packed: DataFrame, found: DataFrame, first: DataFrame, cut, more: str) -> DataFrame:
    """(h, r, doc, pos, n, ...), written: ``several`` regions with the column that cut(table, starts, windows) takes from their block."""
    return cut_out(packed, found, several(first), ("h", "r", "doc", "pos", "n"), cut, more, "leads")


def by_windows(leads: DataFrame, places: bool) -> DataFrame:
    """(h, r, bits) of regions (h, r, doc, pos, ws): one bit for each window (ws: their hashes) that starts earlier in another of them.

    places: whether an earlier place of the same document counts, too. A hash is compared within its anchor's hash.
    """
    start = F.col("pos") + F.col("i") if places else F.lit(0).cast("long")
    each = leads.select("h", "r", "doc", "pos", F.posexplode("ws").alias("i", "w")).select("h", "r", "i", "w", F.struct("doc", start.alias("start")).alias("here"))
    first = each.groupBy("h", "w").agg(F.min("here").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "w", "first")
    later = each.join(first, ["h", "w"]).where("here > first")
    return later.groupBy("h", "r").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits"))


def told(found: DataFrame, first: DataFrame, bits: DataFrame) -> DataFrame:
    """(block, idx, h, r, doc, pos, bits): what each block has to know of its regions: where a region's first place is, and which windows of that start earlier."""
    known = first.select("h", "r", "doc", "pos").join(bits, ["h", "r"], "left").select("h", "r", "doc", "pos", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    own = found.where("idx >= 0").select("block", "idx", "h", "r", F.struct(F.col("last_doc").alias("doc"), F.col("last_pos").alias("pos")).alias("last"))
    return own.join(known, ["h", "r"]).where((F.col("last") > F.struct("doc", "pos")) | (F.col("bits") != 0)).select("block", "idx", "h", "r", "doc", "pos", "bits")


def answers(found: DataFrame, told_: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(block, scan, got), written: ``told`` (and the columns ``more``) by block."""
    got = told_.groupBy("block").agg(F.collect_list(F.struct("idx", "doc", "pos", "bits", *more)).alias("got"))
    return runtime.materialise(found.where("idx < 0").select("block", "scan").join(got, "block"), "answers", settle=True)


def with_blocks(packed: DataFrame, own: DataFrame | None, fn, schema: str, how: str = "left") -> DataFrame:
    """Rows that fn(block, table, *values) yields for each block, the values being those that ``own`` (block, ...) has for it (arrays as Arrow arrays)."""
    names = [c for c in own.columns if c != "block"] if own is not None else []
    df = packed.select("block", "payload").join(own, "block", how) if names else packed.select("block", "payload")

    def value(x):
        return None if not x.is_valid else x.values if pa.types.is_list(x.type) else x.as_py()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from fn(b.column("block")[i].as_py(), B.unpack(b.column("payload")[i].as_py()), *[value(b.column(c)[i]) for c in names])

    return df.mapInArrow(run, schema)


def firsts(packed: DataFrame, anchors, regions, documents: bool) -> tuple[DataFrame, DataFrame]:
    """The distinct regions of all blocks whose anchors occur again (and each block's scan), and the first place of each: (h, r, doc, pos, block, idx); both written."""
    again = recurring(with_blocks(packed, None, anchors, "h long, block long, low long, high long, many int"), documents)
    found = runtime.materialise(with_blocks(packed, again, regions, f"{REGION}, scan binary", "inner"), "regions", settle=True)
    first = found.where("idx >= 0").groupBy("h", "r").agg(F.min(F.struct("doc", "pos", "block", "idx")).alias("x")).select("h", "r", "x.*")
    return found, runtime.materialise(first, "firsts", settle=True)
