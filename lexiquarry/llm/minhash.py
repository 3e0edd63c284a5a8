"""MinHash near-dedup with fast similarity sketches."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import runtime
from .hashing import gram_hash, lower, mix, prefix_sums, span_hash, word_hashes, words_of

SHINGLE = 5
#: A pair at the threshold shares no band with this probability at most, and has too few equal bins with this one.
NO_BAND, FEW_BINS = 4.3e-7, 1e-8
#: Bins of a band, and of a sketch, at most (but for thresholds so low that bands of one bin need more).
ROWS, BINS = 5, 190
#: Bands are searched in groups that begin with these; what one group has linked, the next needn't compare.
GROUPS = (0, 2, 8)
#: Members, and shingles of all members, in a chunk of a bucket, about; a tile compares two chunks.
CHUNK_ROWS, CHUNK_SHINGLES = 2048, 1 << 20
SEED = 0x51ED270B7F4A7C15
_RUN = 1 << 20
_FREE = np.uint64(2**64 - 1)


class Sketch(NamedTuple):
    """Shape of the sketches for one threshold: bands of so many rows (bins), and the equal bins (by 8 bits each) that a pair needs."""

    bands: int
    rows: int
    least: int

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    @property
    def groups(self) -> list[tuple[int, int]]:
        """First band, and the one after the last, of each group."""
        cuts = [g for g in GROUPS if g < self.bands] + [self.bands]
        return list(zip(cuts, cuts[1:]))


@functools.cache
def shape(percent: int) -> Sketch:
    """The sketch that loses a pair at a similarity of ``percent`` with ``NO_BAND`` and ``FEW_BINS`` at most; 25 bands of 5 at 85.

    Bands are as selective (of as many bins) as a sketch of ``BINS`` allows.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    s = percent / 100
    needed = {r: 1 if s == 1 else math.ceil(math.log(NO_BAND) / math.log1p(-(s**r))) for r in range(ROWS, 0, -1)}
    rows = next((r for r, b in needed.items() if r * b <= BINS), 1)
    t = rows * needed[rows]
    least, below = 0, 0.0
    # the binomial law's lower tail
    while least < t and (below := below + math.comb(t, least) * s**least * (1 - s) ** (t - least)) <= FEW_BINS:
        least += 1
    return Sketch(needed[rows], rows, least)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct hashes, sorted, of each text's 5-word shingles, A-Z lower-cased; all words as one where they are fewer."""
    out: list[np.ndarray] = []
    for a, b in B.runs([len(t) + 1 for t in texts], _RUN):
        buf = lower(np.frombuffer(b"\n".join(texts[a:b]), np.uint8))
        starts, ends = words_of(buf)
        words = word_hashes(buf, starts, ends)
        cut = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts[a:b]]])).tolist()
        for x, y in zip(cut, cut[1:]):
            if y - x >= SHINGLE:
                out.append(np.unique(gram_hash(words[x:y], SHINGLE)))
            elif y > x:
                out.append(span_hash(prefix_sums(words[x:y]), np.array([0]), np.array([y - x])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """t bins for each set, all filled (but for an empty set's).

    Round i throws every element into a bin that its hash chooses, with a value that starts with i, and
    a bin keeps its least value. After t rounds, round t + i throws all elements into bin i. So
    at the end each bin holds the least of some round, rounds end as soon as no bin is empty, and
    the share of equal bins of two sets is concentrated around their similarity as with t independent hashes.
    """
    bins = np.full((len(sets), t), _FREE)
    sizes = np.array([len(s) for s in sets])
    open_ = np.flatnonzero(sizes)
    flat = bins.reshape(-1)
    for i in range(2 * t):
        if not len(open_):
            break
        x = np.concatenate([sets[j] for j in open_])
        own = np.repeat(open_, sizes[open_]) * t
        h = mix(x ^ np.uint64((SEED * (2 * i + 1)) & (2**64 - 1)))
        to = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(x), i - t)
        value = (np.uint64(i) << np.uint64(32)) | (mix(h) & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, own + to, value)
        open_ = open_[(bins[open_] == _FREE).any(axis=1)]
    return bins


def bands(bins: np.ndarray, rows: int) -> np.ndarray:
    h = np.zeros((len(bins), bins.shape[1] // rows), np.uint64)
    for r in range(rows):
        h = mix(h * np.uint64(0x100000001B3) + bins[:, r::rows])
    return h.view(np.int64)


def sketches(packed: DataFrame, form: Sketch) -> DataFrame:
    """Per row: node (block and row as one long), doc_id, n (size of its set), sig (128 bits of the set), bands, bins (8 bits of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                table = B.unpack(payload.as_py())
                ids, texts = B.texts(table)
                sets = shingle_sets(texts)
                bins = np.concatenate([sketch(sets[a:b], form.bins) for a, b in B.runs([len(s) for s in sets], _RUN // 4)])
                h, low = bands(bins, form.rows), mix(bins).astype(np.uint8)
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array((block << 16) + np.arange(len(ids))),
                        "doc_id": pa.array(ids),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "sig": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        "bands": pa.array([x.tolist() if len(s) else None for x, s in zip(h, sets)], pa.list_(pa.int64())),
                        "bins": pa.array([x.tobytes() if len(s) else None for x, s in zip(low, sets)], pa.binary()),
                    }
                )

    return packed.select("block", "payload").mapInArrow(run, "node long, doc_id long, n long, sig binary, bands array<bigint>, bins binary")


def _sets(packed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, items) of the nodes given: their full sets, computed anew from the texts."""
    wanted = nodes.groupBy(F.shiftright("node", 16).alias("block")).agg(F.collect_list("node").alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, own in zip(batch.column("payload"), batch.column("nodes").to_pylist()):
                ids = np.array(sorted(own), np.int64)
                texts = [t.as_py() for t in B.unpack(payload.as_py()).column("text").cast(pa.binary()).take(pa.array(ids & 0xFFFF))]
                yield pa.RecordBatch.from_pydict({"node": pa.array(ids), "items": pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())})

    return packed.select("block", "payload").join(wanted, "block").mapInArrow(run, "node long, items binary")


def _alike(pairs: DataFrame, nodes: DataFrame, form: Sketch) -> DataFrame:
    """Pairs (a, b, n_a, n_b) whose sketches have enough equal bins."""
    bins = nodes.select("node", "bins")
    both = pairs.join(bins.select(F.col("node").alias("a"), F.col("bins").alias("x")), "a").join(bins.select(F.col("node").alias("b"), F.col("bins").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, form.bins) for c in ("x", "y"))
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array((x == y).sum(axis=1) >= form.least))

    return both.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a long, b long, n_a long, n_b long")


def _verify(packed: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the size of their sets' intersection, counted on the full sets."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = runtime.materialise(_sets(packed, ends), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n.append(len(np.intersect1d(x, y, assume_unique=True)))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "n_a": batch.column("n_a"), "n_b": batch.column("n_b"), "shared": pa.array(n, pa.int64())})

    out = runtime.materialise(both.select("a", "b", "n_a", "n_b", "items_a", "items_b").mapInArrow(run, "a long, b long, n_a long, n_b long, shared long"), "verified")
    runtime.discard(sets)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each linked node (a, b) reaches.

    Every round takes the least label of the neighbours and then the label of that label, so paths halve
    as they are walked; each round is written out before the next.
    """
    edges = runtime.materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = runtime.materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        old = labels
        near = edges.join(old.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = old.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("next"))
        jump = old.select(F.col("node").alias("next"), F.col("component").alias("up"))
        labels = runtime.materialise(new.join(jump, "next", "left").select("node", "was", F.least("next", F.coalesce("up", "next")).alias("component")), "labels")
        runtime.discard(old)
        changed = labels.where("was <> component").limit(1).count()
        if not changed:
            return labels.select("node", "component")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose nodes are not yet in one component."""
    label = found.select("node", "component")
    both = pairs.join(label.select(F.col("node").alias("a"), F.col("component").alias("c_a")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("component").alias("c_b")), "b", "left")
    return both.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")


def _left_apart(packed: DataFrame, spokes: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket that the links of its least node left in different components.

    Only buckets whose members are of several components are looked at, and of those with the same members one, as bands of
    alike texts make the same bucket over and over: 128 bits of hashes and a count tell them apart, and whichever hub the one
    that stays has, all pairs of different components are compared. A bucket goes through in tiles: the members outside the least node's component, in chunks, against all members, in chunks. A
    tile compares full sets, and passes over members that its earlier links have joined already, so it returns at
    most one link for each component that it joins to another: fewer rows than it has members.
    """
    label = found.select("node", "component")
    here = spokes.where("node <> hub").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    here = here.join(label.select(F.col("node").alias("hub"), F.col("component").alias("c")), "hub", "left").withColumn("apart", F.col("component") != F.coalesce("c", "hub"))
    here = runtime.materialise(here.select("bucket", "node", "n", "component", "apart"), "members")
    chunks = lambda rows, n: F.ceil(F.greatest(rows / CHUNK_ROWS, n / CHUNK_SHINGLES)).cast("int")
    own = [F.when(F.col("apart"), x) for x in (F.lit(1), F.col("n"))]
    same = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"same{i}") for i in range(2)]
    ends = [F.min("component").alias("least"), F.max("component").alias("most")]
    sizes = here.groupBy("bucket").agg(chunks(F.count(own[0]), F.sum(own[1])).alias("lefts"), chunks(F.count(F.lit(1)), F.sum("n")).alias("rights"), F.count(F.lit(1)).alias("rows"), *ends, *same)
    sizes = sizes.where("lefts > 0 AND least < most").groupBy("rows", "same0", "same1").agg(F.min(F.struct("bucket", "lefts", "rights")).alias("x")).select("x.*")
    tiled = here.join(sizes, "bucket").withColumn("p", F.pmod(F.xxhash64("node"), "lefts").cast("int")).withColumn("q", F.pmod(F.xxhash64("node"), "rights").cast("int"))
    tile = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    as_left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda q: tile(F.col("p"), q))
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda p: tile(p, F.col("q")))
    placed = tiled.withColumn("tile", F.explode(F.when(F.col("apart"), F.array_union(as_left, as_right)).otherwise(as_right)))
    placed = placed.select("bucket", "tile", "node", "component", (F.col("apart") & (F.col("tile.p") == F.col("p"))).alias("left"), (F.col("tile.q") == F.col("q")).alias("right"))
    placed = runtime.materialise(placed, "tiles")
    sets = runtime.materialise(_sets(packed, placed.select("node").distinct()), "sets")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node, c, left, right = (pdf[x].to_numpy().copy() for x in ("node", "component", "left", "right"))
        sets = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        n = np.array([len(x) for x in sets])
        seen, flat = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.split(flat.astype(np.int32), np.cumsum(n)[:-1])
        mark = np.zeros(len(seen), bool)
        out = [np.zeros((0, 2), np.int64)]
        for i in np.flatnonzero(left):
            j = np.flatnonzero(right & (c != c[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent))
            if not len(j):
                continue
            mark[own[i]] = True
            shared = np.add.reduceat(mark[np.concatenate([own[x] for x in j])], np.cumsum(n[j]) - n[j], dtype=np.int64)
            mark[own[i]] = False
            j = j[shared * 100 >= (n[i] + n[j] - shared) * percent]
            joined, first = np.unique(c[j], return_index=True)
            out.append(np.stack((np.full(len(first), node[i]), node[j[first]]), axis=1))
            c[np.isin(c, joined)] = c[i]
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    both = placed.join(sets, "node").select("bucket", "tile", "node", "component", "left", "right", "items")
    links = runtime.materialise(both.groupBy("bucket", "tile").applyInPandas(compare, "a long, b long").distinct(), "rest")
    runtime.discard(here, placed, sets)
    return links


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts with 100 * intersection >= percent * union of their 5-word shingle sets are linked; component_id is the
    smallest doc_id that a row reaches by links, itself included. Null and empty texts, and those without words, have an empty
    set and are linked with nothing. Rows of equal sets are one node (their doc_ids may repeat); a null
    doc_id is the smallest and gives a null component_id. kept: doc_id = component_id; of rows that repeat a
    doc_id all are kept, or none.

    Candidates share a band of their sketches; of those whose sketches agree enough, every link is confirmed on the
    full sets. Bands are searched in groups. In a bucket, members whose component isn't yet that of the bucket's least
    node are compared with that node: a row each, not all pairs. In the end, members that are still outside their least
    node's component are compared with the other members of other components on full sets, in tiles of bounded size that
    return a spanning set of links. So a bucket of thousands of linked copies costs its size, and no rows or stored bytes grow with
    the square of a bucket of up to a chunk; beyond it, members are sent once for each chunk. Texts of a family that are alike but
    below the threshold are compared with each other in arrays, whose time grows with the square of the family. The sketches'
    ``shape`` follows ``percent``, so a link is lost with a probability of about 4e-7 at most, whatever the threshold.
    """
    form = shape(percent)
    packed = B.pack(docs)
    rows = runtime.materialise(sketches(packed, form), "sketches")
    nodes = runtime.materialise(rows.where("n > 0").groupBy("sig").agg(F.min(F.struct("doc_id", "node", "n", "bands", "bins")).alias("x")).select("sig", "x.*"), "nodes")
    close = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    is_link = F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent
    links, found, spokes, compared, tables = None, None, None, None, []
    for low, high in form.groups:
        # one long stands for band and hash
        each = F.transform(F.slice("bands", low + 1, high - low), lambda h, i: F.xxhash64(i + low, h))
        members = nodes.select("node", "n", F.explode(each).alias("bucket"))
        buckets = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
        own = runtime.materialise(members.join(buckets, "bucket").select("bucket", "node", "n", "hub"), "spokes")
        spokes = own if spokes is None else spokes.unionByName(own)
        pairs = own.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("n").alias("n_b")).distinct()
        if found is not None:
            pairs = _apart(pairs, found)
            # what an earlier group has compared in vain
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").where(close(F.col("n_a"), F.col("n_b")))
        # written first, so that Spark knows its size when it plans the joins with the sketches
        candidates = runtime.materialise(pairs, "candidates")
        pairs = runtime.materialise(_alike(candidates, nodes, form), "pairs")
        runtime.discard(candidates)
        compared = pairs.select("a", "b") if compared is None else compared.unionByName(pairs.select("a", "b"))
        new = _verify(packed, pairs).where(is_link).select("a", "b")
        links = new if links is None else links.unionByName(new)
        found = runtime.materialise(components(links), "components")
        tables += [own, pairs]

    more = _left_apart(packed, spokes, found, percent)
    if more.limit(1).count():
        found = components(links.unionByName(more))
    runtime.discard(packed, *tables)
    named = nodes.join(found, "node", "left").select("sig", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(least, "component").select("sig", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(by_set, "sig", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    real = lambda c: F.when(F.col(c) != B.NULL_ID, F.col(c)).alias(c)
    return out.select(real("doc_id"), "n_shingles", real("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))
