"""Exact set-similarity pairs by sizes and parities, then on whole sets."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import token_set
from ..sources.stored import scratch

#: About how many rows and bytes of parities a tile has on each side, and the most bits of a set's parities.
BLOCK, BYTES = 1 << 17, 1 << 25
_WIDEST = 1 << 14
#: Bands of sizes in which a pair's larger set may be beyond its smaller one's.
_BEYOND = 2
#: About how many rows of equal sets stand together, and up to how many rows with a candidate are told to all executors.
COPIES = 1024
TOLD = 1 << 21
_EPS = 1e-9
#: Rows and columns that are compared at a time, tokens and pairs that are looked up or given out at a time.
_STEP, _WIDE, _MANY = 16, 8192, 1 << 20


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table(df: DataFrame, text: Column, id: str, group: str, stopwords: Sequence[str]) -> DataFrame:
    """(row, g, id, class, n, s) of all rows with tokens, stored: a number of its own, what equal token sets of a group have in common, and the tokens' hashes in order."""
    # a hash stands for the token; rows are numbered before those without tokens go, else the sets would be made once more for that
    hashed = df.select(F.monotonically_increasing_id().alias("row"), F.col(group).alias("g"), F.col(id).alias("id"), F.sort_array(F.transform(token_set(text, stopwords), lambda x: F.xxhash64(x))).alias("s"))
    rows = hashed.where((F.size("s") > 0) & F.col("g").isNotNull())
    return _stored(rows.select("row", "g", "id", F.struct(F.xxhash64("g", "s").alias("p"), F.xxhash64(F.lit(1), "g", "s").alias("q")).alias("class"), F.size("s").alias("n"), "s"), "sets")


def _classes(table: DataFrame) -> DataFrame:
    """(row, g, class, n, ids, parts), stored: rows of equal sets, under the least of their numbers, with all ids in order; a class of many rows is dealt to several parts."""
    many = table.groupBy("class").agg(F.ceil(F.count("*") / F.lit(COPIES)).cast("int").alias("m")).where("m > 1").withColumnRenamed("class", "c")
    dealt = table.select("row", "g", "id", "class", "n").join(F.broadcast(many), F.col("class") == F.col("c"), "left").withColumn("parts", F.coalesce("m", F.lit(1)))
    own = dealt.groupBy("class", "parts", F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"))
    return _stored(own.agg(F.min("row").alias("row"), F.first("g").alias("g"), F.first("n").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).select("row", "g", "class", "n", "ids", "parts"), "classes")


def _width(most: np.ndarray, threshold: float) -> np.ndarray:
    """Bits of the parities of two sets of at most so many tokens in all: twice as many words as those that are looked at first."""
    return np.clip(128 * np.ceil(0.2 / threshold**2 * most / 64), 128, _WIDEST).astype(np.int64)


def _parity(tokens: np.ndarray, n: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bits of all sets, one after the other, packed: a bit tells whether the set has an odd number of tokens with this remainder by the width."""
    ends = np.cumsum(width)
    at = np.repeat(ends - width, n) + (tokens.view(np.uint64) % np.repeat(width, n).astype(np.uint64)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8), bitorder="little")


def _parities(threshold: float):
    """(row, b0, b1 ..) of (row, band, s): parities to compare with sets of the lowest band of sizes that may fit, up to the highest one. Two sets differ in at least as many tokens as bits."""
    ratio = 1 / threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            n = whole.column("s").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            band = whole.column("band").to_numpy().astype(np.int64)
            # where the bands of the smaller and of the larger set end; only sizes that fit count
            ends = [[ratio ** ((x + 1) / _BEYOND) for x in (np.minimum(band, band + d), np.maximum(band, band + d))] for d in range(-_BEYOND, _BEYOND + 1)]
            widths = [_width(x + np.minimum(y, x * ratio), threshold) for x, y in ends]
            # a bounded number of bits at a time
            cuts = np.flatnonzero(np.diff(np.cumsum(widths[-1]) >> 22)) + 1
            for i, j in itertools.pairwise([0, *cuts.tolist(), len(n)]):
                part, columns = whole.slice(i, j - i), []
                tokens = part.column("s").flatten().to_numpy()
                for width in widths:
                    offsets = np.concatenate([[0], np.cumsum(width[i:j]) // 8]).astype(np.int32)
                    columns.append(pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(_parity(tokens, n[i:j], width[i:j]))]))
                yield pa.RecordBatch.from_arrays([part.column("row"), *columns], names=["row", *(f"b{x}" for x in range(len(columns)))])

    return run


def _fitting(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], threshold: float, same: bool, step: int, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (p, q) of pairs that sizes and parities let be at the threshold; a side is (n, parities as words), in order of n. ``step`` rows p at a time."""
    (n_a, a), (n_b, b) = one, two
    half = a.shape[1] // 2
    # half as wide, by adding bits that fall together
    x, y = a[:, :half] ^ a[:, half:], np.ascontiguousarray((b[:, :half] ^ b[:, half:]).T)
    # by the sum of both sizes: how many tokens may differ
    sums = np.arange(int(n_a[-1] + n_b[-1]) + 1) if len(n_a) and len(n_b) else np.arange(1)
    most = sums - 2 * np.ceil(sums * (threshold / (1 + threshold)) - _EPS).astype(np.int64)
    # no smaller sum has more
    loose = np.minimum(np.floor(sums * ((1 - threshold) / (1 + threshold))) + 1, 65535).astype(np.uint16)
    bits, few, sum_, differ = (np.empty(step * wide, t) for t in (np.uint64, np.uint8, np.uint8, np.uint16))
    fits = np.empty(step * wide // 8 + 1, np.uint64)
    for i in range(0, len(n_a), step):
        n_x = n_a[i : i + step]
        lo, hi = np.searchsorted(n_b, n_x[0] * threshold - _EPS), np.searchsorted(n_b, n_x[-1] / threshold + _EPS, "right")
        for j in range(max(lo, i + 1) if same else lo, hi, wide):
            end = min(j + wide, hi)
            shape, size = (len(n_x), end - j), len(n_x) * (end - j)
            c, u, v, d = (buffer[:size].reshape(shape) for buffer in (bits, few, sum_, differ))
            # a few words' sum fits a byte
            for k in range(0, half, 3):
                for w in range(k, min(k + 3, half)):
                    np.bitwise_xor(x[i : i + step, w, None], y[w, j:end], out=c)
                    np.bitwise_count(c, out=v if w == k else u)
                    if w > k:
                        np.add(v, u, out=v)
                if k:
                    np.add(d, v, out=d)
                else:
                    d[...] = v
            fits[(size - 1) // 8] = 0
            np.less_equal(d, loose[n_x[-1] + n_b[j:end]], out=fits.view(bool)[:size].reshape(shape))
            # eight pairs in a word
            at = np.flatnonzero(fits[: (size + 7) // 8])
            if not len(at):
                continue
            at = (at[:, None] * 8 + np.arange(8)).ravel()
            at = at[fits.view(bool)[at]]
            p, q = at // shape[1] + i, at % shape[1] + j
            smaller, larger = np.minimum(n_a[p], n_b[q]), np.maximum(n_a[p], n_b[q])
            fit = smaller >= larger * threshold - _EPS
            if same:
                fit &= q > p
            p, q = p[fit], q[fit]
            fit = np.concatenate([np.bitwise_count(a[p[z : z + wide]] ^ b[q[z : z + wide]]).sum(axis=1, dtype=np.int64) for z in range(0, max(len(p), 1), wide)]) <= most[n_a[p] + n_b[q]]
            if fit.any():
                yield p[fit], q[fit]


_TILE = ["g", "x", "y", "i", "j"]


def _with_any(threshold: float):
    """Rows of a tile that have a pair which sizes and parities let be at the threshold, and on which side."""

    def run(tile: pa.Table) -> pa.Table:
        left = tile.column("left").to_numpy(zero_copy_only=False)
        own = tile.column("own")[0].as_py()
        n = tile.column("n").to_numpy().astype(np.int64)
        words = np.frombuffer(b"".join(tile.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
        order = np.argsort(n, kind="stable")
        one = order[left[order]]
        two = one if own else order[~left[order]]
        any_ = np.zeros(len(n), bool)
        for p, q in _fitting((n[one], words[one]), (n[two], words[two]), threshold, own, _STEP, _WIDE):
            any_[one[p]] = any_[two[q]] = True
        return tile.select([*_TILE, "left", "own", "row"]).filter(pa.array(any_))

    return run


def _alike_in_tile(threshold: float):
    """(g, x, y, similarity): ids of all rows whose different sets are at the threshold, by their whole sets."""

    def found(tile: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows (a, b) of the tile and their similarity."""
        left = tile.column("left").to_numpy(zero_copy_only=False)
        own = tile.column("own")[0].as_py()
        sets = tile.column("s").combine_chunks()
        n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        tokens, starts = sets.flatten().to_numpy(), np.cumsum(n) - n
        width = np.full(len(n), _width(2 * n.max(), threshold))
        words = _parity(tokens, n, width).view(np.uint64).reshape(len(n), -1)
        distinct, names = np.unique(tokens, return_inverse=True)
        order = np.argsort(n, kind="stable")
        one = order[left[order]]
        two = one if own else order[~left[order]]
        has, last = np.zeros((_STEP, len(distinct)), bool), -1
        for p, q in _fitting((n[one], words[one]), (n[two], words[two]), threshold, own, _STEP, _WIDE):
            step = p[0] // _STEP
            if step != last:
                for number, value in ((last, False), (step, True)):
                    for k, row in enumerate(one[number * _STEP : (number + 1) * _STEP]) if number >= 0 else ():
                        has[k, names[starts[row] : starts[row] + n[row]]] = value
                last = step
            a, b = one[p], two[q]
            # a bounded number of tokens at a time
            cuts = np.flatnonzero(np.diff(np.cumsum(n[b]) // _MANY)) + 1
            for i, j in itertools.pairwise([0, *cuts.tolist(), len(a)]):
                size = n[b[i:j]]
                ends = np.cumsum(size)
                at = np.repeat(starts[b[i:j]] - ends + size, size) + np.arange(ends[-1])
                shared = np.add.reduceat(has[np.repeat(p[i:j] - step * _STEP, size), names[at]], ends - size, dtype=np.int64)
                union = n[a[i:j]] + size - shared
                similarity = shared / union
                # equal sets are of one class
                fit = (similarity >= threshold) & (shared < union)
                yield a[i:j][fit], b[i:j][fit], similarity[fit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(list(batches))
        lists = tile.column("ids").combine_chunks()
        many, ids, group = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten(), tile.column("g").combine_chunks()
        starts = np.cumsum(many) - many
        for a, b, similarity in found(tile):
            each = many[a] * many[b]
            cuts = np.flatnonzero(np.diff(np.cumsum(each) // _MANY)) + 1
            for i, j in itertools.pairwise([0, *cuts.tolist(), len(a)]):
                if not each[i:j].sum():
                    continue
                pair = np.repeat(np.arange(i, j), each[i:j])
                k = np.arange(len(pair)) - np.repeat(np.cumsum(each[i:j]) - each[i:j], each[i:j])
                x, y = (pa.array(starts[row[pair]] + place) for row, place in ((a, k // many[b[pair]]), (b, k % many[b[pair]])))
                yield pa.RecordBatch.from_arrays([group.take(pa.array(np.zeros(len(pair), np.int64))), ids.take(x), ids.take(y), pa.array(similarity[pair])], names=["g", "x", "y", "similarity"])

    return run


def _numbers(k: str) -> Column:
    return F.sequence(F.lit(0), F.col(k) - 1)


def _tiles(sets: DataFrame, threshold: float) -> DataFrame:
    """(g, row, n, band, t) of ``sets`` (g, row, n, band), each in the tiles t of two blocks of rows where it meets all that its size may fit.

    The bands of a pair's sizes are ``_BEYOND`` apart at most. A band of a group is dealt to blocks of about ``BLOCK`` rows, or ``BYTES``, each of which meets the blocks of its own band and of those near it.
    """
    ratio = 1 / threshold
    longest = F.least(F.pow(F.lit(ratio), (F.col("band") + 1) / _BEYOND) * (0.4 * ratio**2 * (1 + ratio)), F.lit(_WIDEST)) / 8
    # only bands of several blocks are listed
    large = sets.groupBy("g", "band").agg(F.count("*").alias("rows")).select("g", "band", F.ceil(F.col("rows") * F.greatest(F.lit(1 / BLOCK), longest / F.lit(BYTES))).cast("int").alias("k")).where("k > 1")

    def counted(rows: DataFrame, shift: int) -> DataFrame:
        k = large.select(F.col("g").alias("_g"), (F.col("band") - shift).alias("_band"), F.col("k").alias("_k"))
        joined = rows.join(F.broadcast(k), (F.col("g") == F.col("_g")) & (F.col("band") == F.col("_band")), "left")
        return joined.withColumn(f"k{shift}", F.coalesce("_k", F.lit(1))).drop("_g", "_band", "_k")

    rows = functools.reduce(counted, range(-_BEYOND, _BEYOND + 1), sets)
    rows = rows.withColumn("i", F.pmod(F.xxhash64("row"), F.col("k0")).cast("int"))
    # of a tile: the larger band x and the smaller one y, and the block of each
    tile = lambda x, y, i, j, left, own: F.struct(x.alias("x"), y.alias("y"), i.alias("i"), j.alias("j"), left.alias("left"), own.alias("own"))
    b, i = F.col("band"), F.col("i")
    up = lambda d: F.transform(_numbers(f"k{d}"), lambda j: tile(b + d, b, j, i, F.lit(False), F.lit(False)))
    down = lambda d: F.transform(_numbers(f"k{-d}"), lambda j: tile(b, b - d, i, j, F.lit(True), F.lit(False)))
    tiles = [F.transform(_numbers("k0"), lambda j: tile(b, b, F.least(i, j), F.greatest(i, j), i <= j, i == j))]
    tiles += [side(d) for d in range(1, _BEYOND + 1) for side in (up, down)]
    return rows.select("g", "row", "n", "band", F.concat(*tiles).alias("t"))


def _alike(table: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(g, x, y, similarity): ids of rows of different classes at the threshold."""
    kind, key = (table.schema[x].dataType.simpleString() for x in ("g", "id"))
    band = F.floor(F.log("n") * F.lit(_BEYOND / -math.log(threshold)) + F.lit(_EPS)).cast("int").alias("band")
    names = [f"b{x}" for x in range(2 * _BEYOND + 1)]
    bits = table.select("row", band, "s").mapInArrow(_parities(threshold), ", ".join(["row long", *(f"{x} binary" for x in names)]))
    each = bits.join(_tiles(classes.select("g", "row", "n", band), threshold), "row").withColumn("t", F.explode("t"))
    # one of a tile's bands is the row's own
    beyond = F.col("t.x") + F.col("t.y") - 2 * F.col("band") + _BEYOND
    of_tile = F.coalesce(*[F.when(beyond == i, F.col(x)) for i, x in enumerate(names)])
    tiles = each.select("g", "row", "n", of_tile.alias("bits"), "t.*").groupBy(*_TILE)
    rows = _stored(tiles.applyInArrow(_with_any(threshold), f"g {kind}, x int, y int, i int, j int, left boolean, own boolean, row long"), "rows")
    # the whole sets of these rows meet in the same tiles
    needed = rows.select("row").distinct()
    told = F.broadcast(needed) if needed.count() <= TOLD else needed
    full = rows.join(table.select("row", "s").join(told, "row", "left_semi"), "row").join(classes.select("row", "ids"), "row")
    return full.select(*_TILE, "left", "own", "s", "ids").groupBy(*_TILE).applyInArrow(_alike_in_tile(threshold), f"g {kind}, x {key}, y {key}, similarity double")


def _copies(classes: DataFrame) -> DataFrame:
    """(g, x, y, similarity): ids of rows of one class."""
    placed = classes.where(F.size("ids") > 1).select("g", "ids", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("place"))
    within = placed.select("g", F.element_at("ids", F.col("place")).alias("x"), F.explode(F.slice("ids", F.col("place") + 1, F.size("ids"))).alias("y"))
    parts = classes.where("parts > 1").select("g", "class", "row", "ids")
    other = parts.select("class", F.col("row").alias("other"), F.col("ids").alias("others"))
    across = parts.join(other, "class").where("row < other").select("g", "others", F.explode("ids").alias("x")).select("g", "x", F.explode("others").alias("y"))
    return within.unionByName(across).withColumn("similarity", F.lit(1.0))


def pairs(df: DataFrame, text: Column, threshold: float = 0.5, id: str = "id", group: str = "subject", dismissed: DataFrame | None = None, stopwords: Sequence[str] = fixed.STOPWORDS) -> DataFrame:
    """Pairs (id_a < id_b) of a group whose token sets have a Jaccard similarity of the threshold or more.

    Returns group, id_a, id_b, overlap (three decimals), exact (0.999 or more). Empty sets and null groups match nothing; rows that share an id are
    compared each by itself with all others, and never with each other; pairs of ``dismissed`` (id_a, id_b in any order) are left out.

    Equal sets are one class, compared once. Token sets are stored once, in ``spark.checkpoint.dir``. Two sets differ in at least as many tokens as their parity bits do (``_parities``), so no pair at the threshold,
    which may differ in at most (x + y) (1 - t) / (1 + t) tokens, is lost when all sets of a group whose sizes fit are compared by these bits, in tiles of bounded size. This tells which rows have a candidate in a tile;
    only their whole sets meet there again and are counted. Pairs are never shuffled before they are the result. Time grows with the square of a group's classes of like sizes.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    table = _table(df, text, id, group, stopwords)
    classes = _classes(table)
    found = _copies(classes)
    if threshold < 1:
        found = _alike(table, classes, threshold).unionByName(found)
    found = found.where("x <> y").select("g", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    if dismissed is not None:
        found = found.join(dismissed.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")), ["id_a", "id_b"], "left_anti")
    return found.select(F.col("g").alias(group), "id_a", "id_b", F.round("similarity", 3).alias("overlap"), (F.col("similarity") >= 0.999).alias("exact"))


def ranked(found: DataFrame) -> DataFrame:
    """Pairs from the most alike down."""
    return found.orderBy(F.col("overlap").desc(), "id_a", "id_b")


def participants(df: DataFrame, found: DataFrame, id: str = "id") -> DataFrame:
    """Rows of ``df`` that are in a pair."""
    # each pair is made once, and ends are put together before they are sent
    ends = found.select(F.explode(F.array("id_a", "id_b")).alias(id)).distinct()
    return df.join(ends, id, "left_semi")


def canonical_pairs(pairs_: DataFrame) -> DataFrame:
    """Dismissed pairs, each once, the smaller id first."""
    return pairs_.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).dropDuplicates()


def numbered(found: DataFrame, group: str) -> DataFrame:
    """Pairs with their place within the group, from the most alike down."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.col("overlap").desc(), "id_a", "id_b")))
