"""Exact top-k for a whole table of query vectors, pruned by pivots and the triangle inequality of angles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import scratch

#: Pivots, the rows they are chosen from, and the rows and queries of a tile. They change the time, never the result.
PIVOTS, SAMPLE, ROWS, QUERIES = 64, 2048, 8192, 1024
#: So many cells are sent to all executors; there are more only if vectors come in about as many sizes.
CELLS = 100_000
#: Similarities are rounded to six digits, and an arc cosine is good to about 1e-8: bounds are wider by this, in either unit.
SLACK = 1e-6


class Nearest(NamedTuple):
    #: query_id, rank from 1, the row's id, similarity
    found: DataFrame
    #: one row: pairs (all of queries and rows of equal size), compared (those whose similarity was computed)
    pruning: DataFrame


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, of those rows of v that have a finite length above 0, and which these are."""
    with np.errstate(all="ignore"):
        norm = np.sqrt((v * v).sum(axis=1))
        good = (norm > 0) & (norm < np.inf)
        return v[good] / norm[good, None], good


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by vector size, each the farthest from those before, from a sample of bounded size."""
    by_size: dict[int, list] = {}
    sample = rows.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").collect()
    for r in sample:
        by_size.setdefault(len(r["v"]), []).append([np.nan if x is None else x for x in r["v"]])
    out = {}
    for size, vectors in by_size.items():
        u = _unit(np.array(vectors, np.float64))[0]
        if not len(u):
            continue
        chosen, nearest = [0], _angles(u, u[:1])[:, 0]
        while len(chosen) < PIVOTS * len(u) // len(sample) and nearest.max() > SLACK:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, _angles(u, u[chosen[-1:]])[:, 0])
        out[size] = u[chosen]
    return out


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1, 1))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _vectors(df: DataFrame, id: str, embedding: str) -> DataFrame:
    return df.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("v")).where(F.size("v") > 0)


def _with_angles(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """id, size, unit, angles: vectors of length 1 and their angles to each pivot of their size, none for a size without pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column("v")).to_numpy()
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                # nulls become NaN
                unit, good = _unit(_matrix(part.column("v").cast(pa.list_(pa.float64())), size))
                some = pivots.get(int(size))
                angles = _angles(unit, some) if some is not None else np.zeros((len(unit), 0))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (unit, angles)]
                yield pa.RecordBatch.from_arrays([part.column("id").filter(pa.array(good)), pa.array(np.full(len(unit), size, np.int32)), *lists], ["id", "size", "unit", "angles"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, size int, unit array<double>, angles array<double>")


def _radius(similarity: Column) -> Column:
    """The greatest angle at which a rounded similarity can still reach this one."""
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), similarity - SLACK))) + SLACK


def _tiles(rows: DataFrame, cells: DataFrame, few: bool, pairs: DataFrame, k: int, at_least: float) -> DataFrame:
    """The best k rows of each tile for each of its queries; and a row for each tile, with q null, that says how many pairs it compared.

    A cell's rows and its queries are dealt to as many tiles as their numbers need, so a cell may hold any share of all rows.
    """
    asked = pairs.groupBy("size", "cell").agg(F.count("*").alias("m"))
    plan = cells.join(asked, ["size", "cell"]).select("size", "cell", F.ceil(F.col("n") / ROWS).alias("rs"), F.ceil(F.col("m") / QUERIES).alias("qs"))
    # so that a cell of many rows isn't gathered to learn its number of tiles
    plan = F.broadcast(plan) if few else plan
    copies = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = rows.join(plan, ["size", "cell"]).select("size", "cell", F.pmod(F.xxhash64("place"), F.col("rs")).alias("r"), copies("qs").alias("s"), "id", "unit", "angle")
    right = pairs.join(plan, ["size", "cell"]).select("size", "cell", copies("rs").alias("r"), F.pmod(F.xxhash64("q"), F.col("qs")).alias("s"), "q", "query_id", F.col("unit"), "angle", "radius", "floor")
    of, to = (df.schema[c].dataType.simpleString() for df, c in ((right, "query_id"), (left, "id")))

    def run(have: pa.Table, want: pa.Table) -> pa.Table:
        counts, found, best = 0, [], []
        if have.num_rows and want.num_rows:
            size = have.column("size")[0].as_py()
            have = have.sort_by("angle")
            angle, unit = have.column("angle").to_numpy(), _matrix(have.column("unit"), size)
            alpha, radius, floor = (want.column(c).to_numpy() for c in ("angle", "radius", "floor"))
            first, last = np.searchsorted(angle, alpha - radius), np.searchsorted(angle, alpha + radius, "right")
            counts = int((last - first).sum())
            rank = have.select(["id"]).append_column("at", pa.array(np.arange(have.num_rows))).sort_by("id").column("at").to_numpy().argsort()
            for i, u in enumerate(_matrix(want.column("unit"), size)):
                s = np.round(unit[first[i] : last[i]] @ u, 6)
                at = np.flatnonzero((s > at_least) & (s >= floor[i]))
                if len(at) > k:
                    at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((rank[first[i] + at], -s[at]))][:k]
                found.append((np.full(len(at), i), first[i] + at, s[at]))
        i, j, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        take = lambda t, c, x: pa.concat_arrays([t.column(c).take(pa.array(x)).combine_chunks(), pa.nulls(1, t.schema.field(c).type)])
        none = pa.nulls(1, pa.int64())
        return pa.table([take(want, "q", i), take(want, "query_id", i), take(have, "id", j), pa.concat_arrays([pa.array(s, pa.float64()), pa.nulls(1, pa.float64())]), pa.concat_arrays([pa.nulls(len(i), pa.int64()), pa.array([counts], pa.int64())])], names=["q", "query_id", "id", "similarity", "compared"])

    keys = ["size", "cell", "r", "s"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"q long, query_id {of}, id {to}, similarity double, compared long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """Rank within each query: partial lists are cut to k rows before they are shuffled, and after."""
    order = Window.partitionBy("q").orderBy(F.col("similarity").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(df: DataFrame, queries: DataFrame, k: int = 3, at_least: float = 0.5, embedding: str = "embedding", id: str = "id", query_id: str | None = None) -> Nearest:
    """For each row of ``queries`` the k rows of ``df`` whose cosine, rounded to six digits, is the highest and exceeds ``at_least``; id breaks ties.

    The result is ``vector.top_k``'s for each query; a query without such rows has none. Vectors of different sizes are
    never similar. Vectors that are null or empty, hold null or non-finite components or have length 0 take no part.
    Repeated rows count each by itself, on both sides. Other columns are ignored; empty tables give empty results.

    Each row belongs to the cell of its nearest pivot and knows its angle to it. A query first searches its own cell; the k-th
    similarity found there, or the threshold, bounds the angle at which another row can still count. By the triangle inequality
    cells, and within a cell rows, whose angle to the pivot differs by more from the query's are left out without a comparison.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, folder = df.sparkSession, scratch(df.sparkSession)

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    vectors = _vectors(df, id, embedding)
    pivots = _pivots(vectors)
    # a size without pivots is one cell, whose rows have no angle: all are compared
    bare = F.size("angles") == 0
    rows = _with_angles(vectors, pivots).select("id", "size", "unit", F.when(bare, -1).otherwise(F.array_position("angles", F.array_min("angles")).cast("int") - 1).alias("cell"), F.when(bare, 0.0).otherwise(F.array_min("angles")).alias("angle"))
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "rows")
    asked = stored(_with_angles(_vectors(queries, query_id or id, embedding), pivots).withColumnRenamed("id", "query_id").withColumn("q", F.monotonically_increasing_id()), "queries")
    cells = stored(rows.groupBy("size", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")), "cells")

    few = cells.count() <= CELLS

    # a query's angle to each cell's pivot; none for a cell without one
    met = asked.select("q", "size", "angles").join(F.broadcast(cells) if few else cells, "size").select("q", "size", "cell", "low", "high", F.when(F.col("cell") < 0, 0.0).otherwise(F.element_at("angles", F.greatest(F.col("cell") + 1, F.lit(1)))).alias("angle"))
    homes = met.groupBy("q", "size").agg(F.min_by("cell", F.struct("angle", "cell")).alias("home"))
    whole = lambda pairs: pairs.join(asked.select("q", "query_id", "unit"), "q")
    everywhere = F.when(F.col("cell") < 0, math.pi)
    widest = _radius(F.lit(float(at_least)))

    first = met.join(homes, ["q", "size"]).where("cell = home").select("q", "size", "cell", "angle", F.coalesce(everywhere, widest).alias("radius"), F.lit(-2.0).alias("floor"))
    near = stored(_tiles(rows, cells, few, whole(first), k, at_least), "near")
    floors = _best(near.where("q IS NOT NULL"), k).where(F.col("rank") == k).select("q", F.col("similarity").alias("floor"))
    others = met.join(homes, ["q", "size"]).where("cell <> home").join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    others = others.withColumn("radius", F.coalesce(everywhere, F.least(widest, _radius(F.col("floor")))))
    others = others.where((F.col("angle") - F.col("high") <= F.col("radius")) & (F.col("low") - F.col("angle") <= F.col("radius"))).select(*first.columns)
    far = stored(_tiles(rows, cells, few, whole(others), k, at_least), "far")

    both = near.unionByName(far)
    pairs = asked.groupBy("size").agg(F.count("*").alias("m")).join(cells, "size").agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("pairs"))
    pruning = pairs.crossJoin(both.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared")))
    return Nearest(_best(both.where("q IS NOT NULL"), k).select("query_id", "rank", "id", "similarity"), pruning)
