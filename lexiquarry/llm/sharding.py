"""Weighted hash tree sharding (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups that a shard's rows are dealt into to number them; 12 bits of a hash.
SLOT_GROUPS = 4096


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, base: int = 8) -> list[Leaf]:
    """Regions of two racks of two shards for the first ``base`` shards; each further shard opens a region of its own.

    A subtree that gains weight draws rows from everywhere and deals them to all it holds, so a
    shard added inside an old region would also move rows into that region's old shards. As a
    region of its own, a new shard takes rows only into itself, from any count ``base`` on.
    """
    out = [Leaf(f"r{i // 4}", f"r{i // 4}k{i % 4 // 2}", i) for i in range(min(shards, base))]
    return out + [Leaf(f"r+{i}", f"r+{i}k0", i) for i in range(base, shards)]


def draw(key: Column, node: str, weight: float) -> Column:
    """Time at which a node would win the row: exponential, with the node's weight as its rate.

    The first 13 hex digits of an MD5 give 52 uniform bits, so each engine that has MD5 and a
    natural logarithm finds the same winner.
    """
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _choose(options: list[tuple[Column, Column]]) -> Column:
    """What belongs to the least time (the first of equals)."""
    if len(options) == 1:
        return options[0][1]
    return F.array_min(F.array(*[F.struct(t.alias("t"), F.lit(i).alias("i"), v.alias("v")) for i, (t, v) in enumerate(options)]))["v"]


def place(key: Column, leaves: list[Leaf]) -> Column:
    """Shard of a row: a weighted draw between regions, then racks of that region, then its shards."""

    def weight(part: list[Leaf]) -> float:
        return sum(x.weight for x in part)

    def group(part: list[Leaf], by: str) -> dict[str, list[Leaf]]:
        out: dict[str, list[Leaf]] = {}
        for x in part:
            out.setdefault(getattr(x, by), []).append(x)
        return out

    regions = []
    for region, in_region in group(leaves, "region").items():
        racks = []
        for rack, in_rack in group(in_region, "rack").items():
            shards = _choose([(draw(key, f"shard:{x.shard}", x.weight), F.lit(x.shard)) for x in in_rack])
            racks.append((draw(key, f"rack:{rack}", weight(in_rack)), shards))
        regions.append((draw(key, f"region:{region}", weight(in_region)), _choose(racks)))
    return _choose(regions)


def assign(docs: DataFrame, shards: int = 8, leaves: Sequence[Leaf] | None = None, grown: Sequence[Leaf] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``leaves`` is the tree, with any weights (``topology(shards)`` unless given), ``grown`` another one, to whose shards grown_shard moves the rows (with one more
    shard unless given). Where weights change, rows move only into subtrees that gain and out of those that lose.

    doc_id and the shard count alone decide the shard (law ``key``); null ids count as the text
    ``null``. size: UTF-8 bytes and 1; a null text has none. slot numbers a shard's rows without gaps
    from 0 by (group of the id's hash, doc_id, checksum, size); rows that are alike in all of these get
    consecutive slots. An empty table gives no rows; other columns are ignored.

    To number a shard no task sees more than a 4096th of it: the groups are counted first, and only
    these counts, 4096 for a shard at most, are broadcast to add the groups' offsets.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    group = F.conv(F.substring(F.md5(F.concat(key, F.lit("/slot"))), 1, 3), 16, 10).cast("int")
    placed = docs.select(F.col("doc_id"), F.col("text"), place(key, list(leaves or topology(shards))).alias("shard"), group.alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    full = placed.select(
        "doc_id",
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "part",
        place(key, list(grown or topology(shards + 1))).alias("grown_shard"),
    )
    order = Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = full.withColumn("rank", F.row_number().over(order) - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "part"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("rank") + F.col("offset")).cast("long").alias("slot"), "grown_shard")
