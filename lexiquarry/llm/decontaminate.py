"""Benchmark decontamination by winnowing (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

WINDOW = 10
GRAM = 5
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprints of the benchmark that are broadcast at most (about 200 bytes each); more are joined by a shuffle.
BROADCAST_FINGERPRINTS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, A-Z lower-cased; an empty array for a null text."""
    ascii_lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    words = F.filter(F.split(F.coalesce(ascii_lower, F.lit("")), WORD_BREAK), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _padded(h: Column) -> Column:
    """The hashes with nulls for what a window could reach beyond the text."""
    nulls = lambda n: F.array(*[F.lit(None).cast("bigint")] * n)
    return F.concat(nulls(WINDOW - GRAM), h, nulls(WINDOW - 1))


def _context(padded: Column, p: Column) -> Column:
    """The words around a k-gram at p: all that a window which holds it can reach, null outside the text."""
    return F.slice(padded, p + 1, F.lit(2 * WINDOW - GRAM))


def fingerprints(h: Column, short: list[int]) -> Column:
    """Array of (pos, fp, n): the least hash of each window of k-grams, and all n-grams of the short lengths.

    A window of w = WINDOW - GRAM + 1 successive k-grams keeps its least hash, so any WINDOW words
    that two texts share contain a fingerprint that both keep. All positions that tie are kept.
    """
    w = WINDOW - GRAM + 1

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(F.lit(n), *[F.get(h, i + j) for j in range(n)]))

    def winnow(g: Column) -> Column:
        least = F.transform(F.sequence(F.lit(0), F.size(g) - w), lambda j: F.least(*[F.get(g, j + x) for x in range(w)]))

        def picked(m: Column) -> Column:
            # no window that holds position i has a greater minimum than its own value, so one has it if the greatest is it
            kept = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.get(g, i) == F.greatest(*[F.get(m, i - j) for j in range(w)]))
            return F.transform(kept, lambda i: F.struct(i.alias("pos"), F.get(g, i).alias("fp"), F.lit(WINDOW).alias("n")))

        return _let(least, picked)

    empty = F.array().cast("array<struct<pos:int,fp:bigint,n:int>>")
    parts = [F.when(F.size(h) >= WINDOW, _let(grams(GRAM), winnow)).otherwise(empty)]

    def whole(n: int) -> Column:
        return F.when(F.size(h) >= n, F.transform(grams(n), lambda x, i: F.struct(i.alias("pos"), x.alias("fp"), F.lit(n).alias("n")))).otherwise(empty)

    return F.concat(*parts, *[whole(n) for n in short])


def item_fingerprints(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """(fp, n, ctx, item_ids) of the benchmark, items with equal surroundings together, and the lengths of its short items."""
    hashed = items.select(F.col("item_id").cast("string").alias("item_id"), word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    lengths = hashed.where(F.size("h") < WINDOW).select(F.size("h").alias("n")).distinct()
    short = sorted(r["n"] for r in lengths.collect())  # nine lengths at most
    own = F.when(F.size("h") >= WINDOW, F.filter(F.col("f"), lambda s: s["n"] == WINDOW)).otherwise(F.filter(F.col("f"), lambda s: s["n"] == F.size("h")))
    each = hashed.withColumn("f", fingerprints(F.col("h"), short)).select("item_id", "h", F.explode(own).alias("s"))
    surround = each.select("item_id", F.col("s.fp").alias("fp"), F.col("s.n").alias("n"), _context(_padded(F.col("h")), F.col("s.pos")).alias("ctx"))
    return surround.groupBy("fp", "n", "ctx").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")), short


def _reach(mine: Column, theirs: Column, order: list[int]) -> Column:
    """How many words agree, going through the context in the order given until one doesn't."""
    out = F.lit(0)
    for i in reversed(order):
        out = F.when(F.get(mine, F.lit(i)) == F.get(theirs, F.lit(i)), out + 1).otherwise(F.lit(0))
    return out


def contamination(docs: DataFrame, items: DataFrame, broadcast_fingerprints: int = BROADCAST_FINGERPRINTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, item_ids (sorted as strings), spans (merged word ranges, end excluded).

    A word is hit if it lies in an occurrence of 10 consecutive words of an item, or of a whole item
    of 1 to 9 words. A null or empty text has no words and no hits; items without words never
    match; rows that repeat are each returned; null item ids are ignored. An empty benchmark hits nothing.
    ``keep`` names further columns of docs to return.

    Documents' fingerprints meet those of the benchmark in a join, and each hit is extended word by
    word on both sides. The benchmark is broadcast only after its fingerprints have been counted;
    beyond the bound, both sides are shuffled by fingerprint. Items that agree in all the words
    around a fingerprint are one row, so a passage common to all items doesn't multiply the rows.
    """
    found, short = item_fingerprints(items.select("item_id", "text"))
    found = found.withColumnsRenamed({"fp": "i_fp", "n": "i_n", "ctx": "i_ctx"})
    small = found.limit(broadcast_fingerprints + 1).count() <= broadcast_fingerprints
    extra = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    hashed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *extra, word_hashes(F.col("text")).alias("h"))
    if not small:
        hashed = runtime.materialise(hashed, "hashed")  # two branches read it and must agree on the row numbers
    rows = hashed.withColumn("f", fingerprints(F.col("h"), short))
    carried = ["row", "doc_id", *[f"keep_{i}" for i in range(len(keep))]]

    def lean(df: DataFrame) -> DataFrame:
        """The row's own columns only where the row itself comes along."""
        return df.withColumns({c: F.when(F.col("pos") < 0, F.col(c)) for c in carried[1:]})

    n_words = F.size("h").alias("n_words")
    # the row itself comes along once, as a fingerprint at no position
    marker = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("fp"), F.lit(0).alias("n")))
    keys = (F.col("fp") == F.col("i_fp")) & (F.col("n") == F.col("i_n"))
    if small:
        # From the explosion to the words that a hit covers, all expressions are compiled into one stage. So an exploded row
        # is no copy of its document, and only hits and markers leave the stage.
        each = rows.select(*carried, n_words, _padded(F.col("h")).alias("padded"), F.explode(F.concat(marker, "f")).alias("s")).select(*carried, "n_words", "padded", "s.pos", "s.fp", "s.n")
        hits = each.join(F.broadcast(found), keys, "left").where((F.col("pos") < 0) | F.col("i_fp").isNotNull())
        hits = lean(hits.withColumn("ctx", F.when(F.col("pos") >= 0, _context(F.col("padded"), F.col("pos")))).drop("padded"))
    else:
        each = rows.select("row", _padded(F.col("h")).alias("padded"), F.explode("f").alias("s")).select("row", "s.pos", "s.fp", "s.n", _context(F.col("padded"), F.col("s.pos")).alias("ctx"))
        hits = each.join(found, keys).unionByName(rows.select(*carried, n_words, F.lit(-1).alias("pos")), allowMissingColumns=True)
    before = WINDOW - GRAM
    left = _reach(F.col("ctx"), F.col("i_ctx"), list(range(before - 1, -1, -1)))
    right = _reach(F.col("ctx"), F.col("i_ctx"), list(range(before, before + WINDOW)))
    hits = hits.withColumns({"left": left, "right": right})
    # a short item is one window, and covers its own words only
    long = (F.col("n") == WINDOW) & (F.col("right") >= GRAM) & (F.col("left") + F.col("right") >= WINDOW)
    short_hit = (F.col("n") < WINDOW) & (F.col("right") >= F.col("n"))
    pos = F.col("pos")
    span = F.when(long, F.struct((pos - F.col("left")).alias("start"), (pos + F.col("right")).alias("end"))).when(short_hit, F.struct(pos.alias("start"), (pos + F.col("n")).alias("end")))
    per_row = (
        hits.withColumn("span", F.when(pos >= 0, span))
        .groupBy("row")
        .agg(
            *[F.first(F.when(F.col("pos") < 0, F.struct(F.col(c).alias("v"))), ignorenulls=True)["v"].alias(c) for c in [*carried[1:], "n_words"]],
            F.collect_set("span").alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("span").isNotNull(), F.col("item_ids")))))).alias("item_ids"),
        )
    )
    merged = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = per_row.withColumn("spans", F.when(F.size("spans") > 0, merged).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
    return out.select("doc_id", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), "item_ids", "spans")
