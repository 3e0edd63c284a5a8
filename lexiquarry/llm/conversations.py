"""Conversation structure repair: cheapest edits by a fold over each conversation's turns, in SQL higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

WHITE = " \t\n\x0b\x0c\r"
#: Costs of the edits; an undeleted truncated turn costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns go into chunks by turn number, so a conversation of any length is folded in pieces that meet as four by four costs.
CHUNK = 512
LEGAL_PAIRS = ("su", "ua", "au")
#: Above any cost that can be reached.
FAR = 1 << 50


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows of ``turns`` and how often each is there after the damage.

    What happens to a row goes by crc32(``conv_id:turn``) % 20: 0 drops it (n = 0), 1 empties its text, 2 removes the text's ``.!?``, 3
    repeats it (n = 2), 4 makes its role user. Null roles and texts become one blank, as do nulls in the key.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def flagged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, n) with equal ones put together, their role's initial and the first one's fault."""
    merged = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(last == "", "blank").when(F.sum("n").over(earlier) > 0, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return merged.select("*", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))


def _plus(state: Column, cost: Column | int, letters: Column | str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letters) if isinstance(letters, str) else letters).alias("audit"))


def _let(value: Column, fn) -> Column:
    """fn(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _closed(states: Column) -> Column:
    """The four states, with those that inserted turns reach: a user turn behind any state but user, an assistant turn behind that."""
    s = [F.get(states, F.lit(k)) for k in range(4)]
    user = _let(F.least(s[0], s[1], s[3]), lambda x: F.least(s[2], _plus(x, INSERT, "I")))
    return _let(user, lambda x: F.array(s[0], s[1], x, F.least(s[3], _plus(x, INSERT, "I"))))


def fold(marks: Column, start: Column) -> Column:
    """Least (cost, audit) for each of four end states of the turns ``marks`` (initial, fault, n) that begin in state ``start``.

    States of the roles so far: 0 none, 1 a system turn, 2 a user turn last, 3 an assistant turn last. Two edits of equal cost
    at the same turn are never prefixes of each other, so the least of each state is all that later turns need.
    """
    zero = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(F.when(k == start, 0).otherwise(FAR).cast("long").alias("cost"), F.lit("").alias("audit")))

    def step(acc: Column, x: Column) -> Column:
        s = [F.get(acc, F.lit(k)) for k in range(4)]
        gone = [_plus(state, DELETE, "D") for state in s]
        more = F.when(x["fault"] == "truncated", TRUNCATED).otherwise(0)

        def turned(state: Column, initial: str) -> Column:
            own = x["initial"] == initial
            return _plus(state, more + F.when(own, 0).otherwise(REROLE), F.when(own, "K").otherwise("R"))

        opened = F.when(x["initial"] == "s", F.least(gone[1], _plus(s[0], more, "K"))).otherwise(gone[1])
        user = _let(F.least(s[0], s[1], s[3]), lambda state: F.least(gone[2], turned(state, "u")))
        kept = F.array(gone[0], opened, user, F.least(gone[3], turned(s[2], "a")))
        new = F.when(x["fault"].isin("blank", "duplicate"), F.array(*gone)).otherwise(kept)
        # further copies of the turn can only be deleted, and insertions before a deletion are never least
        copies = lambda state: _plus(state, DELETE * (x["n"] - 1), F.repeat(F.lit("D"), (x["n"] - 1).cast("int")))
        return _let(F.transform(new, copies), _closed)

    return F.aggregate(marks, _let(zero, _closed), step)


def _joined(parts: Column) -> Column:
    """Least (cost, audit, pieces) of the chunks in order; ``parts``: (chunk, ends), ends having a fold for each start state."""
    zero = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(F.when(k == 0, 0).otherwise(FAR).cast("long").alias("cost"), F.lit("").alias("audit"), F.expr("cast(array() as array<struct<chunk:bigint,start:int,audit:string>>)").alias("pieces")))

    def through(acc: Column, x: Column) -> Column:
        def by_way(end: Column) -> Column:
            def way(start: Column) -> Column:
                was, now = F.get(acc, start), F.get(F.get(x["ends"], start), end)
                piece = F.struct(x["chunk"].alias("chunk"), start.alias("start"), now["audit"].alias("audit"))
                return F.struct((was["cost"] + now["cost"]).alias("cost"), F.concat(was["audit"], now["audit"]).alias("audit"), F.concat(was["pieces"], F.array(piece)).alias("pieces"))

            # only the first chunk begins in state 0 for sure, so it has that fold alone
            return F.array_min(F.transform(F.sequence(F.lit(0), F.size(x["ends"]) - 1), way))

        return F.transform(F.sequence(F.lit(0), F.lit(3)), by_way)

    return F.aggregate(parts, zero, through, lambda acc: F.least(F.get(acc, F.lit(0)), F.get(acc, F.lit(3))))


def _repaired(lines: Column, audit: Column, start: Column) -> Column:
    """Turns (role, text) that the letters of ``audit`` make of ``lines`` (role, text, initial), from state ``start`` on."""
    zero = F.struct(start.alias("state"), F.lit(1).alias("at"), F.expr("cast(array() as array<struct<role:string,text:string>>)").alias("out"))

    def step(acc: Column, letter: Column) -> Column:
        own = F.try_element_at(lines, acc["at"])
        turn = F.when(acc["state"] == 2, "assistant").otherwise("user")
        made = F.when(letter == "I", F.struct(turn.alias("role"), F.lit("").alias("text"))).when(letter == "R", F.struct(turn.alias("role"), own["text"].alias("text"))).otherwise(F.struct(own["role"].alias("role"), own["text"].alias("text")))
        initial = F.when(letter == "K", own["initial"]).when(acc["state"] == 2, "a").otherwise("u")
        after = F.when(letter == "D", acc["state"]).when(initial == "s", 1).when(initial == "u", 2).otherwise(3)
        return F.struct(after.alias("state"), (acc["at"] + F.when(letter == "I", 0).otherwise(1)).alias("at"), F.when(letter == "D", acc["out"]).otherwise(F.concat(acc["out"], F.array(made))).alias("out"))

    # an empty audit has no letters; split() would make one empty letter of it
    return F.aggregate(F.filter(F.split(audit, ""), lambda c: c != ""), zero, step, lambda acc: acc["out"])


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, and parts: (chunk, turns), the repaired turns in order.

    ``rows`` (conv_id, turn, role, text, n) say how often each turn is there (``damage``; n = 0 keeps a conversation without turns in the result).
    Turns are ordered by turn (nulls first), role and text. Faults, of which the first counts: blank (only ASCII white space),
    duplicate (role and text seen earlier), truncated (no ``.!?`` at the end). Edits keep a turn (K, free), give it the role user
    or assistant (R), delete it (D, required for blanks and duplicates) or insert an empty turn of either role
    (I); role initials then have the form (s?(ua)+)?. The cheapest edits, by ASCII among equals, are the audit. gaps counts the turn numbers
    that are missing between least and greatest; illegal counts neighbours whose initials are not su, ua or au. A turn whose role has no initial can't be kept.
    A null conv_id is a conversation as any other; other columns are ignored. No turns: zeros, an empty audit, no parts.

    Equal turns are put together before anything is collected, and conversations are cut by turn number into chunks, each of which is folded by itself
    from every state it may begin in: no array holds more than the distinct turns of ``chunk`` turn numbers, but for the letters of an audit, which
    is one string by definition.
    """
    place = F.floor(F.col("turn") / chunk)
    own = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    there = flagged(rows).withColumn("chunk", F.coalesce(place, F.lit(-(1 << 62))))
    pair = F.concat(F.lag("initial").over(own), "initial")
    some = F.col("n") > 0
    # dropped turns stand in no order of turns: they go behind a chunk of their own, to which no turn number belongs
    there = there.withColumn("chunk", F.when(some, F.col("chunk")).otherwise(F.lit(1 << 62))).withColumn("illegal", F.when(some, F.col("n") - 1 + F.coalesce((~pair.isin(*LEGAL_PAIRS)).cast("long"), F.lit(0))).otherwise(0))
    first_of = lambda kind: F.sum(F.when(some & (F.col("fault") == kind), 1).otherwise(0))
    blank, copies = F.sum(F.when(some & (F.col("fault") == "blank"), F.col("n")).otherwise(0)), F.sum(F.when(some & (F.col("fault") != "blank"), F.col("n") - 1).otherwise(0))
    kept = F.collect_list(F.when(some, F.struct(F.col("turn"), F.col("role"), F.col("text"), F.col("initial"), F.col("fault"), F.col("n"))))
    chunks = there.groupBy("conv_id", "chunk").agg(
        F.sort_array(kept).alias("turns"), F.sum("illegal").alias("illegal"), blank.alias("blank"), (copies + first_of("duplicate")).alias("duplicate"), first_of("truncated").alias("truncated"),
        F.min(F.when(some, F.col("turn"))).alias("least"), F.max(F.when(some, F.col("turn"))).alias("most"),
    )
    chunks = chunks.select(
        "conv_id", "chunk", "illegal", "blank", "duplicate", "truncated", "least", "most",
        F.size(F.filter(F.array_distinct(F.transform("turns", lambda x: x["turn"])), lambda t: t.isNotNull())).cast("long").alias("numbers"),
        F.transform("turns", lambda x: F.struct(x["initial"].alias("initial"), x["fault"].alias("fault"), x["n"].alias("n"))).alias("marks"),
        F.flatten(F.transform("turns", lambda x: F.array_repeat(F.struct(x["role"].alias("role"), x["text"].alias("text"), x["initial"].alias("initial")), x["n"].cast("int")))).alias("lines"),
    )
    chunks = runtime.materialise(chunks, "chunks")

    first = F.col("chunk") == F.min("chunk").over(Window.partitionBy("conv_id"))
    starts = F.sequence(F.lit(0), F.when(first, 0).otherwise(3))
    folded = chunks.drop("lines").withColumn("starts", starts).withColumn("ends", F.transform("starts", lambda k: fold(F.col("marks"), k)))
    part = F.when(F.size("marks") > 0, F.struct("chunk", "ends", F.get("marks", F.lit(0))["initial"].alias("head"), F.get("marks", F.size("marks") - 1)["initial"].alias("tail")))
    sums = [F.sum(c).alias(c) for c in ("illegal", "blank", "duplicate", "truncated", "numbers")]
    convs = folded.groupBy("conv_id").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most"), F.sort_array(F.collect_list(part)).alias("parts"))
    seams = F.aggregate("parts", F.struct(F.lit(None).cast("string").alias("tail"), F.lit(0).cast("long").alias("bad")), lambda acc, x: F.struct(x["tail"].alias("tail"), (acc["bad"] + F.when(acc["tail"].isNull() | F.concat(acc["tail"], x["head"]).isin(*LEGAL_PAIRS), 0).otherwise(1)).alias("bad")), lambda acc: acc["bad"])
    convs = convs.withColumn("best", _joined(F.col("parts"))).select(
        "conv_id", F.coalesce(F.col("most") - F.col("least") + 1 - F.col("numbers"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        (F.col("illegal") + seams).alias("illegal"), F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), F.col("best.pieces").alias("pieces"),
    )
    convs = runtime.materialise(convs, "conversations")

    # a null conv_id is a key, too
    key = [F.coalesce("conv_id", F.lit(0)).alias("_key"), F.col("conv_id").isNull().alias("_none")]
    pieces = convs.select(*key, F.explode("pieces").alias("piece")).select("_key", "_none", "piece.*")
    made = pieces.join(chunks.select(*key, "chunk", "lines"), ["_key", "_none", "chunk"]).select("_key", "_none", "chunk", _repaired(F.col("lines"), F.col("audit"), F.col("start")).alias("turns"))
    parts = made.groupBy("_key", "_none").agg(F.sort_array(F.collect_list(F.struct("chunk", "turns"))).alias("parts"))
    out = convs.drop("pieces").withColumns({"_key": key[0], "_none": key[1]}).join(parts, ["_key", "_none"], "left")
    return out.withColumn("parts", F.coalesce("parts", F.expr("cast(array() as array<struct<chunk:bigint,turns:array<struct<role:string,text:string>>>>)"))).drop("_key", "_none")
