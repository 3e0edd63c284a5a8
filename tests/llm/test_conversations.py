"""Operator 12 against all edits of small conversations, and against itself in chunks."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, fault string, chunk int, n int, cost double"
LEGAL = re.compile("(s?(ua)+)?")


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, text)


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(conversations.WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, turns of rows (turn, role, text), by trying all edits."""
    rows = sorted(rows, key=order)
    flags = faults(rows)
    inserted = [(3 * k, "I" * k, roles, [({"u": "user", "a": "assistant"}[r], "") for r in roles]) for k in range(3) for roles in map("".join, itertools.product("ua", repeat=k))]
    options = [inserted]
    for (_, role, text), fault in zip(rows, flags):
        own = [(4, "D", "", [])]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            own += [(more, "K", role[:1] or "?", [(role, text)])] + [(3 + more, "R", r[0], [(r, text)]) for r in ("user", "assistant")]
        options += [own, inserted]
    best = None
    for way in itertools.product(*options):
        if LEGAL.fullmatch("".join(x[2] for x in way)):
            cost, audit = sum(x[0] for x in way), "".join(x[1] for x in way)
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, [t for x in way for t in x[3]])
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *[flags.count(k) for k in ("blank", "duplicate", "truncated")], illegal, *best


def answers(frame, chunk=conversations.CHUNK):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, [(t.role, t.text) for p in r.parts for t in p.turns]) for r in conversations.repair(frame, chunk).collect()}


@pytest.fixture(scope="module")
def small():
    rng = random.Random(7)
    roles, texts = ("system", "user", "assistant", "tool", "u", ""), ("yes.", "no", "why? ", "\t\n", "", "ok!\r\n", "é", "...")
    return {i: [(rng.choice((None, 0, 1, 2, 5, -3)), rng.choice(roles[: rng.choice((3, 6))]), rng.choice(texts)) for _ in range(1 + i % 3)] for i in range(60)}


@pytest.mark.parametrize("chunk", [conversations.CHUNK, 2])
def test_repair_equals_all_edits(spark, small, chunk):
    rows = [(i, *row, "x", 1, 1, 0.5) for i, conv in small.items() for row in conv] + [(None, 0, "user", "hi.", "x", 1, 1, 0.5)]
    got = answers(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk)
    want = {i: brute(conv) for i, conv in small.items()} | {None: brute([(0, "user", "hi.")])}
    assert {i: (x, want[i]) for i, x in got.items() if x != want[i]} == {} and len(got) == len(want)


def test_long_conversations_in_chunks(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(("system", "user", "assistant", "user", "assistant")), rng.choice(("a.", "b", "c?", "", f"t{t}.")), "x", 1, 1, 0.5) for c in range(3) for t in range(150) if rng.random() < 0.9]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = answers(frame)
    assert answers(frame, 7) == whole and answers(frame, 40) == whole
    for c, (*_, cost, audit, turns) in whole.items():
        own = sorted([r[1:4] for r in rows if r[0] == c], key=order)
        assert len(audit) - audit.count("I") == len(own) and LEGAL.fullmatch("".join(r[0] for r, _ in turns))
        assert [t for _, t in turns if t] == [t for (_, _, t), x in zip(own, audit.replace("I", "")) if x != "D"]


def test_many_copies_of_a_turn_are_put_together(spark):
    frame = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(4).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("hi.").alias("text"), F.lit(1).cast("long").alias("n"))
    assert answers(frame) == {1: (0, 0, 29_999, 0, 29_999, 4 * 29_999 + 3, "K" + "D" * 29_999 + "I", [("user", "hi."), ("assistant", "")])}
    assert conversations.flagged(frame).count() == 1


def test_damage(spark):
    rows = [(c, t, role, text, "x", 1, 1, 0.5) for c in (1, 7, None) for t in (*range(25), None) for role, text in (("system", "A. b! c?"), (None, None))]
    got = Counter((r.conv_id, r.turn, r.role, r.text, r.n) for r in conversations.damage(spark.createDataFrame(rows, SCHEMA)).collect())
    want = Counter()
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[(c, t, "user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1))] += 1
    assert got == want and len({k[-1] for k in got}) == 3


def test_dropped_and_empty(spark):
    frame = spark.createDataFrame([(5, 1, "user", "x", "x", 1, 0, 0.5), (5, 2, "user", "y", "x", 1, 0, 0.5), (6, 1, "user", "x.", "x", 1, 1, 0.5), (6, 9, "user", "x", "x", 1, 0, 0.5)], SCHEMA)
    assert answers(frame) == {5: (0, 0, 0, 0, 0, 0, "", []), 6: (0, 0, 0, 0, 0, 3, "KI", [("user", "x."), ("assistant", "")])}
    assert answers(frame.where("false")) == {}
