import random

import pytest

SCHEMA = "doc_id long, text string, block int, h string, score double, n int, row string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows of (doc_id, text): nulls, empty, blank and very long texts, ties, copies and near copies, shared passages."""
    rng = random.Random(5)
    base = words(rng, 220)
    passage = words(rng, 70)
    rows = [(100, " ".join(base)), (3, " ".join(base)), (7, " ".join(base[:218] + ["new"])), (8, " ".join(["other"] + base[3:]))]
    rows += [(20 + i, " ".join(words(rng, rng.randrange(30, 150)) + passage + words(rng, rng.randrange(5, 60)))) for i in range(25)]
    rows += [(60 + i, " ".join(words(rng, rng.randrange(1, 90)))) for i in range(20)]
    rows += [(1, None), (2, ""), (4, " \n\t "), (5, "één ÉÉN Ünï " * 40), (6, "a b c"), (9, "A B C"), (10, "aaaa " * 300), (11, "\x00\x01 zero"), (12, "ab" * 400)]
    rows += [(12, "ab" * 400), (13, " ".join(words(rng, 20000))), (None, " ".join(passage)), (90, "x" * 99), (91, "x" * 101), (92, "😀" * 60)]
    return rows


def frame(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(a, b, 1, "x", 0.5, 2, "r") for a, b in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return frame(spark, corpus).repartition(3)
