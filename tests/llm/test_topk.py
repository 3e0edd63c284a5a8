"""Operator 13 against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, node int, row string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x", 0.5) for i, v in rows], SCHEMA)


def brute(rows, asks, k):
    def whole(x):
        return max(-(1 << 62), min(1 << 62, math.floor(256 * float(np.float32(x)))))

    fit = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fit:
        if asks(q):
            found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in fit if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"shard": 7, "queries": 3, "shards": 2, "fan": 2}])
def test_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(0, 300)]
    rows += [(400 + i, rows[5][1]) for i in range(40)]  # one very common vector
    rows += [(450, None), (451, [None] * 8), (500, [1.0, float("nan")] * 4), (501, [float("inf")] * 8), (None, rows[0][1]), (550, [0.5, -0.5]), (600, []), (650, [1e30] * 8), (700, [-1e30, 3.0]), (50, rows[3][1]), (50, rows[3][1])]
    got = topk.search(frame(spark, rows).repartition(5), F.col("vec_id") % 50 == 0, 5, **sizes)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 50 == 0, 5)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_fewer_candidates_and_empty_tables(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [2.0])]
    assert sorted(map(tuple, topk.search(frame(spark, rows), F.col("vec_id") == 0).collect())) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    assert topk.search(frame(spark, rows[:1]), F.col("vec_id") == 0).collect() == []
    assert topk.search(frame(spark, rows), F.lit(False)).collect() == []
    assert topk.search(frame(spark, []), F.lit(True)).collect() == []


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[2.0**40 + 1, 1.0]]), np.array([[2.0**22 + 1, 1.0], [2.0**62, 0.0]])
    assert topk.products(a, b).tolist() == [[(2**40 + 1) * (2**22 + 1) + 1, 2**63 - 1]]
