"""Operator 11 against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from lexiquarry.llm import importance

from .conftest import frame

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent, least_words, seed, longest, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [features(t, longest) for _, t in rows]
    s, t = Counter(bucket(f) for _, fs in own for f in fs), Counter(bucket(f) for x in target for f in features(x, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (i, _), (words, fs) in zip(rows, own):
        weight = sum(n * gain(b) for b, n in Counter(map(bucket, fs)).items()) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= least_words), key=lambda x: (-x[4], x[0] is not None, x[0] or 0, -x[3]))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[5] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("longest", "percent", "buckets"), [(1, 10, 10_000), (2, 50, 97), (1, 100, 10_000)])
def test_equals_brute_force(spark, corpus, docs, longest, percent, buckets):
    target = ["w1 w2 W3-w4", None, "", "één ünï 12 " * 5]
    got = importance.resample(docs, spark.createDataFrame([(1, t, 5) for t in target], "item_id long, text string, n int"), percent, 20, 2024, longest, buckets)
    assert Counter(map(tuple, got.collect())) == brute(corpus, target, percent, 20, 2024, longest, buckets)


def test_ranks_are_gapless_with_ties(spark):
    rows = [(i // 2, "same words here " * 8) for i in range(60)] + [(100 + i, "short") for i in range(20)]
    got = importance.resample(frame(spark, rows).repartition(4), spark.createDataFrame([(1, "words")], "item_id long, text string"), 33)
    ranked = sorted((r["rank"], r.score, r.doc_id) for r in got.collect() if r["rank"] is not None)
    assert [r for r, *_ in ranked] == list(range(1, 33 * 60 // 100 + 1)) and [(-s, i) for _, s, i in ranked] == sorted((-s, i) for _, s, i in ranked)
    assert Counter(map(tuple, got.collect())) == brute(rows, ["words"], 33, 20, 2024, 1, importance.BUCKETS)


def test_postings_in_small_ranges_and_blocks(spark, corpus, docs, monkeypatch):
    from lexiquarry.llm import blocks

    monkeypatch.setattr(importance, "GROUP", 1)
    monkeypatch.setattr(importance, "RANGES", 3)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 500)
    got = importance.resample(docs, spark.createDataFrame([(1, "w5 w6")], "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute(corpus, ["w5 w6"], 10, 20, 2024, 1, importance.BUCKETS)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs.where("false"), none).collect() == []
    assert Counter(r.weight for r in importance.resample(docs, none).collect()).total() == docs.count()
