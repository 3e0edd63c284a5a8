"""Operators 2, 5, 7 and 10 against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import hashing, minhash, phrases, sharding, suffixes

from .conftest import frame

LOW = -(1 << 63)


def order(x):
    return LOW if x is None else x


def brute_bytes(rows, length):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - length + 1):
            key = raw[s : s + length]
            first[key] = min(first.get(key, (1 << 62, 0)), (order(i), s))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] < (order(i), s):
                gone[s : s + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("length", [100, 30])
def test_suffix_dedup_equals_brute_force(spark, corpus, docs, length):
    got = suffixes.repeats(docs, length, batches=3).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_bytes(corpus, length)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_suffix_dedup_cuts_whole_characters(spark):
    text = "é" * 80 + "end"
    got = {r.doc_id: r for r in suffixes.repeats(frame(spark, [(1, text), (2, "ab" + text), (3, None)]), text=True, keep=("h",)).collect()}
    assert got[3].kept_text == "" and got[2].h == "x"
    assert got[2].kept_text == "ab"


def test_suffix_index_takes_batches_and_merges_levels(spark):
    """Batches one after another: levels as the binary digits of their number, sorted, and matches as by brute force."""
    rng, length = random.Random(3), 20
    index, seen = suffixes.SuffixIndex(spark, length, parts=3), set()
    for k in range(7):
        texts = ["".join(rng.choice("ab") for _ in range(40)) + "x" * rng.randrange(30) for _ in range(12)]
        rows = [(i % 4, i, 100 * k + i, 7 * i, t.encode()) for i, t in enumerate(texts)]
        got = {r.r: r.bits & (2**64 - 1) for r in index.add(spark.createDataFrame(rows, "h long, r long, doc long, pos long, text binary")).collect()}
        part = {h: p for h, p in spark.range(4).selectExpr("id", "pmod(xxhash64(id), 3)").collect()}
        for h, r, _, _, t in rows:  # in the order of the corpus
            keys = [(part[h], t[s : s + length]) for s in range(len(t) - length + 1)]
            for s, key in enumerate(keys):
                assert got[r] >> s & 1 == (key in seen), (k, r, s)
                seen.add(key)
        assert [n for n, _ in index.levels] == [1 << b for b in range(3, -1, -1) if (k + 1) >> b & 1]
        stored = [[(r.part, suffixes.load(r.data).keys(length).tolist()) for r in rows.collect()] for _, rows in index.levels]
        assert all(keys == sorted(set(keys)) for level in stored for _, keys in level)
        flat = [(p, x) for level in stored for p, keys in level for x in keys]
        assert len(flat) == len(set(flat)) and set(flat) == seen


@pytest.mark.parametrize("hot", [1, 10**6])
def test_hot_anchors_and_the_index_agree(spark, corpus, docs, monkeypatch, hot):
    """Regions by windows' hashes, and regions through the index alone, give what brute force gives."""
    monkeypatch.setattr(suffixes, "HOT_REGIONS", hot)
    monkeypatch.setattr(suffixes, "PART_REGIONS", 10)
    got = suffixes.repeats(docs, 40).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_bytes(corpus, 40)


def test_the_index_finds_what_regions_alone_do_not(spark, monkeypatch):
    """Equal strings within different regions are found by the levels: without them they stay."""
    shared = "".join(random.Random(1).choices("abcdefgh", k=130))
    rows = frame(spark, [(1, "x" * 9 + shared + "yz"), (2, "q" * 7 + shared + "rst"), (3, shared)])
    assert {r.doc_id: r.n_removed for r in suffixes.repeats(rows, batches=2).collect()} == {1: 0, 2: 130, 3: 130}
    add = suffixes.SuffixIndex.add

    def forgetful(self, regions):
        self.levels = []
        return add(self, regions)

    monkeypatch.setattr(suffixes.SuffixIndex, "add", forgetful)
    assert sum(r.n_removed for r in suffixes.repeats(rows, batches=3).collect()) < 260


def brute_words(rows, window):
    first = {}
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    for (i, _), w in zip(rows, split):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, 1 << 62), order(i))
    out = []
    for (i, _), w in zip(rows, split):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < order(i):
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize(("window", "phrase"), [(50, 8), (12, 3)])
def test_phrase_dedup_equals_brute_force(spark, corpus, docs, window, phrase):
    got = phrases.repeats(docs, window, phrase).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got) == brute_words(corpus, window)


def test_occurrences_come_from_the_automaton(spark):
    class Blind:
        def __init__(self, phrases):
            pass

        def occurrences(self, words):
            return np.zeros(len(words), bool)

    rows = frame(spark, [(i, " ".join(f"w{j}" for j in range(60 + i))) for i in range(3)])
    assert sum(r.n_removed for r in phrases.repeats(rows).collect()) == 121
    assert sum(r.n_removed for r in phrases.repeats(rows, finder=Blind).collect()) == 0


def test_phrases_of_other_documents_are_found_at_any_word(spark):
    passage = [f"p{j}" for j in range(900)]
    texts = [" ".join([f"{k}x{j}" for j in range(11 * k)] + passage + [f"{k}y{j}" for j in range(9)]) for k in range(4)]
    begins = np.cumsum([0, *[len(t.split()) for t in texts]])

    class Own(phrases.Automaton):
        """Knows a phrase only where a document would select it itself."""

        def occurrences(self, words):
            at = np.arange(len(words))
            return super().occurrences(words) & ((at - begins[np.searchsorted(begins, at, "right") - 1]) % 43 == 0)

    rows = frame(spark, list(enumerate(texts))).coalesce(1)
    assert {r.doc_id: r.n_removed for r in phrases.repeats(rows).collect()} == {0: 0, 1: 900, 2: 900, 3: 900}
    # at the passage's ends regions differ, and there the phrases are a document's own
    assert all(r.n_removed < 400 for r in phrases.repeats(rows, finder=Own).collect())


def test_phrases_in_many_small_automata(spark, corpus, docs, monkeypatch):
    whole = sorted((r.doc_id or -1, r.n_removed, r.kept) for r in phrases.repeats(docs).collect())
    words = np.concatenate([np.arange(40), np.arange(30)]).astype("<u4")
    some = np.lib.stride_tricks.sliding_window_view(words, 8)[::9]
    want = phrases.found_in(words, some, phrases.Automaton)
    monkeypatch.setattr(phrases, "SHARD", 2)
    assert (phrases.found_in(words, some, phrases.Automaton) == want).all() and want.sum() > len(some)
    assert sum(n for _, n, _ in whole) > 0


def test_automaton_finds_every_occurrence_across_runs(monkeypatch):
    monkeypatch.setattr(phrases, "_RUN", 64)
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, 5000).astype(np.uint64)
    some = np.unique(np.lib.stride_tricks.sliding_window_view(words, 6)[:40], axis=0)
    want = {tuple(x) for x in some.tolist()}
    got = phrases.Automaton(some).occurrences(words)
    assert got.tolist() == [tuple(words[i : i + 6].tolist()) in want for i in range(5000)]


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    low = defaultdict(lambda: 1 << 62)
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low[find(i)], order(doc))
    return Counter((doc, len(s), None if low[find(i)] == LOW else low[find(i)], order(doc) == low[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def test_near_duplicates_equal_brute_force(spark, corpus, docs):
    got = minhash.near_duplicates(docs).collect()
    assert Counter(tuple(r) for r in got) == brute_components(corpus, 85)


def test_near_duplicates_of_a_drifting_family(spark):
    """A chain of copies, each a little further from the first, is linked only from one to the next."""
    words = [f"t{i}" for i in range(300)]
    rows = [(500 - i, " ".join(words[:290 - 8 * i] + [f"v{j}" for j in range(8 * i)])) for i in range(20)]
    rows += [(i, " ".join([f"z{i}"] + words)) for i in range(40)]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows, 85)


def test_sketch_bins_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(x[:2000]), np.unique(x[500:2500]), np.unique(x[:3]), np.zeros(0, np.uint64)]
    bins = minhash.sketch(sets, 2000)
    assert (bins[:3] != 2**64 - 1).all()
    assert abs((bins[0] == bins[1]).mean() - 1500 / 2500) < 0.04


def test_window_hashes_do_not_depend_on_place():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 255, 500).astype(np.uint64)
    b = np.concatenate((rng.integers(0, 255, 77).astype(np.uint64), a))
    assert (hashing.gram_hash(a, 40) == hashing.gram_hash(b, 40)[77:]).all()
    for x, s in ((a, 0), (b, 77)):
        h, at, lo, hi = hashing.anchors(x, np.array([0, len(x)]), 60, 20)
        got = {w - s: (p - s, int(k)) for k, p, l, u in zip(h, at, lo, hi) for w in range(l, u + 1)}
        if s == 0:
            first = got
    assert all(got[w] == v for w, v in first.items()) and len(first) == 441


def test_shards(spark, corpus, docs):
    got = sharding.assign(docs).collect()
    texts = defaultdict(list)
    for i, t in corpus:
        texts[i].append((t or "").encode())
    assert len(got) == len(corpus)
    by = defaultdict(list)
    for r in got:
        raw = texts[r.doc_id][0]
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_are_even_and_grow_into_the_new_one(spark):
    from pyspark.sql import functions as F

    ids = spark.range(40000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for n in (8, 9, 11):
        sizes = {r.shard: r["count"] for r in sharding.assign(ids, n).groupBy("shard").count().collect()}
        assert len(sizes) == n and all(abs(v - 40000 / n) < 6 * (40000 / n) ** 0.5 for v in sizes.values())
        moved = sharding.assign(ids, n).where("grown_shard <> shard").select("grown_shard").distinct().collect()
        assert [r[0] for r in moved] == [n]


@pytest.mark.parametrize("operator", [sharding.assign, suffixes.repeats, phrases.repeats, minhash.near_duplicates])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [(1, "x")]).where("false")).collect() == []




def near_pairs(n, changed):
    """n pairs of 200 words, the last ``changed`` of which differ: a similarity of (196 - changed) / (196 + changed)."""
    rows = []
    for i in range(n):
        same = [f"p{i}w{j}" for j in range(200)]
        rows += [(2 * i, " ".join(same)), (2 * i + 1, " ".join(same[: 200 - changed] + [f"p{i}v{j}" for j in range(changed)]))]
    return rows


@pytest.mark.parametrize(("percent", "changed"), [(80, 21), (80, 22), (65, 41), (65, 42)])
def test_near_duplicates_at_lower_thresholds_equal_brute_force(spark, percent, changed):
    rows = near_pairs(60, changed)
    got = minhash.near_duplicates(frame(spark, rows), percent).collect()
    want = brute_components(rows, percent)
    assert Counter(tuple(r) for r in got) == want
    assert sum(n for (*_, kept), n in want.items() if kept) == (60 if 100 * (196 - changed) >= percent * (196 + changed) else 120)


@pytest.mark.parametrize("percent", [30, 50, 65, 80, 85, 90, 99, 100])
def test_sketches_lose_no_pair_at_any_threshold(percent):
    form, s = minhash.shape(percent), percent / 100
    assert (1 - s**form.rows) ** form.bands <= minhash.NO_BAND
    assert sum(math.comb(form.bins, k) * s**k * (1 - s) ** (form.bins - k) for k in range(form.least)) <= minhash.FEW_BINS
    assert [b for low, high in form.groups for b in range(low, high)] == list(range(form.bands))


def test_near_duplicates_in_tiles_equal_brute_force(spark, monkeypatch):
    """Copies of one text, each with its own changes: some are linked with each other, few with the least one, most with none."""
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(90):
        words = [f"f{j}" for j in range(120)]
        for at in rng.choice(120, rng.integers(1, 6), replace=False):
            words[at] = f"c{i}x{at}"
        rows.append((i, " ".join(words)))
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    want = brute_components(rows, 85)
    assert Counter(tuple(r) for r in got) == want and 3 < len({r.component_id for r in got}) < 90


@pytest.mark.parametrize("weight", [3.0, 0.2])
def test_a_changed_weight_moves_rows_only_into_or_out_of_its_subtrees(spark, weight):
    import dataclasses

    tree = sharding.topology(8)
    changed = [dataclasses.replace(x, weight=weight) if x.shard == 5 else x for x in tree]
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    place = {x.shard: (x.region, x.rack, x.shard) for x in tree}
    region, rack, shard = place[5]
    moves = [(place[r.shard], place[r.grown_shard]) for r in sharding.assign(ids, 8, tree, changed).select("shard", "grown_shard").collect()]
    inside = [b if weight > 1 else a for a, b in moves]
    moved = [(a, b, x) for (a, b), x in zip(moves, inside) if a != b]
    # between regions only by way of the changed one, between its racks only by way of the changed one, and so on
    assert all(x[0] == region for a, b, x in moved if a[0] != b[0])
    assert all(x[1] == rack for a, b, x in moved if a[0] == b[0] and a[1] != b[1]) and all(a[0] == region for a, b, _ in moved if a[0] == b[0])
    assert all(x[2] == shard and a[1] == rack for a, b, x in moved if a[1] == b[1]) and 0 < len(moved) < len(moves) / 3
    share = sum(b[2] == 5 for _, b in moves) / len(moves)
    assert abs(share - weight / (7 + weight)) < 0.02
