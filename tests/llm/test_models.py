"""Operators 1, 3, 4, 6, 8 and 9: held-out accuracy, exact round trips, brute force, recomputed sums."""

import hashlib
import io
import math
import os
import re
import tarfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import decontaminate, hashing, labelled, media, pieces, pitman_yor, quality, toxicity

from .conftest import frame

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


# --- classifiers, parts by brute force ---

def naive_features(text):
    """Buckets of words and of n-grams of bytes between marks, one word after the other."""
    out = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", text):
        raw = np.frombuffer(w, np.uint8)
        out.append(int(hashing.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) >> 64 - quality.BUCKET_BITS)
        marked = [0, *w, 0]
        for n in quality.GRAMS:
            for i in range(len(marked) - n + 1):
                value = n
                for c in marked[i : i + n]:
                    value = value << 8 | c
                out.append((value * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - quality.BUCKET_BITS)
    return out


@pytest.mark.parametrize("run", [1 << 20, 16, 1])
def test_quality_scores_equal_brute_force(monkeypatch, run):
    monkeypatch.setattr(quality, "_RUN", run)
    rng = np.random.default_rng(1)
    margin = rng.normal(size=1 << quality.BUCKET_BITS)
    texts = [b"", b" \t", "één Ünï\n a".encode(), b"x" * 50 + b" y", b"ab\x00c  d", b" lead and trail ", bytes(rng.integers(1, 255, 300).astype(np.uint8))]
    want = [1 / (1 + math.exp(-(sum(margin[b] for b in f) / max(1, len(f)) + 0.3))) for f in map(naive_features, texts)]
    assert np.allclose(quality.Scorer(margin, 0.3)(texts), want, rtol=1e-9)


def test_quality_looks_at_texts_beyond_a_run_whole():
    text = b" ".join(b"w%d" % (i % 977) for i in range(300_000))
    assert len(text) > quality._RUN and len(list(quality.pieces(text))) == 2
    margin = np.random.default_rng(2).normal(size=1 << quality.BUCKET_BITS)
    features = naive_features(b" ".join(b"w%d" % i for i in range(977)))
    whole, part = quality.Scorer(margin, 0.0)([text, b" ".join(b"w%d" % i for i in range(977))])
    assert abs(whole - part) < 1e-3 and abs(math.log(part / (1 - part)) - margin[features].mean()) < 1e-9


def test_more_evidence_always_scores_more():
    x = [0, 1, 19.9, 20, 20.1, 60, 61, 1e4, 1e9]
    assert [toxicity.told(e) for e in x[:4]] == x[:4] and all(a < b for a, b in zip(map(toxicity.told, x), [toxicity.told(e) for e in x[1:]]))
    scorer = toxicity.Scorer({b"vile": 3.0})
    scorer.slope, scorer.constant, scorer.rate, scorer.scale = 0.8, -2.0, 0.5, 0.1
    scores = scorer([b"vile " * n for n in (1, 10, 100, 1000, 10_000)])
    assert scores == sorted(scores) and len(set(scores)) == len(scores)


# --- classifiers --------------------------------------------------------------------------------


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


@needs_data
@pytest.mark.parametrize(("module", "label", "modulus", "remainder", "least"), [(quality, "quality", 5, 0, 0.7), (toxicity, "toxic", 3, 1, 0.6)])
def test_held_out_accuracy(spark, module, label, modulus, remainder, least):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = module.classify(docs, labels, modulus, remainder).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and got.score.between(0, 1).all()
    assert auc(got.score.to_numpy(), got[label].to_numpy()) > least
    assert all(crc(i, modulus) == remainder for i in got.doc_id)


@pytest.mark.parametrize(("module", "label", "words"), [(quality, "quality", ("$$$ %%%", "plain text")), (toxicity, "toxic", ("kind words", "vile brute"))])
def test_classifiers_learn_from_allowed_rows_only(spark, corpus, docs, module, label, words):
    rows = [(1000 + i, " ".join(f"w{(i * k) % 37} {words[i % 2].split()[k % 2]} w{(i + k) % 11}" for k in range(2, 8))) for i in range(300)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(made)
    # held-out rows bear the opposite label, which must not matter
    labels = spark.createDataFrame([(i, k % 2 if crc(i, 5) else 1 - k % 2) for k, (i, _) in enumerate(rows)], f"doc_id long, {label} int")
    got = module.classify(every, labels, 5, 0).collect()
    assert len(got) == len(corpus) + len(rows)
    score = {r.doc_id: r.score for r in got}
    assert all((score[i] > 0.5) == bool(k % 2) for k, (i, _) in enumerate(rows))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in got)
    flags = {r.doc_id: r.held_out for r in got}
    assert flags[None] is False and all(v == (crc(i, 5) == 0) for i, v in flags.items() if i is not None)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_without_labels(spark, module):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = module.classify(frame(spark, [(1, "a b"), (2, None), (2, None)]), labels).collect()
    assert [r.score for r in got] == [0.5] * 3
    assert module.classify(frame(spark, [(1, "x")]).where("false"), labels).collect() == []


def test_sample_is_bounded(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    texts, y = labelled.sample(docs, labels.unionByName(labels), "quality", labelled.held_out_rule(5, 0), 50, 100)
    assert len(texts) == len(y) == 50 and all(crc(int(t.split()[1]), 5) for t in texts)
    again, _ = labelled.sample(docs.repartition(7), labels, "quality", labelled.held_out_rule(5, 0), 50, 100)
    assert sorted(texts) == sorted(again)
    conflict = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality")))
    assert labelled.sample(docs, conflict, "quality", labelled.held_out_rule(5, 0), 50, 100)[0] == []


def brute_segments(s):
    """Maximal segments by definition: take the best, then go on left and right of it."""
    best = max(((sum(s[a:b]), a - b, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    total, _, a, b = best
    return [*brute_segments(s[:a]), (a, b, total), *[(x + b, y + b, z) for x, y, z in brute_segments(s[b:])]]


def test_segments_are_maximal():
    rng = np.random.default_rng(3)
    for n in range(30):
        s = rng.integers(-40, 30, n).astype(float) + rng.random(n) / 1000
        got = toxicity.segments(s.tolist())
        want = brute_segments(s.tolist())
        assert [(a, b) for a, b, _ in sorted(got)] == [(a, b) for a, b, _ in want]
        assert np.allclose([z for *_, z in sorted(got)], [z for *_, z in want])


def test_passages():
    texts = [f"word{i % 13} {'vile' if i % 4 == 0 else 'kind'} text{i % 17} {'brute' if i % 4 == 0 else 'friend'} item{i % 5}".encode() for i in range(200)]
    labels = np.array([int(i % 4 == 0) for i in range(200)])
    s = toxicity.Scorer(toxicity.log_odds(texts, labels)).fit(texts, labels)
    assert s.passages(b"some text of vile brute kind friend") and not s.passages(b"some text of kind friend")


# --- media --------------------------------------------------------------------------------------


def test_media_round_trip(spark, corpus, docs):
    got = media.media_columns(docs).collect()
    texts = Counter((i, (t or "").encode()) for i, t in corpus)
    found = Counter()
    for r in got:
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            stored = f.read(r.length)
        payload = media.decode(stored)
        raw = payload[: r.n_bytes]
        found[r.doc_id, raw] += 1
        assert payload == raw + b" " * (len(payload) - len(raw)) and len(payload) % 192 == 0 and 0 < len(payload) <= max(192, len(raw) + 191)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.digest) == (len(stored), hashlib.sha256(stored).hexdigest(), r.media_sha256)
        assert (r.width, r.height, r.bits) == (192, len(payload) // 192, 8) and r.feature.startswith(f"png:192x{r.height}x8:")
    assert found == texts
    for path in {r.shard for r in got}:
        with tarfile.open(path.removeprefix("file://")) as tar:
            names = [m.name for m in tar]
            assert len(names) == len(set(names))
            assert all(hashlib.sha256(tar.extractfile(m).read()).hexdigest() + ".png" == m.name for m in tar.getmembers())
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.tail_crc32))
    assert all(len(v) == 1 for v in by_text.values())


def test_media_shards_and_catalogue(spark, docs):
    index = media.store(docs, shard_bytes=2000)
    assert index.select("shard").distinct().count() > 3
    assert media.catalogue(index).agg(F.sum("n_rows")).first()[0] == docs.count()
    assert media.media_columns(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        media.decode(media.encode(b"x" * 192)[:-20] + b"\0" * 20)
    assert media.header(media.encode(b" " * 384)[:33]) == (192, 2, 8)
    assert io.BytesIO(media.encode(b"y" * 192)).read(8) == b"\x89PNG\r\n\x1a\n"


# --- decontamination ----------------------------------------------------------------------------

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items):
    split = lambda t: _WORD.findall((t or "").encode().lower())
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= ids
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_FINGERPRINTS, 0])
def test_decontamination_equals_brute_force(spark, corpus, bound):
    ten = "alpha Beta gamma delta Épsilon zeta eta theta iota kappa"
    items = [(1, ten + " lambda"), (2, ten), (30, "one TWO three"), (4, None), (5, " .. "), (6, "same " * 14), (7, corpus[4][1][:400]), (8, "solo"), (9, ten + " lambda"), (10, "ab" * 400)]
    extra = [(200, f"x, {ten.lower().replace('É', 'é')}. y"), (201, ten.replace(" ", "--") + " lambda mu"), (202, "one two three one Two, three"), (203, "one two"), (204, "same " * 9), (205, "same " * 40), (206, "a solo b"), (207, ten[6:] + " " + ten[:40]), (208, "Épsilon " + ten), (209, (ten + " ") * 50)]
    rows = corpus + extra
    got = decontaminate.contamination(frame(spark, rows).repartition(3), spark.createDataFrame(items, "item_id long, text string"), bound, keep=("h", "text")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == brute_contamination(rows, items)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit and r.h == "x" for r in got)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)


def test_decontamination_of_empty_tables(spark, docs, corpus):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(docs.where("false"), items).collect() == []
    got = decontaminate.contamination(docs, items.where("false")).collect()
    assert len(got) == len(corpus) and not any(r.n_hit for r in got)


# --- tokens -------------------------------------------------------------------------------------


@needs_model
def test_pieces_match_the_models_own_library(spark, corpus, docs):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {(r.doc_id, r.decoded): r for r in pieces.encode(docs).collect()}
    for i, t in corpus:
        r = got[i, t or ""]
        assert r.ids == own.encode(t or "") and r.n_tokens == len(r.ids) and r.lossless
    back = pieces.decode(pieces.encode(docs).select("doc_id", "ids")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in corpus)
    assert pieces.encode(docs.where("false")).collect() == []


def test_unigram_model_is_parsed_and_rebuilt():
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def piece(text, score, kind):
        body = b"\x0a" + varint(len(text.encode())) + text.encode() + b"\x15" + np.float32(score).tobytes() + b"\x18" + varint(kind)
        return b"\x0a" + varint(len(body)) + body

    vocabulary = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{i:02X}>", 0, 6) for i in range(256)], ("▁", -3, 1), ("▁a", -1, 1), ("b", -2, 1), ("▁ab", -1.5, 1), ("c", -2, 1)]
    trainer = b"\x18\x01" + varint(35 << 3) + b"\x01"
    data = b"".join(piece(*p) for p in vocabulary) + b"\x12" + varint(len(trainer)) + trainer + b"\x1a\x02\x20\x00"
    c = pieces.Codec(data)
    assert c.model.kind == pieces.UNIGRAM and c.model.byte_fallback and not c.model.remove_extra_whitespaces
    c.parity(data, ["ab c", "a b", "abc abé", ""])
    assert c.decode(*c.encode(["ab é  c", "", " b "])) == [x.encode() for x in ("ab é  c", "", " b ")]
    with pytest.raises(ValueError):
        c.cache["▁ab"] = c.cache["▁c"]
        c.parity(data, ["ab"])
    with pytest.raises(ValueError):
        pieces.parse(data + piece("x", 0, 4))


# --- language model -----------------------------------------------------------------------------


def test_language_model_scores(spark, corpus, docs):
    got = pitman_yor.score(docs, labelled.held_out_rule(7, 2)).collect()
    tokens = {}
    for i, t in corpus:
        tokens.setdefault(i, []).append([*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None])
    train = Counter(w for i, t in tokens.items() for x in t for w in x if i is None or crc(i, 7) != 2)
    n, v = sum(train.values()), len(train)
    assert len(got) == len(corpus)
    for r in got:
        options = [x for x in tokens[r.doc_id] if len(x) == r.n_tokens]
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id, 7) == 2) and r.train_tokens == n
        assert any(r.n_known == sum(train[w] > 0 for w in x) and r.base_score == pytest.approx(sum(np.log10((train[w] + 1) / (n + v + 1)) for w in x)) for x in options)
        assert np.isfinite(r.score) and r.score < 0
    again = {(r.doc_id, r.n_tokens): r.score for r in pitman_yor.score(docs, labelled.held_out_rule(7, 2)).collect()}
    assert all(again[r.doc_id, r.n_tokens] == pytest.approx(r.score, abs=1e-4) for r in got)


@needs_data
def test_language_model_beats_its_base_on_held_out_texts(spark):
    got = pitman_yor.score(spark.read.parquet(f"{DATA}/documents.parquet"), labelled.held_out_rule(7, 2)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.3


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    words = np.arange(1, 41, dtype=np.uint64)
    contexts = np.array([0, 1 + 256, 2 + 256, 1 + 512], np.uint16)
    counts = rng.poisson(0.7, (40, 4)).astype(np.int64)
    model = {"words": words, "n": np.full(40, 4), "context": np.tile(contexts, 40), "count": counts.ravel()}
    v = int((counts.sum(axis=1) > 0).sum())
    r = pitman_yor._Restaurants(model, {}, [0.5] * 3, v)
    totals = lambda: {(int(x.level), int(x.context)): (x.customers, x.tables) for x in r.totals().itertuples()}
    r = pitman_yor._Restaurants(model, totals(), [0.5] * 3, v)
    for i in range(5):
        r.sweep(np.random.default_rng(i))
        r.customers, r.tables = [np.zeros(1), np.zeros(256), np.zeros(65536)], [np.zeros(1), np.zeros(256), np.zeros(65536)]
        for (level, c), (n, t) in totals().items():
            r.customers[level][c], r.tables[level][c] = n, t
        r.look()
        unseen = (counts.sum(axis=1) == 0).sum()
        for c in contexts:
            p = r.p2[r.context == c]
            known = counts.sum(axis=1) > 0
            # one unknown word has what the known ones leave
            assert p[known].sum() + p[~known].mean() == pytest.approx(1, abs=1e-6) if unseen else p.sum() < 1
    assert (r.t2 <= r.count).all() and ((r.t2 > 0) == (r.count > 0)).all()


def test_language_model_of_an_empty_table(spark):
    assert pitman_yor.score(frame(spark, [(1, "x")]).where("false"), labelled.held_out_rule(7, 2)).collect() == []
    got = pitman_yor.score(frame(spark, [(1, "x y")]), F.lit(True)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0) and got.base_score == 0 and got.score == pytest.approx(0, abs=1e-6)


def test_evidence_takes_all_passages_of_a_long_text():
    scorer = toxicity.Scorer({b"bad": 1.5})
    text = b"bad x y z " * 120
    # 120 passages of score 1 where 30 are expected
    scorer.rate, scorer.scale = 1.0, 30 * math.e / 480
    assert [s for _, _, s in toxicity.segments(scorer.values(text))] == [1.0] * 120
    want = math.lgamma(121) / math.log(10) - 120 * math.log10(30)
    assert abs(scorer.evidence(text) - want) < 1e-6 and want > 21
