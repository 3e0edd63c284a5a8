"""The corpus pipeline stage by stage against brute force on what each stage got."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from lexiquarry.llm import pieces, runtime

from .test_dedup import brute_bytes, brute_components, near_pairs
from .test_models import brute_contamination

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    # one long passage is junk, all else is good
    labels = [(i, int(i not in (12, 90, 91)), 0) for i, _ in corpus if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, corpus[30][1]), (2, "a b c")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_each_stage_equals_brute_force(spark, tables):
    docs = runtime.read(spark, tables, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    (_, quality), (_, near), (_, suffix), (_, clean), (_, encode) = corpus_pipeline.STAGES

    first = runtime.materialise(quality(spark, docs, tables), "t")
    assert first.columns == list(corpus_pipeline.COLUMNS) == docs.columns
    every, kept = Counter(map(tuple, docs.collect())), Counter(map(tuple, first.collect()))
    assert not kept - every and len(every - kept) < 8

    second = runtime.materialise(near(spark, first, tables), "t")
    rows = [(r.doc_id, r.text) for r in first.collect()]
    stay = Counter(i for (i, *_, k), n in brute_components(rows, corpus_pipeline.NEAR_PERCENT).items() for _ in range(n) if k or i is None)
    assert Counter(r.doc_id for r in second.collect()) == stay and second.columns == docs.columns

    third = runtime.materialise(suffix(spark, second, tables), "t")
    want = Counter((i, kept.decode(errors="ignore")) for (i, *_, kept), n in brute_bytes([(r.doc_id, r.text) for r in second.collect()], 100).items() for _ in range(n))
    got = third.collect()
    assert Counter((r.doc_id, r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got)

    fourth = runtime.materialise(clean(spark, third, tables), "t")
    items = [(r.item_id, r.text) for r in runtime.read(spark, tables, "benchmark").collect()]
    hit = Counter()
    for (i, _, n_hit, _), n in brute_contamination([(r.doc_id, r.text) for r in got], items).items():
        hit[i] += n * (n_hit == 0)
    assert Counter(r.doc_id for r in fourth.collect()) == +hit

    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    last = encode(spark, fourth, tables).collect()
    texts = {r.doc_id: r.text for r in fourth.collect()}
    assert len(last) == fourth.count() and all(list(r.ids) == own.encode(texts[r.doc_id]) for r in last)


def test_run_on_empty_tables(spark, tables, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        runtime.read(spark, tables, t).where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_dedup_stage_takes_a_similarity_of_four_fifths(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t in near_pairs(10, 19) + [(i + 100, t.replace("p", "q")) for i, t in near_pairs(10, 22)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.minhash_near_dedup(spark, docs, str(tmp_path))
    # 177 of 215 shingles are shared by the first pairs, 174 of 218 by the others
    assert sorted(r.doc_id for r in got.collect()) == [2 * i for i in range(10)] + list(range(100, 120))


def test_near_dedup_stage_keeps_one_of_a_group_with_null_ids(spark, tmp_path):
    (_, a), (_, b), (_, c), (_, d), (_, e), _ = near_pairs(3, 10)
    rows = [(1, a, "en"), (2, b, "en"), (None, a, "en"), (None, b, "de"), (None, c, "fr"), (None, d, "fr"), (None, e, "es"), (-5, "x y", "en"), (None, "", "it"), (None, None, "it")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, (r.text or "")[:2]) for r in corpus_pipeline.minhash_near_dedup(spark, docs.repartition(3), str(tmp_path)).collect())
    assert got == {(None, "p0"): 1, (None, "p1"): 1, (None, "p2"): 1, (-5, "x "): 1, (None, ""): 2}
