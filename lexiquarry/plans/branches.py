"""Queries whose data takes the branches that the first queries of their operators leave idle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import external, latest, merge, pivots, sample, search, substring_index
from ..sources import files, paged, stored
from . import queries as q
from .queries import _FOUND_HALF, _PAIRS_HALF
from .views import BANK, RESULTS, bank, results

QUERIES: dict[str, q.Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(fn: q.Query) -> q.Query:
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return register


# --- search -------------------------------------------------------------------------------------

_DEEP = search.SearchSpec(text="e", active="true", sort="n_chars", direction="desc", sortable=("id", "n_chars"), columns=("id", "subject", "n_chars"))


@query(f"""WITH {BANK}, f AS (SELECT id, subject, n_chars, row_number() OVER (ORDER BY n_chars DESC, id) AS rn, count(*) OVER () AS n FROM bank WHERE is_active AND question ILIKE '%e%')
SELECT id, subject, n_chars FROM f WHERE rn > (ceil(n / 50.0) - 1) * 50""")
def t2_last_page(spark, sf):
    b = bank(spark, sf)
    return search.deep_page(b, replace(_DEEP, page=search.total(b, _DEEP).first().pages))


@query(f"WITH {BANK} SELECT id FROM bank WHERE trim(chapter) IN ('src1', 'src3')")
def f5_chapter_list(spark, sf):
    b = bank(spark, sf).withColumn("chapter", F.trim("chapter"))
    return b.where(search.condition(b, search.SearchSpec(chapters=("src3 ", " ", " src1")))).select("id")


def _has_grams(needle: str) -> str:
    return " AND ".join(f"(contains(lower(question), '{g}') OR contains(lower(source_pdf_filename), '{g}'))" for g in substring_index.needle_grams(needle))


@query(f"WITH {BANK}, c AS (SELECT * FROM bank WHERE {_has_grams('ING o%the')}) SELECT id, (SELECT count(*) FROM c) AS checked FROM c WHERE question ILIKE '%ing o%the%' OR source_pdf_filename ILIKE '%ing o%the%'")
def f7_indexed_substring(spark, sf):
    b, columns = bank(spark, sf), ["question", "source_pdf_filename"]
    path = f"{stored.scratch(spark)}/grams"
    # the documents' part of the bank: all its ids and texts, without a join that labels no text
    texts = files.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.col("source").alias("source_pdf_filename"))
    substring_index.store(substring_index.postings(texts, columns), path)
    found, checked = substring_index.search(b, spark.read.parquet(path), "ING o%the", columns)
    return found.select("id").crossJoin(checked)


_SETS_SQL = f"""WITH {BANK}, k AS (SELECT subject, t AS test_number, row_number() OVER (PARTITION BY subject, t ORDER BY md5('set:' || t || ':' || id), id) AS rn FROM bank, range(1, 7) r(t))
SELECT test_number::INTEGER AS test_number, count(*) AS question_count FROM k WHERE rn <= 45 AND subject = 'fr' GROUP BY subject, test_number HAVING count(*) = 45 ORDER BY 1"""


@query(_SETS_SQL)
def t4_catalogue(spark, sf):
    return sample.catalogue(sample.test_sets(bank(spark, sf)), "fr").select("test_number", "question_count")


# --- near-duplicates, files, names --------------------------------------------------------------


@query(f"{_PAIRS_HALF} SELECT * FROM ({_FOUND_HALF}) f WHERE NOT EXISTS (SELECT 1 FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id = f.id_a AND b.doc_id = f.id_b AND a.doc_id % 2 = 0)")
def j2_real_dismissals(spark, sf):
    # a digest stands for the text
    d = files.table(spark, sf, "documents").select("doc_id", F.unhex(F.sha2("text", 256)).alias("text"))
    copies = d.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "a").join(d.withColumnRenamed("doc_id", "b"), "text").where("a < b")
    # as a user gives them, in either order
    return q._near(spark, sf, 0.5, dismissed=copies.select(F.col("b").alias("id_a"), F.col("a").alias("id_b")))


@query("SELECT doc_id, CASE source WHEN 'src0' THEN 2008 WHEN 'src2' THEN 2013 END AS year, CASE source WHEN 'src0' THEN 'sol' WHEN 'src2' THEN 'q_format' END AS format FROM documents WHERE source IN ('src0', 'src2')")
def s6_configured_files(spark, sf):
    config = spark.createDataFrame([("src0", 2008, "sol"), ("src2", 2013, "q_format"), ("missing", 2015, "standard")], "file string, year int, format string")
    return files.configured(files.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("a/b/"), "source").alias("path")), config).select("doc_id", "year", "format")


_NAMES = "SELECT doc_id, (['le', 'ke', 'x'])[doc_id % 3 + 1] || (['bo', 'CH', 'ph', 'qq'])[doc_id % 4 + 1] || '1' || (doc_id % 7) || (['ps', 'bo'])[doc_id % 2 + 1] || '.pdf' AS name FROM documents"


@query(f"""SELECT doc_id, CASE WHEN contains(lower(name), 'bo') THEN 'Biology' WHEN contains(lower(name), 'ch') THEN 'Chemistry' WHEN contains(lower(name), 'ph') THEN 'Physics' ELSE 'Biology' END AS subject,
CASE WHEN starts_with(lower(name), 'le') THEN 12 ELSE 11 END AS class FROM ({_NAMES})""")
def x6_x7_derived_names(spark, sf):
    pick = lambda n, *words: F.element_at(F.array(*map(F.lit, words)), (F.col("doc_id") % n + 1).cast("int"))
    name = F.concat(pick(3, "le", "ke", "x"), pick(4, "bo", "CH", "ph", "qq"), F.lit("1"), (F.col("doc_id") % 7).cast("string"), pick(2, "ps", "bo"), F.lit(".pdf"))
    return files.table(spark, sf, "documents").select("doc_id", text.subject_of_file(name).alias("subject"), text.class_of_file(name).alias("class"))


@query("SELECT page_id AS source_page, html AS question, '' AS option_a, coalesce(CASE WHEN page_id % 3 = 0 THEN url END, '') AS option_b, '' AS option_c, '' AS option_d, '' AS correct_answer, coalesce(CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END, false) AS has_diagram FROM pages")
def p3_extracted_defaults(spark, sf):
    kind = F.col("page_id") % 3
    p = files.table(spark, sf, "pages").select(F.col("page_id").alias("page"), F.col("html").alias("question"), F.lit(None).cast("string").alias("option_a"), F.when(kind == 0, F.col("url")).alias("option_b"), F.lit("").alias("option_c"), F.lit(None).cast("string").alias("option_d"), F.when(kind == 0, 1).when(kind == 1, 0).alias("has_diagram"))
    return files.extracted_questions(p)


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>')) AS tail_md5 FROM pages")
def x21_tail_escape(spark, sf):
    return files.table(spark, sf, "pages").select("page_id", F.md5(text.escape_tail(F.col("html"))).alias("tail_md5"))


# --- changes ------------------------------------------------------------------------------------


@query(q.ORACLES["k4_upsert"])
def k4_stored_upsert(spark, sf):
    old = files.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("free").alias("plan"), F.lit(1).cast("long").alias("updated_at"))
    new = files.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.lit("pro").alias("plan"), (F.col("o_orderkey") + 1).alias("updated_at"))
    table = stored.StoredTable(spark, f"{stored.scratch(spark)}/plans", ["user_id"])
    table.replace(old)
    table.change(new, lambda t, r: merge.upsert(t, r, ["user_id"], "updated_at"))
    return table.read()


@query("""WITH o AS (SELECT o_orderstatus AS subject, o_custkey AS test_number, o_orderkey AS version FROM orders)
SELECT subject, test_number, max(version) AS version FROM o GROUP BY 1, 2""")
def k5_upsert_into_sets(spark, sf):
    o = files.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("subject"), F.col("o_custkey").alias("test_number"), F.col("o_orderkey").alias("version"))
    keys = ["subject", "test_number"]
    # what is stored has one row a key; the rest comes as changes, newer and older ones
    held = o.where("version % 2 = 0").groupBy(*keys).agg(F.max("version").alias("version"))
    return merge.upsert(held, o.where("version % 2 = 1"), keys, "version")


@query("SELECT DISTINCT o_custkey + 700 AS id FROM orders WHERE o_custkey + 700 NOT IN (SELECT c_custkey FROM customer)")
def k7_not_found(spark, sf):
    changes = files.table(spark, sf, "orders").select((F.col("o_custkey") + 700).alias("id"), F.lit("x").alias("chapter"))
    return merge.not_found(files.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), changes)


@query(f"WITH {BANK} SELECT count(*) AS updated FROM bank WHERE id IN (SELECT doc_id * 2 FROM labels)")
def k8_updated_count(spark, sf):
    ids = files.table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("id"))
    return merge.updated(bank(spark, sf).select("id"), ids)


@query("""WITH t AS (SELECT conv_id, turn, role, sha256('en:' || lower(trim(string_split(text, ' ')[1]))) AS question_hash FROM conversations),
cache AS (SELECT question_hash, max(conv_id * 1000 + turn) AS answer FROM t WHERE role = 'user' AND conv_id % 2 = 0 GROUP BY 1)
SELECT conv_id, turn, question_hash, answer, answer // 1000 <> conv_id AS elsewhere FROM t LEFT JOIN cache USING (question_hash)""")
def k13_answers_from_elsewhere(spark, sf):
    c = files.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.substring_index("text", " ", 1).alias("text"))
    key = lambda t: merge.answer_key(F.lit("en"), t)
    cache = c.where("role = 'user' AND conv_id % 2 = 0").groupBy(key(F.col("text")).alias("question_hash")).agg(F.max(F.col("conv_id") * 1000 + F.col("turn")).alias("answer"))
    hits, _ = merge.cached(c.select("conv_id", "turn", "text"), cache, "text", "answer", key)
    return hits.select("conv_id", "turn", "question_hash", "answer", (F.floor(F.col("answer") / 1000) != F.col("conv_id")).alias("elsewhere"))


# --- samples, trends, pages ---------------------------------------------------------------------


@query(f"""WITH {BANK}, s AS (SELECT subject, least(n, 45) AS n FROM (SELECT subject, count(*) AS n FROM bank WHERE subject IN ('de', 'fr') GROUP BY 1))
SELECT (SELECT least(count(*), 90) FROM bank WHERE subject = 'en') + sum(n)::BIGINT AS count FROM s""")
def a17_sample_count(spark, sf):
    return sample.stratified(bank(spark, sf), {"en": 90, "de": 45, "fr": 45}).agg(F.count("*").alias("count"))


_NEW = "row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn"


@query(f"""WITH {RESULTS}, k AS (SELECT *, score - 100 AS points, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT *, {_NEW} FROM results) WHERE rn <= 12)
SELECT user_id, id, round(10 + (n - rn) / (n - 1)::DOUBLE * 860, 6) AS x, round(16 + 154 * (1 - greatest(0, points) / 720.0::DOUBLE), 6) AS y FROM k WHERE n >= 2""")
def w2_chart_points(spark, sf):
    r = results(spark, sf).withColumn("score", F.col("score") - 100)
    return latest.trend(r, point=scoring.chart_point).select("user_id", "id", F.round("point.x", 6).alias("x"), F.round("point.y", 6).alias("y"))


def _reader(pdf: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a page reader, which fails on pages with an even number of bytes."""
    raw = [t.encode() for t in pdf["text"]]
    return pd.DataFrame({"first": [None if len(r) % 2 == 0 else t[:20] for r, t in zip(raw, pdf["text"])], "size": [len(r) for r in raw]})


_STRIPPED = r"regexp_replace(html, '^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$', '', 'g')"


@query(f"""WITH p AS (SELECT page_id // 8 AS doc, page_id % 8 AS page, CASE WHEN page_id % 5 = 0 THEN substr(html, 1, 30) WHEN page_id % 7 = 0 THEN '<<<' || repeat('-/', 60) || substr(url, 1, 20) ELSE html END AS html FROM pages),
g AS (SELECT *, length({_STRIPPED}) < 40 OR length(regexp_replace({_STRIPPED}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 0.3 * length({_STRIPPED}) AS bad, octet_length(encode(html)) AS size FROM p)
SELECT doc, page, CASE WHEN NOT bad AND size % 2 = 1 THEN substr(html, 1, 20) END AS first, CASE WHEN NOT bad THEN size::INTEGER END AS size, bad OR size % 2 = 0 AS failed FROM g""")
def u12_pages_with_failures(spark, sf):
    i, html = F.col("page_id"), F.col("html")
    odd = F.when(i % 5 == 0, F.substring(html, 1, 30)).when(i % 7 == 0, F.concat(F.lit("<<<" + "-/" * 60), F.substring("url", 1, 20))).otherwise(html)
    pages = files.table(spark, sf, "pages").select(F.floor(i / 8).alias("doc"), (i % 8).alias("page"), odd.alias("text"))
    return external.extract_pages(pages, _reader, "first string, size int").select("doc", "page", "first", "size", "failed")


# --- vectors ------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INTEGER AS rank, vec_id, similarity FROM s WHERE similarity > 0.2 QUALIFY rank <= 5""")
def t7_nearest_of_each(spark, sf):
    e = files.table(spark, sf, "embeddings")
    return pivots.nearest(e, e.where("vec_id % 100 = 0"), 5, 0.2, id="vec_id").found.withColumnRenamed("id", "vec_id")


# --- sources ------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, text FROM documents")
def s2_paged_scan(spark, sf):
    service = paged.ParquetPages(f"{sf}/documents.parquet", ["doc_id", "lang", "text"])
    return paged.paged(spark, "document_pages", service, "doc_id long, lang string, text string", rows=service.rows(), pages_each=16)


def _pages_of(path: str) -> Iterator[bytes]:
    """A stand-in for a document library: the rows of a Parquet file are its pages."""
    with pq.ParquetFile(path, buffer_size=1 << 20) as rows:
        for batch in rows.iter_batches(256, columns=["text"]):
            yield from ((t.as_py() or "").encode() for t in batch.column("text"))


def _document_files(spark, sf):
    """The benchmark's files, of a list that also names one that is missing."""
    every = files.listing(spark, sf, "benchmark*.parquet")
    config = spark.createDataFrame([("benchmark.parquet", 2013, "q_format"), ("missing.parquet", 2015, "standard")], "file string, year int, format string")
    return every, config


@query("SELECT 2013 AS year, 'q_format' AS format, count(*)::INTEGER AS pages, md5(string_agg(text, chr(10) ORDER BY item_id)) AS text_md5 FROM benchmark")
def s4_s7_page_texts(spark, sf):
    every, config = _document_files(spark, sf)
    texts = files.page_texts(every, lambda copy: [t.decode() for t in _pages_of(copy)], by_path=True)
    return files.configured(texts, config).select("year", "format", "pages", F.md5("text").alias("text_md5"))


@query("SELECT count(*) AS pages, md5(base64(encode(coalesce(text, '')))) AS image_md5 FROM documents GROUP BY 2")
def s10_page_images(spark, sf):
    images = files.page_images(files.listing(spark, f"{sf}/documents.parquet", "*.parquet"), _pages_of, by_path=True)
    return images.groupBy(F.md5("image").alias("image_md5")).agg(F.count("*").alias("pages"))
