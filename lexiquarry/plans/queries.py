"""Registered queries of the question-bank operators, each beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scoring, text
from ..operators import chunk, external, latest, layout, lookup, merge, near_duplicates, parse, profile, repair, sample, search, vector
from ..sources import files
from ..streaming import limits
from .views import BANK, RESULTS, bank, results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# --- scans, filters, paging ---------------------------------------------------------------------

_BANK_SEARCH = search.SearchSpec(text="the", has_diagram=True, active="true", sort="n_chars", direction="desc", page=2, sortable=("id", "n_chars"), columns=("id", "subject", "n_chars"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def s1_table_scan(spark, sf):
    return files.table(spark, sf, "documents").where("lang = 'en' AND n_chars > 500").select("doc_id", "source", "n_chars")


@query(f"""WITH {BANK} SELECT id, subject, n_chars FROM bank
WHERE is_active AND diagram_url <> '' AND question ILIKE '%the%' ORDER BY n_chars DESC, id LIMIT 50 OFFSET 50""")
def t2_search_page(spark, sf):
    return search.page(bank(spark, sf), _BANK_SEARCH)


@query(f"""WITH {BANK} SELECT count(*) AS total, greatest(1, ceil(count(*) / 50.0))::BIGINT AS pages FROM bank
WHERE is_active AND diagram_url <> '' AND question ILIKE '%the%'""")
def t3_search_total(spark, sf):
    return search.total(bank(spark, sf), _BANK_SEARCH)


@query(f"""WITH {BANK} SELECT id FROM bank WHERE subject = 'en' AND chapter IN (' src1', 'src2')
UNION ALL SELECT id FROM bank WHERE chapter IN ('src3')""")
def f5_membership(spark, sf):
    b = bank(spark, sf)
    first = b.where((F.col("subject") == "en") & F.col("chapter").isin(" src1", "src2"))
    return first.select("id").unionByName(b.where(search.condition(b, search.SearchSpec(chapters=("src3 ", " ")))).select("id"))


@query(f"WITH {BANK} SELECT id FROM bank WHERE correct_answer IS NULL OR correct_answer = ''")
def f6_null_or_empty(spark, sf):
    b = bank(spark, sf)
    return b.where(search.condition(b, search.SearchSpec(missing_answer=True))).select("id")


@query(f"WITH {BANK} SELECT id FROM bank WHERE (question ILIKE '%ing o%' OR source_pdf_filename ILIKE '%ing o%') AND (chapter IS NULL OR chapter = '')")
def f7_substring_any_column(spark, sf):
    b = bank(spark, sf)
    return b.where(search.condition(b, search.SearchSpec(text="ING o", missing_chapter=True, text_columns=("question", "source_pdf_filename")))).select("id")


@query(f"WITH {BANK} SELECT count(*) AS n FROM bank WHERE diagram_url <> ''")
def f9_has_diagram(spark, sf):
    return bank(spark, sf).where(search.any_present(F.col("diagram_url"))).agg(F.count("*").alias("n"))


@query(f"WITH {BANK} SELECT id, subject FROM bank WHERE subject = 'de' OR source_pdf_filename = 'de'")
def f12_tag(spark, sf):
    return bank(spark, sf).where(search.tagged("de", F.col("subject"), F.col("source_pdf_filename"))).select("id", "subject")


@query(r"""SELECT doc_id, length(trim(text, E' \n\t')) < 40 OR length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) < 0.3 * length(trim(text, E' \n\t')) AS garbled FROM documents""")
def f14_garbled(spark, sf):
    return files.table(spark, sf, "documents").select("doc_id", text.garbled(F.col("text")).alias("garbled"))


# --- profiles -----------------------------------------------------------------------------------


@query(f"""WITH {BANK} SELECT count(*) AS total, count(*) FILTER (correct_answer IS NULL OR correct_answer = '') AS missing_answer,
count(*) FILTER (chapter IS NULL OR chapter = '') AS missing_chapter FROM bank WHERE is_active""")
def a2_gaps(spark, sf):
    return profile.gaps(bank(spark, sf))


@query(f"WITH {BANK} SELECT trim(chapter) AS chapter, count(*) AS count FROM bank WHERE subject = 'en' AND is_active AND trim(chapter) <> '' GROUP BY 1 ORDER BY 1")
def a3_chapter_counts(spark, sf):
    return profile.counts(bank(spark, sf), "chapter", (F.col("subject") == "en") & F.col("is_active"))


@query(f"WITH {BANK} SELECT DISTINCT trim(chapter) AS chapter FROM bank WHERE trim(chapter) <> '' ORDER BY 1")
def a4_distinct_chapters(spark, sf):
    return profile.distinct_values(bank(spark, sf), "chapter")


@query(f"""WITH {BANK} SELECT source_pdf_filename, array_to_string(list_sort(list(DISTINCT subject) FILTER (trim(subject) <> '')), ',') AS subjects,
count(*) AS count, min(id) AS first_upload, max(id) AS last_upload FROM bank WHERE source_pdf_filename <> '' GROUP BY 1 ORDER BY last_upload DESC, 1""")
def a5_upload_history(spark, sf):
    return profile.upload_history(bank(spark, sf), time="id")


@query(f"WITH {BANK} SELECT trim(coalesce(chapter, '')) AS chapter, count(*) AS count FROM bank GROUP BY 1")
def a6_histogram(spark, sf):
    return profile.histogram(bank(spark, sf), "chapter")


@query(f"WITH {BANK} SELECT count(*) FILTER (chapter <> '') AS has_chapter, count(*) FILTER (correct_answer <> '') AS has_correct_answer FROM bank")
def a7_presence(spark, sf):
    return profile.presence(bank(spark, sf), "chapter", "correct_answer")


@query(f"""WITH {RESULTS} SELECT user_id, count(*) AS tests, max(score) AS best, floor(avg(score) + 0.5)::BIGINT AS mean,
arg_max(score, (created_at, id)) - arg_min(score, (created_at, id)) AS change FROM results GROUP BY user_id""")
def a10_scoreboard(spark, sf):
    return profile.scoreboard(results(spark, sf))


_USAGE = "usage AS (SELECT user_id, (created_at + INTERVAL 330 MINUTES)::DATE AS usage_date, sum(k)::BIGINT AS tokens_used FROM results WHERE k > 0 GROUP BY 1, 2)"


@query(f"""WITH {RESULTS}, {_USAGE}, plans AS (SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 5000 THEN 'pro' ELSE 'free' END AS plan FROM customer)
SELECT user_id, usage_date, tokens_used, coalesce(plan, 'free') = 'free' AND tokens_used >= 200 AS blocked,
CASE WHEN coalesce(plan, 'free') = 'free' THEN greatest(0, 200 - tokens_used) END AS "left" FROM usage LEFT JOIN plans USING (user_id)""")
def a16_daily_budget(spark, sf):
    usage = profile.daily_usage(results(spark, sf), "user_id", "created_at", "k")
    plans = files.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 5000, "pro").otherwise("free").alias("plan"))
    return profile.budget(usage, plans, "user_id", 200)


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders")
def a15_tally(spark, sf):
    return profile.tally(files.table(spark, sf, "orders"), "o_orderstatus", "F", "O", "P")


# --- newest rows of each user -------------------------------------------------------------------

_NEW = "row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn"


@query(f"WITH {RESULTS} SELECT user_id, count(*) AS tests, format('{{:.0f}}', round(avg(score), 0)) AS mean FROM (SELECT *, {_NEW} FROM results) WHERE rn <= 5 GROUP BY user_id")
def a8_recent_mean(spark, sf):
    return latest.recent_mean(results(spark, sf))


@query(f"""WITH {RESULTS}, c AS (SELECT user_id, chapter, count(*) AS count, min(rn) AS seen FROM (SELECT *, {_NEW} FROM results) WHERE rn <= 15 AND chapter <> '' GROUP BY 1, 2)
SELECT user_id, chapter, count, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY count DESC, seen) AS place FROM c) WHERE place <= 3""")
def a9_weak_topics(spark, sf):
    return latest.weak_topics(results(spark, sf))


@query(f"WITH {RESULTS} SELECT user_id, id, score, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id)::INTEGER AS ordinal FROM results")
def p8_ordinals(spark, sf):
    return latest.ordinals(results(spark, sf)).select("user_id", "id", "score", "ordinal")


@query(f"""WITH {RESULTS}, k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT *, {_NEW} FROM results) WHERE rn <= 12)
SELECT user_id, id, n, n - rn AS "index", (n - rn) % ceil(n / 6.0)::BIGINT = 0 AS labelled,
round((n - rn) / (n - 1)::DOUBLE * 100, 6) AS x, round(100 - score / 720.0::DOUBLE * 100, 6) AS y FROM k WHERE n >= 2""")
def w1_trend(spark, sf):
    return latest.trend(results(spark, sf)).select("user_id", "id", "n", "index", "labelled", F.round("point.x", 6).alias("x"), F.round("point.y", 6).alias("y"))


# --- scalar functions ---------------------------------------------------------------------------


@query(f"""WITH {RESULTS} SELECT id, floor(score / 720.0::DOUBLE * 100 + 0.5)::BIGINT AS pct,
CASE WHEN score / 720.0::DOUBLE * 100 >= 70 THEN 'high' WHEN score / 720.0::DOUBLE * 100 >= 50 THEN 'good' WHEN score / 720.0::DOUBLE * 100 >= 30 THEN 'fair' ELSE 'low' END AS band,
CASE WHEN k * 97 >= 3600 THEN (k * 97 // 3600)::VARCHAR || 'h ' || (k * 97 % 3600 // 60)::VARCHAR || 'm' ELSE (k * 97 // 60)::VARCHAR || 'm ' || (k * 97 % 60)::VARCHAR || 's' END AS took FROM results""")
def p5_p7_scores(spark, sf):
    r = results(spark, sf)
    return r.select("id", scoring.percent(F.col("score")).alias("pct"), scoring.band(F.col("score")).alias("band"), scoring.duration(F.col("k") * 97).alias("took"))




def _band_sql(pick: int) -> str:
    return "CASE " + " ".join(f"WHEN score >= {b[0]} THEN {b[pick]!r}" for b in fixed.RANK_BANDS) + " END"


@query(f"WITH {RESULTS} SELECT id, ({_band_sql(1)})::INTEGER AS rank_from, ({_band_sql(2)})::INTEGER AS rank_to, ({_band_sql(3)})::DOUBLE AS percentile FROM results WHERE score > 0 AND score <= 720")
def j9_rank_bands(spark, sf):
    r = results(spark, sf).where(scoring.valid(F.col("score")))
    return r.select("id", scoring.rank_band(F.col("score")).alias("b")).select("id", "b.*")


@query(f"""WITH {RESULTS}, c AS (SELECT *, CASE WHEN chapter = 'click' THEN 'general' ELSE 'obc' END AS category,
CASE WHEN score >= 550 THEN 'high' WHEN score >= 450 THEN 'moderate' ELSE 'low' END AS base FROM results WHERE score > 0)
SELECT id, CASE WHEN category = 'general' THEN base WHEN score >= 400 THEN 'possible' WHEN score >= 350 AND base = 'low' THEN 'check-cutoff' ELSE base END AS admission,
CASE WHEN score >= 620 THEN 'likely' WHEN score >= 550 THEN 'possible' ELSE 'unlikely' END AS government_seat FROM c""")
def x19_chances(spark, sf):
    category = F.when(F.col("chapter") == "click", "general").otherwise("obc")
    return results(spark, sf).where(scoring.valid(F.col("score"))).select("id", scoring.chances(F.col("score"), category).alias("c")).select("id", "c.*")


_STOP = ", ".join(f"'{w}'" for w in fixed.STOPWORDS)
_TOKENS = f"list_distinct(list_filter(string_split_regex(lower(coalesce({{}}, '')), '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})))"


@query(f"SELECT doc_id, len({_TOKENS.format('text')})::INTEGER AS n_tokens, md5(array_to_string(list_sort({_TOKENS.format('text')}), ' ')) AS tokens_md5 FROM documents")
def x1_token_sets(spark, sf):
    d = files.table(spark, sf, "documents").select("doc_id", text.token_set(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens_md5"))


_PAIRS = f"""WITH s AS (SELECT doc_id AS id, lang AS subject, {_TOKENS.format('text')} AS t FROM documents),
p AS (SELECT a.subject, a.id AS id_a, b.id AS id_b, len(list_intersect(a.t, b.t)) AS c, len(a.t) + len(b.t) AS n
  FROM s a JOIN s b ON a.subject = b.subject AND a.id < b.id AND least(len(a.t), len(b.t)) >= 0.8 * greatest(len(a.t), len(b.t)) - 1e-9
  WHERE len(a.t) > 0 AND len(b.t) > 0)"""
_PAIRS_FOUND = "SELECT subject, id_a, id_b, round(c / (n - c)::DOUBLE, 3) AS overlap, c / (n - c)::DOUBLE >= 0.999 AS exact FROM p WHERE c / (n - c)::DOUBLE >= 0.8"


# The operator's and the reference's own threshold.
_PAIRS_HALF, _FOUND_HALF = _PAIRS.replace("0.8", "0.5"), _PAIRS_FOUND.replace("0.8", "0.5")


def _near(spark, sf, threshold=0.5, dismissed=None):
    d = files.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), "text")
    return near_duplicates.pairs(d, F.col("text"), threshold, dismissed=dismissed)


@query(f"{_PAIRS_HALF} {_FOUND_HALF}")
def j3_near_duplicates(spark, sf):
    return near_duplicates.ranked(_near(spark, sf))


@query(f"{_PAIRS} SELECT * FROM ({_PAIRS_FOUND}) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE id_a = c_custkey AND id_b = c_custkey + 1)")
def j2_dismissed_pairs(spark, sf):
    c = files.table(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("id_a"), F.col("c_custkey").alias("id_b"))
    return _near(spark, sf, 0.8, dismissed=c)


@query(f"{_PAIRS_HALF}, f AS ({_FOUND_HALF}) SELECT doc_id AS id, lang AS subject FROM documents WHERE doc_id IN (SELECT id_a FROM f UNION SELECT id_b FROM f)")
def j4_participants(spark, sf):
    d = files.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"))
    return near_duplicates.participants(d, _near(spark, sf))


@query(f"{_PAIRS_HALF} {_FOUND_HALF}")
def j3_near_duplicates_at_half(spark, sf):
    return near_duplicates.ranked(_near(spark, sf, 0.5))


@query(f"{_PAIRS_HALF} SELECT * FROM ({_FOUND_HALF}) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE id_a = c_custkey AND id_b = c_custkey + 1)")
def j2_dismissed_pairs_at_half(spark, sf):
    c = files.table(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("id_a"), F.col("c_custkey").alias("id_b"))
    return _near(spark, sf, 0.5, dismissed=c)


@query(f"{_PAIRS_HALF}, f AS ({_FOUND_HALF}) SELECT doc_id AS id, lang AS subject FROM documents WHERE doc_id IN (SELECT id_a FROM f UNION SELECT id_b FROM f)")
def j4_participants_at_half(spark, sf):
    d = files.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"))
    return near_duplicates.participants(d, _near(spark, sf, 0.5))


def _hit_sql(words) -> str:
    return "(" + " + ".join(f"contains(low, '{w.lower()}')::INTEGER" for w in words) + ")"


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS low, (row_number() OVER (ORDER BY doc_id) - 1) / count(*) OVER ()::DOUBLE AS ratio FROM documents),
h AS (SELECT doc_id, ratio, {_hit_sql(fixed.BIOLOGY_WORDS)} AS b, {_hit_sql(fixed.CHEMISTRY_WORDS)} AS c, {_hit_sql(fixed.PHYSICS_WORDS)} AS p FROM d)
SELECT doc_id, CASE WHEN greatest(b, c, p) = 0 THEN CASE WHEN ratio < 0.33 THEN 'Physics' WHEN ratio < 0.66 THEN 'Chemistry' ELSE 'Biology' END
WHEN b >= c AND b >= p THEN 'Biology' WHEN c >= p THEN 'Chemistry' ELSE 'Physics' END AS subject FROM h""")
def x5_subjects(spark, sf):
    d = files.table(spark, sf, "documents")
    # ids are dense, so a document's position is its id
    return d.crossJoin(d.agg(F.count("*").alias("total"))).select("doc_id", text.subject_of(F.col("text"), F.col("doc_id"), F.col("total")).alias("subject"))


_KEYWORDS = [(1, "English", "the "), (1, "English", "tion"), (1, "English", " of "), (2, "French", "eau"), (2, "French", " le "), (2, "French", "ment"), (3, "German", "sch"), (3, "German", "keit"), (3, "German", " der "), (4, "Spanish", "ción"), (4, "Spanish", " los "), (4, "Spanish", "ado")]


def _keyword_sql() -> str:
    names = list(dict.fromkeys(c for _, c, _ in _KEYWORDS))
    counts = {c: _hit_sql([k for _, x, k in _KEYWORDS if x == c]) for c in names}
    cases = " ".join(f"WHEN {counts[c]} = greatest({', '.join(counts.values())}) THEN '{c}'" for c in names)
    return f"SELECT doc_id AS id, CASE WHEN greatest({', '.join(counts.values())}) = 0 THEN NULL {cases} END AS tagged_chapter FROM (SELECT doc_id, lower(text) AS low FROM documents)"


@query(_keyword_sql())
def x4_keyword_classes(spark, sf):
    table = spark.createDataFrame(_KEYWORDS, "ordinal int, chapter string, keyword string")
    return lookup.keyword_class(files.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), table, "text").select("id", "tagged_chapter")


_REPAIR = "SELECT p_partkey AS id, p_name || CASE WHEN p_size % 5 = 0 THEN '  Ans. [' || p_size % 7 || '] ' ELSE '' END AS option_a, p_type AS option_b, p_brand || CASE WHEN p_size % 2 = 0 THEN ' ans. [2]' ELSE '' END AS option_c, NULL::VARCHAR AS option_d, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'd' END AS correct_answer FROM part"


@query(f"""WITH q AS ({_REPAIR}), m AS (SELECT *, regexp_matches(option_a, '(?i)Ans\\.\\s*\\[\\d\\]') AS ma, regexp_matches(option_c, '(?i)Ans\\.\\s*\\[\\d\\]') AS mc,
regexp_extract(option_a, '(?i)Ans\\.\\s*\\[(\\d)\\]', 1) AS da, regexp_extract(option_c, '(?i)Ans\\.\\s*\\[(\\d)\\]', 1) AS dc FROM q),
l AS (SELECT *, coalesce(CASE WHEN da IN ('1', '2', '3', '4') THEN translate(da, '1234', 'abcd') END, CASE WHEN dc IN ('1', '2', '3', '4') THEN translate(dc, '1234', 'abcd') END) AS letter,
CASE WHEN ma THEN trim(regexp_replace(option_a, '\\s*Ans\\.\\s*\\[\\d\\]', '', 'g')) ELSE option_a END AS na, CASE WHEN mc THEN trim(regexp_replace(option_c, '\\s*Ans\\.\\s*\\[\\d\\]', '', 'g')) ELSE option_c END AS nc FROM m)
SELECT id, na AS option_a, option_b, nc AS option_c, option_d, CASE WHEN coalesce(correct_answer, '') = '' AND letter IS NOT NULL THEN letter ELSE correct_answer END AS correct_answer,
na <> option_a OR nc <> option_c OR (coalesce(correct_answer, '') = '' AND letter IS NOT NULL) AS changed FROM l""")
def x8_x9_repair(spark, sf):
    p = files.table(spark, sf, "part")
    size = F.col("p_size")
    q = p.select(
        F.col("p_partkey").alias("id"),
        F.concat("p_name", F.when(size % 5 == 0, F.concat(F.lit("  Ans. ["), (size % 7).cast("string"), F.lit("] "))).otherwise("")).alias("option_a"),
        F.col("p_type").alias("option_b"),
        F.concat("p_brand", F.when(size % 2 == 0, " ans. [2]").otherwise("")).alias("option_c"),
        F.lit(None).cast("string").alias("option_d"),
        F.when(size % 3 == 0, "").when(size % 3 == 1, "d").alias("correct_answer"),
    )
    return repair.answers_from_options(q)


@query(r"""SELECT page_id, md5(trim(regexp_replace(html, '[ \t\n\r]+', ' ', 'g'))) AS flat_md5, sha256(url) AS key, regexp_replace(url, '[^0-9]', '', 'g') AS digits,
translate(url, '0123456789', '०१२३४५६७८९') AS local, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5,
CASE WHEN length(url) > 30 THEN url[1:30] || '…' ELSE url END AS preview, CASE WHEN contains(url, '.') THEN regexp_extract(url, '[^.]*$') ELSE 'png' END AS ext, right(html, 30) AS tail,
trim(string_split(url || ', x', ',')[1]) AS first_address FROM pages""")
def x11_x22_text_functions(spark, sf):
    p = files.table(spark, sf, "pages")
    url, html = F.col("url"), F.col("html")
    return p.select("page_id", F.md5(F.trim(text.collapse(html))).alias("flat_md5"), text.key_of(url).alias("key"), text.digits(url).alias("digits"), text.local_digits(url).alias("local"), F.md5(text.escape_html(html)).alias("escaped_md5"), text.preview(url, 30).alias("preview"), text.extension(url).alias("ext"), chunk.tail(html, 30).alias("tail"), text.first_address(F.concat(url, F.lit(", x"))).alias("first_address"))


@query("SELECT event_id, (ts + INTERVAL 330 MINUTES)::DATE AS local_date, regexp_matches('+' || (user_id * 12345)::VARCHAR, '^\\+[0-9]{7,}$') AS phone FROM events")
def x13_x15_dates_and_phones(spark, sf):
    e = files.table(spark, sf, "events")
    return e.select("event_id", text.local_date(F.col("ts")).alias("local_date"), text.is_phone(F.concat(F.lit("+"), (F.col("user_id") * 12345).cast("string"))).alias("phone"))


@query(f"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role,
{' OR '.join(f"contains(lower(text), '{w}')" for w in fixed.COMPLEX_WORDS)} OR len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) > {fixed.COMPLEX_LENGTH} AS complex FROM conversations""")
def x18_p10_chat(spark, sf):
    c = files.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", text.chat_role(F.col("role")).alias("role"), text.is_complex(F.col("text")).alias("complex"))


@query("SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'bo') THEN 'Biology' WHEN contains(lower(c_mktsegment), 'ch') THEN 'Chemistry' WHEN contains(lower(c_mktsegment), 'ph') THEN 'Physics' ELSE 'Biology' END AS subject, CASE WHEN starts_with(lower(c_mktsegment), 'le') THEN 12 ELSE 11 END AS class FROM customer")
def x6_x7_file_names(spark, sf):
    c = files.table(spark, sf, "customer")
    return c.select("c_custkey", text.subject_of_file(F.col("c_mktsegment")).alias("subject"), text.class_of_file(F.col("c_mktsegment")).alias("class"))


# --- joins --------------------------------------------------------------------------------------


@query(f"WITH {BANK}, sets AS (SELECT o_custkey AS test_number, list(o_orderkey) AS ids FROM orders GROUP BY 1) SELECT test_number, id, subject FROM (SELECT test_number, unnest(ids) AS id FROM sets) JOIN bank USING (id) WHERE is_active")
def j1_set_members(spark, sf):
    sets = files.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("test_number")).agg(F.collect_list("o_orderkey").alias("question_ids"))
    return lookup.members(sets, bank(spark, sf)).select("test_number", "id", "subject")


_IMAGES = "images AS (SELECT DISTINCT l_orderkey AS page, l_suppkey AS xref FROM lineitem)"


@query(f"WITH {_IMAGES}, r AS (SELECT xref FROM images GROUP BY 1 HAVING count(DISTINCT page) > 560) SELECT page, xref FROM images WHERE xref NOT IN (SELECT xref FROM r)")
def j5_anti_join(spark, sf):
    images = files.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("xref")).distinct()
    return images.join(lookup.recurring(images).where("pages > 560"), "xref", "left_anti").select("page", "xref")


@query("SELECT l_suppkey AS xref, count(DISTINCT l_orderkey) AS pages FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def a11_recurring_images(spark, sf):
    return lookup.recurring(files.table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey").withColumnRenamed("l_suppkey", "xref")


@query("SELECT c_custkey, c_mktsegment AS key, coalesce(CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'घर' WHEN 'MACHINERY' THEN 'मशीन' END, c_mktsegment) AS shown FROM customer")
def j7_dictionary(spark, sf):
    words = spark.createDataFrame([("HOUSEHOLD", "घर"), ("MACHINERY", "मशीन")], "key string, text string")
    return lookup.translate(files.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("key")), words, "key", "shown")


@query("SELECT p_partkey AS id, CASE WHEN p_name LIKE '%ring%' THEN 'Rings' WHEN p_name LIKE '%red%' THEN 'Red' WHEN p_name LIKE '%bolt%' THEN 'Bolts' END AS chapter, CASE WHEN p_name LIKE '%ring%' THEN 11 WHEN p_name LIKE '%red%' THEN 12 WHEN p_name LIKE '%bolt%' THEN 11 END AS class FROM part")
def j8_first_fragment(spark, sf):
    fragments = spark.createDataFrame([(1, "ring", "Rings", 11), (2, "RED", "Red", 12), (3, "Bolt", "Bolts", 11)], "ordinal int, fragment string, chapter string, class int")
    p = files.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return lookup.first_fragment(p, fragments, F.col("p_name")).select("id", "chapter", "class")


# --- samples, vectors ---------------------------------------------------------------------------

_KEY = "md5({} || ':' || id::VARCHAR)"


@query(f"""WITH {BANK} """ + " UNION ALL ".join(f"SELECT * FROM (SELECT id, subject FROM (SELECT * FROM bank WHERE subject = '{s}' ORDER BY id LIMIT 200) ORDER BY {_KEY.format(repr('0'))}, id LIMIT {n})" for s, n in (("en", 90), ("de", 45), ("fr", 45))))
def t8_stratified_sample(spark, sf):
    return sample.stratified(bank(spark, sf), {"en": 90, "de": 45, "fr": 45}).select("id", "subject")


@query(f"WITH {BANK} SELECT id FROM bank WHERE (subject = 'en' AND chapter IN (' src1', ' src4')) OR subject = 'es' ORDER BY {_KEY.format(repr('7'))}, id LIMIT 60")
def t9_pooled_sample(spark, sf):
    b = bank(spark, sf).withColumn("chapter", F.trim("chapter"))
    return sample.pooled(b, [("en", ["src1", "src4 "]), ("es", [])], 60, "7").select("id")


@query(f"""WITH {BANK}, k AS (SELECT subject, t AS test_number, id, row_number() OVER (PARTITION BY subject, t ORDER BY md5('set:' || t || ':' || id), id) AS rn FROM bank, range(1, 7) r(t))
SELECT subject, test_number::INTEGER AS test_number, array_to_string(list(id ORDER BY rn), ',') AS ids, count(*) AS question_count FROM k WHERE rn <= 45 GROUP BY 1, 2 HAVING count(*) = 45""")
def t10_test_sets(spark, sf):
    return sample.test_sets(bank(spark, sf)).select("subject", "test_number", F.array_join("question_ids", ",").alias("ids"), "question_count")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q)
SELECT vec_id, similarity FROM s WHERE similarity > 0.4 ORDER BY similarity DESC, vec_id LIMIT 5""")
def t7_vector_top_k(spark, sf):
    e = files.table(spark, sf, "embeddings")
    vector_0 = e.where("vec_id = 0").select("embedding").first()[0]
    return vector.top_k(e, vector_0, 5, 0.4, id="vec_id").select("vec_id", "similarity")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q),
t AS (SELECT * FROM s WHERE similarity > 0.3 ORDER BY similarity DESC, vec_id LIMIT 3) SELECT string_agg(label || ' ' || vec_id, E'\\n\\n' ORDER BY similarity DESC, label || ' ' || vec_id) AS context FROM t""")
def p9_context(spark, sf):
    e = files.table(spark, sf, "embeddings")
    vector_0 = e.where("vec_id = 0").select("embedding").first()[0]
    return vector.context(vector.top_k(e, vector_0, 3, 0.3, id="vec_id"), "label", "vec_id")


# --- chunks -------------------------------------------------------------------------------------


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents),
c AS (SELECT doc_id, i // 500 AS chunk, array_to_string(w[i + 1:i + 500], ' ') AS content FROM (SELECT doc_id, w, unnest(range(0, len(w), 500)) AS i FROM w))
SELECT doc_id, chunk::INTEGER AS chunk, md5(content) AS content_md5 FROM c WHERE length(content) > 100""")
def u1_word_chunks(spark, sf):
    d = files.table(spark, sf, "documents").select("doc_id", "text")
    return chunk.word_chunks(d, at_least=100).select("doc_id", "chunk", F.md5("content").alias("content_md5"))


@query("SELECT doc_id, (i // 5500)::INTEGER AS window, md5(substr(text, i + 1, 6000)) AS content_md5 FROM (SELECT doc_id, text, unnest(range(0, length(text), 5500)) AS i FROM documents WHERE length(text) > 0)")
def u2_char_windows(spark, sf):
    d = files.table(spark, sf, "documents").select("doc_id", "text")
    return chunk.char_windows(d).select("doc_id", "window", F.md5("content").alias("content_md5"))


@query("SELECT min(doc_id) AS id FROM documents GROUP BY substr(coalesce(text, ''), 1, 50)")
def a14_first_of_prefix(spark, sf):
    return chunk.first_of_prefix(files.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"))).select("id")


# --- changes ------------------------------------------------------------------------------------



@query(f"""SELECT user_id, CASE WHEN o.n IS NULL THEN 'free' ELSE 'pro' END AS plan, coalesce(o.n, 1)::BIGINT AS updated_at
FROM (SELECT c_custkey AS user_id FROM customer UNION SELECT o_custkey FROM orders) LEFT JOIN (SELECT o_custkey AS user_id, max(o_orderkey) + 1 AS n FROM orders GROUP BY 1) o USING (user_id)""")
def k4_upsert(spark, sf):
    old = files.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("free").alias("plan"), F.lit(1).cast("long").alias("updated_at"))
    new = files.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.lit("pro").alias("plan"), (F.col("o_orderkey") + 1).alias("updated_at"))
    return merge.upsert(old, new, ["user_id"], "updated_at")


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS id_a, greatest(l_partkey, l_suppkey) AS id_b FROM lineitem")
def k6_canonical_pairs(spark, sf):
    return near_duplicates.canonical_pairs(files.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id_a"), F.col("l_suppkey").alias("id_b")))


@query(f"""WITH {BANK} SELECT b.id, coalesce(l.chapter, b.chapter) AS chapter, CASE WHEN l.id IS NOT NULL THEN NULL ELSE b.diagram_url END AS diagram_url FROM bank b
LEFT JOIN (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'patched' END AS chapter FROM labels) l USING (id)""")
def k7_patch(spark, sf):
    changes = files.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "patched").alias("chapter"), F.lit(None).cast("string").alias("diagram_url"), F.lit(True).alias("set_diagram_url"))
    return merge.patch(bank(spark, sf).select("id", "chapter", "diagram_url"), changes, nullable=["diagram_url"])


@query(f"WITH {BANK} SELECT id, CASE WHEN id IN (SELECT doc_id FROM labels) THEN 'bulk' ELSE chapter END AS chapter, is_active AND id NOT IN (SELECT doc_id FROM labels) AS is_active FROM bank")
def k8_bulk_update(spark, sf):
    ids = files.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return merge.bulk_update(bank(spark, sf).select("id", "chapter", "is_active"), ids, {"chapter": F.lit("bulk"), "is_active": F.lit(False)})


@query("SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def k9_delete(spark, sf):
    d = files.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return merge.delete(d, files.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))


@query(f"WITH {BANK} SELECT id, coalesce(correct_answer, subject) AS correct_answer FROM bank")
def k10_backfill(spark, sf):
    b = bank(spark, sf).select("id", "subject", "correct_answer")
    return merge.backfill(b, "correct_answer", lambda rows: rows.select("id", F.col("subject").alias("correct_answer"))).select("id", "correct_answer")


@query(f"WITH {RESULTS}, {_USAGE} SELECT * FROM usage")
def k11_usage_counter(spark, sf):
    return profile.daily_usage(results(spark, sf), "user_id", "created_at", "k")


@query("SELECT conv_id, turn, sha256('en:' || lower(trim(text))) AS question_hash, CASE WHEN role = 'user' THEN turn END AS answer FROM conversations")
def k13_read_through_cache(spark, sf):
    c = files.table(spark, sf, "conversations")
    key = lambda t: merge.answer_key(F.lit("en"), t)
    cache = c.where("role = 'user'").groupBy(key(F.col("text")).alias("question_hash"), "conv_id", "turn").agg(F.max("turn").alias("answer"))
    own = c.select("conv_id", "turn", "text").join(cache.drop("question_hash"), ["conv_id", "turn"], "left")
    return own.select("conv_id", "turn", key(F.col("text")).alias("question_hash"), "answer")


@query("""WITH c AS (SELECT conv_id, turn, role, sha256('en:' || lower(trim(text))) AS question_hash FROM conversations),
cache AS (SELECT question_hash, max(turn) AS answer FROM c WHERE role = 'user' GROUP BY 1)
SELECT conv_id, turn, question_hash, answer FROM c LEFT JOIN cache USING (question_hash)""")
def k13_answer_lookup(spark, sf):
    c = files.table(spark, sf, "conversations")
    key = lambda t: merge.answer_key(F.lit("en"), t)
    cache = c.where("role = 'user'").groupBy(key(F.col("text")).alias("question_hash")).agg(F.max("turn").alias("answer"))
    hits, _ = merge.cached(c.select("conv_id", "turn", "text"), cache, "text", "answer", key)
    return hits.select("conv_id", "turn", "question_hash", "answer")


@query(f"""WITH {RESULTS}, {_USAGE}, moves AS (SELECT s_suppkey AS guest, s_suppkey + 1000 AS "user" FROM supplier),
a AS (SELECT user_id AS key, usage_date, CASE WHEN guest IS NULL THEN tokens_used ELSE 0 END AS tokens_used FROM usage LEFT JOIN moves ON user_id = guest
UNION ALL SELECT "user", usage_date, tokens_used FROM usage JOIN moves ON user_id = guest) SELECT key, usage_date, sum(tokens_used)::BIGINT AS tokens_used FROM a GROUP BY 1, 2""")
def k14_transfer(spark, sf):
    usage = profile.daily_usage(results(spark, sf), "user_id", "created_at", "k").withColumnRenamed("user_id", "key")
    moves = files.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("guest"), (F.col("s_suppkey") + 1000).alias("user"))
    return merge.transfer(usage, moves)


@query("SELECT doc_id AS id, lang AS subject, true AS is_active, NULL::VARCHAR AS diagram_url FROM documents UNION ALL SELECT item_id + 1000000, 'bench', true, NULL FROM benchmark")
def k1_bulk_insert(spark, sf):
    d = files.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.lit(True).alias("is_active"), F.lit(None).cast("string").alias("diagram_url"))
    new = files.table(spark, sf, "benchmark").select((F.col("item_id") + 1000000).alias("id"), F.lit("bench").alias("subject"), F.lit("").alias("diagram_url"))
    return merge.insert(d, new, optional=["diagram_url"])


@query(f"""WITH {BANK} SELECT id, CASE WHEN length(question) > 90 THEN question[1:90] || '…' ELSE question END AS preview, substr(question, 1, 500) AS prefix,
coalesce(correct_answer, '') <> '' OR coalesce(diagram_url, '') <> '' AS shown, coalesce(lower(trim(correct_answer)) = 'a', false) AS correct,
array_to_string(list_filter([nullif(subject, ''), nullif(chapter, ''), nullif(correct_answer, '')], lambda x: x IS NOT NULL), ' ') AS joined FROM bank""")
def p4_p11_x3_projections(spark, sf):
    b, c = bank(spark, sf), F.col
    shown = text.option_shown(c("correct_answer"), c("diagram_url"))
    return b.select("id", text.preview(c("question")).alias("preview"), F.substring("question", 1, 500).alias("prefix"), shown.alias("shown"), text.is_correct_option("a", c("correct_answer")).alias("correct"), text.joined(c("subject"), c("chapter"), c("correct_answer")).alias("joined"))


@query("SELECT l_orderkey AS page, coalesce(min(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0)::DOUBLE AS begin FROM lineitem GROUP BY 1")
def a12_first_positions(spark, sf):
    return files.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.coalesce(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(0.0)).alias("begin"))


@query("""WITH d AS (SELECT l_orderkey AS page, min(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS begin FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber FROM lineitem JOIN d ON page = l_orderkey WHERE l_quantity >= coalesce(begin, 0)""")
def j6_range_condition(spark, sf):
    li = files.table(spark, sf, "lineitem")
    begin = li.groupBy("l_orderkey").agg(F.coalesce(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(0.0)).alias("begin"))
    return li.join(begin, "l_orderkey").where("l_quantity >= begin").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderstatus AS subject, o_custkey AS test_number, max(o_orderkey) AS version FROM orders GROUP BY 1, 2")
def k5_upsert_sets(spark, sf):
    o = files.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("subject"), F.col("o_custkey").alias("test_number"), F.col("o_orderkey").alias("version"))
    return merge.upsert(o.where("false"), o, ["subject", "test_number"], "version")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM benchmark) AS items")
def j10_independent_reads(spark, sf):
    return files.table(spark, sf, "documents").agg(F.count("*").alias("documents")).crossJoin(files.table(spark, sf, "benchmark").agg(F.count("*").alias("items")))


@query(f"WITH {BANK} SELECT count(*) AS available, least(count(*), 45) AS returned FROM bank WHERE subject = 'fr'")
def t9_available(spark, sf):
    return sample.available(bank(spark, sf).where("subject = 'fr'"), 45)


@query(f"WITH {BANK} SELECT count(*) FILTER (subject <> '' AND is_active) AS success, count(*) FILTER (NOT (subject <> '' AND is_active)) AS failed FROM bank")
def k2_insert_counts(spark, sf):
    from ..sources import sinks

    return sinks.split_status(bank(spark, sf), (F.col("subject") != "") & F.col("is_active"))[1]


@query("SELECT event_id, regexp_replace(props, '[^0-9]', '', 'g') AS digits, replace(replace(props, '{', ''), '}', '') AS flat, value > 0 AND value <= 720 AS valid FROM events")
def x16_x20_cleanup(spark, sf):
    e = files.table(spark, sf, "events")
    return e.select("event_id", text.digits(F.col("props")).alias("digits"), F.translate("props", "{}", "").alias("flat"), scoring.valid(F.col("value")).alias("valid"))


# --- payloads, papers, state: no SQL form, tested on fixtures -----------------------------------


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars IS NOT NULL")
def s12_json_rows(spark, sf):
    d = files.table(spark, sf, "documents")
    made = d.select("doc_id", F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct("lang", "n_chars"))), F.lit("\n```")).alias("out"))
    return files.json_rows(made, "out", "lang string, n_chars bigint")


@query("SELECT page_id, octet_length(encode(html)) AS bytes, sha256(html) AS digest FROM pages")
def s11_base64(spark, sf):
    p = files.table(spark, sf, "pages").select("page_id", files.payload(F.base64(F.col("html").cast("binary"))).alias("b"))
    return p.select("page_id", F.octet_length("b").cast("long").alias("bytes"), F.sha2("b", 256).alias("digest"))


def _papers(spark, sf):
    """Documents as exam papers: sentences become numbered questions with options and answers."""
    d = files.table(spark, sf, "documents")
    lines = F.filter(F.split("text", r"\.\s+"), lambda s: F.length(s) > 0)
    asked = F.transform(lines, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), F.regexp_replace(s, r"\s+", " "), F.lit("\n(1) one\n(2) two\n(3) three\n(4) four\nAns. ("), (i % 4 + 1).cast("string"), F.lit(")")))
    return d.select(F.col("doc_id").alias("id"), F.lit(2020).alias("year"), F.lit("standard").alias("format"), F.concat(F.lit("\n"), F.array_join(asked, "\n")).alias("text"))


@query()
def u4_parse_papers(spark, sf):
    return parse.questions(_papers(spark, sf)).select("id", "position", "number", "question", "option_a", "correct_answer", "subject")


@query()
def u9_match_lists(spark, sf):
    d = files.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Match List I with List II. List I List II (A) "), F.col("text"), F.lit(" (I) x (B) y (II) z Choose the answer")).alias("question"))
    return parse.split_lists(d).select("doc_id", "lists.preamble", F.array_join("lists.items_1", "|").alias("items_1"), F.array_join("lists.items_2", "|").alias("items_2"), "lists.trailer")


@query()
def u10_statements(spark, sf):
    d = files.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Given: Assertion (A): "), F.col("text"), F.lit(" Reason (R): so. Choose one")).alias("question"))
    return parse.split_statements(d).select("doc_id", "statements.intro", F.array_join("statements.parts", "|").alias("parts"), "statements.trailer")


@query()
def u11_safe_boundary(spark, sf):
    return parse.with_boundary(files.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "boundary")


@query()
def u12_extract_pages(spark, sf):
    pages = files.table(spark, sf, "pages").select(F.col("page_id").alias("doc"), F.lit(1).alias("page"), F.col("html").alias("text"))
    out = external.extract_pages(pages, external.stub_embedding(4), "embedding array<double>")
    return out.select("doc", "page", "failed", F.size("embedding").alias("size"))


@query("""WITH b AS (SELECT l_orderkey AS page, l_linenumber AS ord, l_quantity AS y0, l_returnflag = 'R' AS image, l_linenumber || '. q' AS line, l_partkey * 10 + l_suppkey % 10 AS xref FROM lineitem),
t AS (SELECT xref FROM b WHERE image GROUP BY 1 HAVING count(DISTINCT page) > 1),
s AS (SELECT page, coalesce(min(CASE WHEN NOT image THEN y0 END), 0) AS begin FROM b GROUP BY 1),
e AS (SELECT page, y0, ord, line FROM b WHERE NOT image UNION ALL SELECT page, y0, ord, '<<<DIAGRAM_HERE>>>' FROM b JOIN s USING (page) WHERE image AND y0 >= begin AND xref NOT IN (SELECT xref FROM t))
SELECT 1 AS doc, page, string_agg(line, E'\\n' ORDER BY y0, ord, line) AS text FROM e GROUP BY page""")
def a13_reading_order(spark, sf):
    li = files.table(spark, sf, "lineitem")
    blocks = li.select(F.lit(1).alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("y0"), F.when(F.col("l_returnflag") == "R", "image").otherwise("text").alias("kind"), F.concat(F.col("l_linenumber").cast("string"), F.lit(". q")).alias("text"), (F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("xref"))
    return layout.pages(blocks)


_CALLS = "calls AS (SELECT event_id AS id, user_id, event_type, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS i FROM events)"


def _limit_sql(keys: tuple[str, ...], names: tuple[str, ...], most: int, seconds: int) -> str:
    """A recursion from call to call of all keys at once; the state is the list of admitted times."""
    own, renamed = ", ".join(keys), ", ".join(f"{k} AS {n}" for k, n in zip(keys, names))
    return f"""WITH RECURSIVE {_CALLS.format(keys=own)},
w AS (SELECT id, {own}, i, true AS admitted, [t] AS recent FROM calls WHERE i = 1
UNION ALL SELECT id, {own}, i, len(kept) < {most}, CASE WHEN len(kept) < {most} THEN list_append(kept, t) ELSE kept END
  FROM (SELECT calls.*, list_filter(w.recent, lambda x: calls.t - x < {seconds * 1_000_000}) AS kept FROM w JOIN calls USING ({own}) WHERE calls.i = w.i + 1))
SELECT id, {renamed}, admitted FROM w"""


_LOCK_SQL = f"""WITH RECURSIVE {_CALLS.format(keys='user_id')}, start AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::VARCHAR AS outcome, 0 AS failures, 0::BIGINT AS until FROM calls),
w AS (SELECT user_id, i, id, outcome, failures, until FROM start
UNION ALL SELECT user_id, i, id, outcome, CASE WHEN outcome = 'blocked' THEN failures WHEN outcome = 'ok' OR failures + 1 >= 2 THEN 0 ELSE failures + 1 END,
  CASE WHEN outcome = 'blocked' THEN until WHEN outcome = 'ok' THEN 0 WHEN failures + 1 >= 2 THEN t + 86400000000 ELSE until END
  FROM (SELECT user_id, calls.i, calls.id, calls.t, failures, until, CASE WHEN until > t THEN 'blocked' WHEN event_type <> 'error' THEN 'ok' ELSE 'failed' END AS outcome FROM w JOIN calls USING (user_id) WHERE calls.i = w.i + 1))
SELECT w.id, user_id AS address, event_type <> 'error' AS ok, outcome FROM w JOIN calls USING (user_id, i) WHERE w.i > 0"""


@query(_limit_sql(("user_id", "event_type"), ("address", "path"), 2, 86400))
def g1_rate_limit(spark, sf):
    e = files.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("address"), F.col("event_type").alias("path"), "ts")
    return limits.rate_limited(e, 2, 86400.0).drop("ts")


@query(_limit_sql(("user_id",), ("phone",), 3, 86400))
def g2_phone_limit(spark, sf):
    e = files.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("phone"), "ts")
    return limits.rate_limited(e, 3, 86400.0, keys=("phone",)).drop("ts")


@query(_LOCK_SQL)
def g3_lockout(spark, sf):
    e = files.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("address"), "ts", (F.col("event_type") != "error").alias("ok"))
    return limits.lockouts(e, attempts=2, block=86400.0).drop("ts")
