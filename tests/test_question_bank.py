"""Question-bank operators on rows made by hand."""

import base64
import datetime as dt
import inspect

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import scoring, text
from lexiquarry.operators import chunk, external, latest, layout, lookup, merge, near_duplicates, parse, pivots, profile, repair, sample, search, substring_index, vector
from lexiquarry.plans import branches, queries
from lexiquarry.sources import files, paged, sinks, stored
from lexiquarry.streaming import limits


def values(spark, fn, *items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_blank_and_profiles(spark):
    rows = [(1, None, None), (2, "", ""), (3, "  ", "EMPTY"), (4, " X ", "a"), (5, "X", " ")]
    df = spark.createDataFrame([(i, "s", c, a, True) for i, c, a in rows], "id int, subject string, chapter string, correct_answer string, is_active boolean")
    assert profile.gaps(df).first() == (5, 2, 2)
    assert profile.presence(df, "chapter", "correct_answer").first() == (3, 3)
    assert [tuple(r) for r in profile.counts(df, "chapter").collect()] == [("X", 2)]
    assert [r[0] for r in profile.distinct_values(df, "chapter").collect()] == ["X"]
    assert {tuple(r) for r in profile.histogram(df, "chapter").collect()} == {("", 3), ("X", 2)}


def test_upload_history(spark):
    rows = [("f", "B", 3), ("f", "A", 1), ("f", None, 2), (None, "A", 9), ("", "A", 9), ("g", " ", 5)]
    df = spark.createDataFrame(rows, "source_pdf_filename string, subject string, created_at int")
    assert [tuple(r) for r in profile.upload_history(df).collect()] == [("g", "", 1, 5, 5), ("f", "A,B", 3, 1, 3)]


@pytest.mark.parametrize(("needle", "found"), [("50%", [1]), ("_x", [1, 2]), ('"q"', [2]), ("a,b", [3]), ("(z", [3]), ("ÜN", [3]), ("\\", [2])])
def test_search_needles(spark, needle, found):
    rows = [(1, "rate 50% ax", ""), (2, "nothing", 'say "q" \\ bx'), (3, "A,B (z ün", None)]
    df = spark.createDataFrame(rows, "id int, question string, option_a string")
    assert [r.id for r in search.page(df, search.SearchSpec(text=needle)).collect()] == found


def test_search_pages_and_order(spark):
    df = spark.createDataFrame([(i, "S", None if i == 3 else i % 2) for i in range(7)], "id int, subject string, year int")
    spec = search.SearchSpec(sort="year", direction="desc", page_size=3, subject="S")
    assert [r.id for r in search.page(df, spec).collect()] == [3, 1, 5]
    assert [r.id for r in search.page(df, search.SearchSpec(sort="nonsense", page=3, page_size=3)).collect()] == [6]
    assert search.total(df, spec).first() == (7, 3)
    assert search.total(df.where("false"), spec).first() == (0, 1)
    with pytest.raises(ValueError):
        search.checked_subject("x", ["S"])


def test_latest(spark):
    rows = [(u, i, u * 10 + s, "abcab"[i % 5], i) for u, n in ((1, 1), (2, 5), (3, 6)) for i, s in enumerate([5, 0, 3, 8, 1, 9][:n])]
    df = spark.createDataFrame(rows, "user_id int, id int, score int, chapter string, created_at int")
    assert {r.user_id: (r.tests, r.mean) for r in latest.recent_mean(df).collect()} == {1: (1, "15"), 2: (5, "23"), 3: (5, "34")}
    weak = {(r.user_id, r.place): (r.chapter, r["count"]) for r in latest.weak_topics(df).collect()}
    assert weak[2, 1] == ("b", 2) and weak[2, 2] == ("a", 2) and weak[3, 1] == ("a", 3)
    board = {r.user_id: tuple(r)[1:] for r in profile.scoreboard(df).collect()}
    assert board[1] == (1, 15, 15, 0) and board[3] == (6, 39, 34, 4)
    trend = latest.trend(df).where("user_id = 3").orderBy("index").collect()
    assert [r.id for r in trend] == list(range(6)) and trend[0].point.x == 0 and trend[5].point.x == 100
    assert not latest.trend(df).where("user_id = 1").count()


def test_tokens_and_pairs(spark):
    base = "alpha beta gamma delta"
    rows = [(1, "p", base), (2, "p", base.upper() + " the of"), (3, "p", "alpha beta other"), (4, "q", base), (5, "p", "the which"), (6, "p", "वनस्पति"), (7, "p", None)]
    df = spark.createDataFrame(rows, "id int, subject string, t string")
    got = {(r.id_a, r.id_b): (r.overlap, r.exact) for r in near_duplicates.pairs(df, F.col("t"), 0.4).collect()}
    assert got == {(1, 2): (1.0, True), (1, 3): (0.4, False), (2, 3): (0.4, False)}
    gone = spark.createDataFrame([(2, 1)], "id_a int, id_b int")
    assert {(r.id_a, r.id_b) for r in near_duplicates.pairs(df, F.col("t"), 0.41, dismissed=gone).collect()} == set()


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_pairs_lose_nothing(spark, threshold):
    import random

    rng = random.Random(3)
    rows = [(i, "g" if i % 3 else "h", " ".join(f"t{rng.randrange(14)}" for _ in range(rng.randrange(1, 12)))) for i in range(120)]
    want = set()
    for i, g, a in rows:
        for j, h, b in rows:
            x, y = set(a.split()), set(b.split())
            if i < j and g == h and len(x & y) / len(x | y) >= threshold:
                want.add((i, j))
    df = spark.createDataFrame(rows, "id int, subject string, t string").repartition(3)
    got = [(r.id_a, r.id_b) for r in near_duplicates.pairs(df, F.col("t"), threshold).collect()]
    assert set(got) == want and len(got) == len(want)


def test_answers(spark):
    assert values(spark, text.normal_answer, "1", " B ", "d", None) == ["a", "b", "d", None]
    assert values(spark, text.embedded_answer, "x Ans. [3]", "ans.[9] y", "none", None) == ["c", None, None, None]
    assert values(spark, text.without_answer, "x Ans. [3] ", "Ans.[9] y", " kept ") == ["x", "y", " kept "]
    rows = [(1, "p Ans. [2]", "q", "r Ans. [4]", None, ""), (2, "p Ans. [2]", "q", "r", "s", "d"), (3, "p", "q", "r", "s", None)]
    df = spark.createDataFrame(rows, "id int, option_a string, option_b string, option_c string, option_d string, correct_answer string")
    got = {r.id: (r.option_a, r.correct_answer, r.changed) for r in repair.answers_from_options(df).collect()}
    assert got == {1: ("p", "b", True), 2: ("p", "d", True), 3: ("p", None, False)}


def test_classifiers(spark):
    table = spark.createDataFrame([(1, "One", "Cell"), (1, "One", "wall"), (2, "Two", "root"), (2, "Two", "leaf")], "ordinal int, chapter string, keyword string")
    df = spark.createDataFrame([(1, "a CELL and a root"), (2, "uprooted leaf"), (3, "nothing"), (4, None)], "id int, question string")
    assert {r.id: r.tagged_chapter for r in lookup.keyword_class(df, table).collect()} == {1: "One", 2: "Two", 3: None, 4: None}
    d = spark.createDataFrame([(0, "blood and acid"), (1, "zz"), (2, "zz"), (3, "acid force")], "i int, x string")
    got = [r.y for r in d.select("i", text.subject_of(F.col("x"), F.col("i"), F.lit(4)).alias("y")).orderBy("i").collect()]
    assert got == ["Biology", "Physics", "Chemistry", "Chemistry"]
    assert values(spark, text.subject_of_file, "kebo1", "lech2", "keph3", "x") == ["Biology", "Chemistry", "Physics", "Biology"]
    assert values(spark, text.class_of_file, "lebo", "kebo", "x") == [12, 11, 11]


def test_scores(spark):
    assert [tuple(x) for x in values(spark, lambda c: scoring.chances(c, F.lit("general")), 300, 450, 549, 550, 620, kind="int")] == [("low", "unlikely"), ("moderate", "unlikely"), ("moderate", "unlikely"), ("high", "possible"), ("high", "likely")]
    assert [x[0] for x in values(spark, lambda c: scoring.chances(c, F.lit("sc")), 349, 350, 399, 400, 620, kind="int")] == ["low", "check-cutoff", "check-cutoff", "possible", "possible"]
    assert values(spark, scoring.half_up, -2.5, 2.5, 2.4, kind="double") == [-2, 3, 2]
    assert values(spark, scoring.valid, 0, 1, 720, 721, kind="int") == [False, True, True, False]
    assert [x.rank_from for x in values(spark, scoring.rank_band, 720, 680, 679, 300, 299, kind="int")] == [1, 1, 51, 510001, 700001]
    assert values(spark, scoring.duration, 59, 3599, 3600, 7325, kind="int") == ["0m 59s", "59m 59s", "1h 0m", "2h 2m"]


def test_dates_and_small_functions(spark):
    times = [dt.datetime(2024, 5, 1, 18, 29, 59), dt.datetime(2024, 5, 1, 18, 30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp_ntz")
    assert [r[0] for r in df.orderBy("i").select(text.local_date(F.col("t"))).collect()] == [dt.date(2024, 5, 1), dt.date(2024, 5, 2)]
    assert values(spark, text.is_phone, "+1234567", "+123456", "12345678", "+12a45678") == [True, False, False, False]
    assert values(spark, text.first_address, " 1.2.3.4 , 5", "x") == ["1.2.3.4", "x"]
    assert values(spark, text.collapse, "a \n b") == ["a b"]
    assert values(spark, text.garbled, "x" * 39, "x" * 40, "x" * 12 + "." * 28, "x" * 11 + "." * 29, None) == [True, False, False, True, True]
    assert values(spark, text.without_fences, '```json\n[1]\n```', "[2]") == ["[1]", "[2]"]
    assert values(spark, text.escape_html, "<a & b>", None) == ["&lt;a &amp; b&gt;", ""]
    assert values(spark, text.without_noise, "q\nPage 3 of 9\nwww.x.y z\nSPACE FOR ROUGH WORK ...\nend") == ["q\n z\nend"]
    assert values(spark, text.is_complex, "Explain it", "what", " ".join("abcdefghijklm")) == [True, False, True]
    assert values(spark, text.local_digits, "a12") == ["a१२"]
    assert values(spark, text.preview, "x" * 91, "x" * 90) == ["x" * 90 + "…", "x" * 90]


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (499, [499]), (500, [500]), (501, [500, 1])])
def test_word_chunks(spark, n, sizes):
    df = spark.createDataFrame([(1, " ".join(["w"] * n))], "id int, text string")
    assert [len(r.content.split(" ")) for r in chunk.word_chunks(df).orderBy("chunk").collect()] == sizes


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (5500, [5500]), (5501, [5501, 1]), (6000, [6000, 500]), (6001, [6000, 501])])
def test_char_windows(spark, n, sizes):
    df = spark.createDataFrame([(1, "é" * n)], "id int, text string")
    assert [len(r.content) for r in chunk.char_windows(df).orderBy("window").collect()] == sizes


STANDARD = """Intro
1. What is the name of the largest organ?
(1) skin
(2) liver
is big
Ans. (1)
2. Too short?
(1) x
Ans. 2
201. A number that is beyond the range of them
(1) x
3. Which of these letters is the one without options
and goes on?
a. first
B. second
Ans. [c]
4. This one has neither an option nor an answer
"""


def papers(spark, text, fmt, compat=False):
    df = spark.createDataFrame([(1, 2020, fmt, text)], "id int, year int, format string, text string")
    columns = ["number", "question", "option_a", "option_b", "option_c", "option_d", "correct_answer"]
    return [tuple(r) for r in parse.questions(df, compat).orderBy("position").select(*columns).collect()]


def test_standard_papers(spark):
    got = papers(spark, STANDARD, "standard")
    assert got == [
        (1, "What is the name of the largest organ?", "skin", "liver is big", "", "", "1"),
        (3, "Which of these letters is the one without options and goes on?", "first", "second", "", "", "c"),
    ]


def test_other_papers(spark):
    sol = "\n\n1. The transcription of genes means a lot\nwhat is it?\n(1) x\n(2) y\nAnswer: (2)\nSol. because\n\n2. Another question that is long enough\n"
    assert [q[1:] for q in papers(spark, sol, "sol")] == [("The transcription of genes means a lot what is it?", "x", "y", "", "", "2"), ("Another question that is long enough", "", "", "", "", "")]
    assert papers(spark, sol, "sol", compat=True)[0][1] != "The transcription of genes means a lot what is it?"
    q = "\nQ.1 What is shown by the picture above?\n(1) a cat\n(3) a dog\nAns. [3]\nSol. x\nQ.2 short\n"
    assert papers(spark, q, "q_format") == [(1, "What is shown by the picture above?", "a cat", "", "a dog", "", "c")]
    inline = "\n1. Which word is it, and what does it\nAns: B\ntell the reader?\na. one\nb. two\nmore\nb.x\n2. No options in this long question here\n"
    assert papers(spark, inline, "abcd_inline") == [(1, "Which word is it, and what does it tell the reader?", "one", "two more", "", "", "b")]
    assert papers(spark, None, "standard") == [] == papers(spark, "", "sol")


def test_numbers_beyond_all_ranges(spark):
    text = "{}. This is a question of some length\n(1) x"
    assert [q[0] for n in ("99999999999", "9" * 30) for q in papers(spark, text.format(n), "sol")] == [99999999999, None]
    assert papers(spark, text.format(0), "standard") == papers(spark, text.format(201), "abcd_inline") == papers(spark, text.format("9" * 30), "standard") == []
    assert len(papers(spark, text.format(200), "standard")) == 1


def test_papers_with_odd_white_space_and_a_very_long_question(spark):
    long = "1. \u2003How\u00a0long is this?\r\n" + "and so on\n" * 5000 + "\u00a0(1)\u2003one\u00a0\n\x0bgoes on\n"
    ((n, question, a, *_),) = papers(spark, long, "standard")
    assert n == 1 and question == "How long is this?" + " and so on" * 5000 and a == "one goes on"


def test_parsing_needs_no_python(spark):
    df = spark.createDataFrame([(1, 2020, "sol", "x")], "id int, year int, format string, text string")
    for out in (parse.questions(df), parse.split_lists(df, "text"), parse.split_statements(df, "text"), parse.with_boundary(df)):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_questions_get_subjects(spark):
    df = spark.createDataFrame([(1, 2020, "standard", STANDARD), (2, 2021, "odd", None)], "id int, year int, format string, text string")
    got = parse.questions(df).orderBy("position").collect()
    assert [(r.position, r.total, r.subject) for r in got] == [(0, 2, "Biology"), (1, 2, "Chemistry")]


def lists(spark, text):
    got = parse.split_lists(spark.createDataFrame([(text, 1)], "question string, n int")).first().lists.asDict()
    return got if any(v is not None for v in got.values()) else None


def parts_of(spark, text):
    got = parse.split_statements(spark.createDataFrame([(text, 1)], "question string, n int")).first().statements.asDict()
    return got if any(v is not None for v in got.values()) else None


def test_list_questions(spark):
    both = "Match List I with List II. List-I List-II (A) M phase (I) Proteins (B) G2 (II) Rest; List-II: Choose the correct answer"
    assert lists(spark, both) == {"preamble": "Match List I with List II.", "items_1": ["(A) M phase", "(B) G2"], "items_2": ["(I) Proteins", "(II) Rest"], "trailer": "Choose the correct answer"}
    assert lists(spark, "List I List II A. one B. two (i) x (ii) y")["items_2"] == ["(i) x", "(ii) y"]
    assert lists(spark, "List I List II (A) one (B) two (I) x") is None
    assert lists(spark, "List I only") is None and lists(spark, None) is None and lists(spark, "") is None
    # one list after the other, each behind its own header
    assert lists(spark, "List I (A) aa (B) bb List II (I) cc (II) dd Choose one") == {"preamble": "", "items_1": ["(A) aa", "(B) bb"], "items_2": ["(I) cc", "(II) dd"], "trailer": "Choose one"}
    assert lists(spark, "Match: Column I 1. aa 2. bb; Column II [kinds]: i. cc ii. dd") == {"preamble": "Match:", "items_1": ["1. aa", "2. bb"], "items_2": ["i. cc", "ii. dd"], "trailer": ""}
    ar = "Given are two: one is Assertion (A): the other Reason (R): Assertion (A): cells live. Reason (R): they eat. In the light of this, choose"
    assert parts_of(spark, ar) == {"intro": "Given are two: one is Assertion (A): the other Reason (R):", "parts": ["Assertion (A): cells live.", "Reason (R): they eat."], "trailer": "In the light of this, choose"}
    assert parts_of(spark, "Assertion (A): alone") is None and parts_of(spark, None) is None
    assert parts_of(spark, "Statement I: choose x. Statement II: y") == {"intro": "", "parts": ["Statement I: choose x.", "Statement II: y"], "trailer": ""}


@pytest.mark.parametrize(("s", "n"), [("", 0), ("abc", 3), ("a $x", 2), ("a $x$ b", 7), ("a **b", 2), ("$$x$$", 5), ("$$x$", 0), ("$a$$b$", 6), ("**a $b** c", 10), ("$a**b$", 6), (None, 0)])
def test_safe_boundary(spark, s, n):
    def reference(t):
        i = safe = 0
        on = {"$$": False, "$": False, "**": False}
        while i < len(t):
            for mark in ("$$", "$", "**"):
                if t.startswith(mark, i) and not any(v for k, v in on.items() if k != mark):
                    on[mark] = not on[mark]
                    i += len(mark)
                    break
            else:
                i += 1
            if not any(on.values()):
                safe = i
        return safe

    assert parse.with_boundary(spark.createDataFrame([(s,)], "text string")).first().boundary == n == reference(s or "")


def test_pages_in_reading_order(spark):
    rows = [(1, 1, 1, 5.0, "text", "1. Q", None), (1, 1, 2, 1.0, "text", "Title", None), (1, 1, 3, 2.0, "image", None, 7), (1, 1, 4, 6.0, "image", None, 8), (1, 1, 5, 7.0, "image", None, 9), (1, 2, 1, 1.0, "image", None, 9), (1, 2, 2, 1.0, "text", " ", None), (1, 2, 3, 2.0, "text", "only", None), (2, 1, 1, 0.0, "image", None, 8)]
    df = spark.createDataFrame(rows, "doc int, page int, ord int, y0 double, kind string, text string, xref int")
    got = {(r.doc, r.page): r.text for r in layout.pages(df).collect()}
    assert got == {(1, 1): "Title\n1. Q\n<<<DIAGRAM_HERE>>>", (1, 2): "only", (2, 1): "<<<DIAGRAM_HERE>>>"}


def test_changes(spark):
    t = spark.createDataFrame([(1, "a", "u"), (2, "b", None)], "id int, chapter string, diagram_url string")
    c = spark.createDataFrame([(1, None, None, True), (2, "c", "v", None), (3, "x", "y", None)], "id int, chapter string, diagram_url string, set_diagram_url boolean")
    assert {tuple(r) for r in merge.patch(t, c, nullable=["diagram_url"]).collect()} == {(1, "a", None), (2, "c", "v")}
    assert {tuple(r) for r in merge.patch(t, c).collect()} == {(1, "a", "u"), (2, "c", "v")}
    assert [r.id for r in merge.not_found(t, c).collect()] == [3]
    usage = spark.createDataFrame([("g", 1, 5), ("u", 1, 2)], "key string, usage_date int, tokens_used int")
    moves = spark.createDataFrame([("g", "u")], "guest string, user string")
    once = merge.transfer(usage, moves)
    assert {tuple(r) for r in once.collect()} == {("g", 1, 0), ("u", 1, 7)} == {tuple(r) for r in merge.transfer(once, moves).collect()}
    cache = spark.createDataFrame([("q",)], "text string").select(text.key_of(F.col("text")).alias("question_hash"), F.lit("hit").alias("answer"))
    hits, misses = merge.cached(spark.createDataFrame([("q",), ("new",), ("new",)], "text string"), cache, "text", "answer")
    assert sorted(map(str, (r.answer for r in hits.collect()))) == ["None", "None", "hit"] and [r.text for r in misses.collect()] == ["new"]


def test_limits(spark):
    at = lambda *s: [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=x) for x in s]
    calls = spark.createDataFrame([(i, "a" if i != 4 else "b", "p", t) for i, t in enumerate(at(0, 1, 2, 60, 2.5, 61))], "id int, address string, path string, ts timestamp")
    got = {r.id: r.admitted for r in limits.rate_limited(calls, 2, 60).collect()}
    # the call at 2 is rejected and doesn't count, so the one just after the window is admitted
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}
    logins = spark.createDataFrame([(i, "a", t, ok) for i, (t, ok) in enumerate(zip(at(0, 1, 2, 3, 301.9, 302, 303), [False, False, False, True, True, False, True]))], "id int, address string, ts timestamp, ok boolean")
    assert [r.outcome for r in limits.lockouts(logins).orderBy("id").collect()] == ["failed", "failed", "failed", "blocked", "blocked", "failed", "ok"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"k{i % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i), 10 * (i % 4)) for i in range(60)]
    kind = "id int, address string, ts timestamp, tokens int"
    df = spark.createDataFrame(rows, kind)
    for k in range(3):
        df.where(f"id div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    q = limits.stream_rate_limited(stream.select("address", "id", "ts"), 2, 50).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {r.id: r.admitted for r in limits.rate_limited(df, 2, 50, keys=("address",)).collect()}
    assert {r.id: r.admitted for r in spark.table("limited").collect()} == want
    u = limits.stream_usage(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "address", "ts", "tokens").writeStream.format("memory").queryName("used").outputMode("complete").start()
    u.processAllAvailable()
    u.stop()
    assert {tuple(r) for r in spark.table("used").collect()} == {tuple(r) for r in profile.daily_usage(df, "address", "ts", "tokens").collect()}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name in ("a.pdf", "b.txt", "e/c.pdf"):
        (tmp_path / "d" / name).write_bytes(b"one\fsecond" if name != "e/c.pdf" else b"\xff")
    every = files.listing(spark, str(tmp_path / "d"))
    assert every.count() == 2 and files.listing(spark, str(tmp_path / "d"), recursive=False).count() == 1
    config = spark.createDataFrame([("a.pdf", 2020), ("missing.pdf", 2021)], "file string, year int")
    assert [r.year for r in files.configured(every, config).collect()] == [2020]

    def reader(data):
        return [*data.decode().split("\f"), ""]

    assert {(r.pages, r.text) for r in files.page_texts(every, reader).collect()} == {(3, "one\nsecond"), (0, None)}
    df = spark.createDataFrame([(1, '```json\n[{"q": "x", "n": 1}, {"q": "y"}]\n```'), (2, "broken"), (3, "[]")], "id int, out string")
    assert {tuple(r) for r in files.json_rows(df, "out", "q string, n int").collect()} == {(1, "x", 1), (1, "y", None)}
    assert values(spark, files.payload, "aGk=", "?") == [bytearray(b"hi"), None]
    good, tally = sinks.split_status(df, F.col("id") > 1)
    assert tally.first() == (2, 1) and sinks.append(good, str(tmp_path / "out")).first()[0] == 2
    assert sinks.read_only(spark, good, "shown").count() == 2


def test_samples_and_vectors(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("subject"), F.lit("c").alias("chapter"))
    one = {r.id for r in sample.stratified(df, {"a": 10, "b": 20}).collect()}
    assert len(one) == 30 and one == {r.id for r in sample.stratified(df.repartition(5), {"a": 10, "b": 20}).collect()}
    assert sample.pooled(df, [("a", []), ("b", ["none"])], 0).count() == 1
    sets = sample.test_sets(df, 2, 45).collect()
    assert len(sets) == 4 and all(len(set(r.question_ids)) == 45 for r in sets) and len({tuple(r.question_ids) for r in sets}) == 4
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0])], "id int, embedding array<float>")
    assert [r.id for r in vector.top_k(e, [1.0, 0.0], 3, 0.5).collect()] == [1, 2]


def test_external_hook(spark):
    df = spark.createDataFrame([(1, 1, "good text " * 9), (1, 2, ".")], "doc int, page int, text string")
    got = external.extract_pages(df, external.stub_embedding(2), "embedding array<double>").collect()
    assert [(r.page, r.failed) for r in got] == [(1, False), (2, True)]


def test_list_and_statement_queries_parse_whole_texts(spark, tmp_path):
    tail = "words " * 20
    rows = [(1, tail + "(III) late (C) more"), (2, tail + "Statement II: behind. Choose none"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lists = {r.doc_id: (r.items_1, r.items_2, r.trailer) for r in queries.u9_match_lists(spark, str(tmp_path)).collect()}
    assert lists[1] == (f"(A) {tail.strip()}|(C) more|(B) y", "(III) late|(I) x|(II) z", "Choose the answer")
    assert lists[2] == (None, None, None) and lists[3] == (None, None, None)
    parts = {r.doc_id: (r.parts, r.trailer) for r in queries.u10_statements(spark, str(tmp_path)).collect()}
    assert parts[1] == (f"Assertion (A): {rows[0][1]}|Reason (R): so.", "Choose one")
    assert parts[2] == (f"Assertion (A): {tail.strip()}|Statement II: behind. Choose none|Reason (R): so.", "Choose one")
    assert parts[3] == (None, "") or parts[3] == (None, None)


def test_answer_lookup_finds_questions_of_other_conversations(spark, tmp_path):
    rows = [(1, 0, "user", "What is X?"), (1, 1, "assistant", "It is Y."), (2, 4, "user", " what is x? "), (2, 5, "assistant", "What is X?"), (3, 0, "user", "other"), (3, 1, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.k13_answer_lookup(spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.turn): r.answer for r in got} == {(1, 0): 4, (1, 1): None, (2, 4): 4, (2, 5): 4, (3, 0): 0, (3, 1): None} and len(got) == len(rows)


def test_near_duplicate_queries_at_half_equal_brute_force(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(i, "g" if i % 3 else "h", " ".join(f"t{rng.randrange(14)}" for _ in range(rng.randrange(1, 12)))) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in range(0, 90, 2)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    want = {}
    for i, g, a in rows:
        for j, h, b in rows:
            x, y = set(a.split()), set(b.split())
            if i < j and g == h and 2 * len(x & y) >= len(x | y):
                want[i, j] = len(x & y) / len(x | y)
    assert any(v < 0.8 for v in want.values())
    got = queries.j3_near_duplicates_at_half(spark, str(tmp_path)).collect()
    assert {(r.id_a, r.id_b): r.overlap for r in got} == {k: pytest.approx(v, abs=6e-4) for k, v in want.items()} and len(got) == len(want)
    left = {(r.id_a, r.id_b) for r in queries.j2_dismissed_pairs_at_half(spark, str(tmp_path)).collect()}
    assert left == {(i, j) for i, j in want if i % 2 or j != i + 1}
    ends = [r.id for r in queries.j4_participants_at_half(spark, str(tmp_path)).collect()]
    assert sorted(ends) == sorted({x for k in want for x in k})


def test_near_duplicates_have_pairs_from_half_on(spark, tmp_path):
    rows = [(1, "g", "aa bb cc dd"), (2, "g", "aa bb cc"), (3, "g", "cc dd ee ff"), (4, "g", "aa bb xx yy zz")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.id_a, r.id_b, r.overlap) for r in queries.j3_near_duplicates(spark, str(tmp_path)).collect()] == [(1, 2, 0.75)]


def test_participants_have_pairs_from_half_on(spark, tmp_path):
    rows = [(1, "g", "aa bb cc dd"), (2, "g", "aa bb cc"), (3, "g", "cc dd ee ff"), (4, "g", "aa bb xx yy zz")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.j4_participants(spark, str(tmp_path)).collect())) == [(1, "g"), (2, "g")]


def test_limits_walk_one_hot_key_and_rows_without_a_time(spark):
    rows = spark.range(40_000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("address"), F.timestamp_seconds(F.col("id") * 7 % 40_000).alias("ts"), (F.col("id") % 3 > 0).alias("ok"))
    odd = spark.createDataFrame([(-1, "hot", None, True), (-2, None, dt.datetime(1970, 1, 1), None)], "id long, address string, ts timestamp, ok boolean")
    log = rows.unionByName(odd)
    got = {r.id: r.admitted for r in limits.rate_limited(log, 3, 100, keys=("address",)).collect()}
    outcomes = {r.id: r.outcome for r in limits.lockouts(log, 2, 50).collect()}
    assert got[-1] is None and got[-2] is True and outcomes[-1] is None and outcomes[-2] == "failed"
    want, locked = {}, {}
    state, lock = {}, {}
    for r in sorted((r for r in log.collect() if r.ts), key=lambda r: (r.ts, r.id)):
        t = r.ts.timestamp()
        recent = [x for x in state.get(r.address, []) if t - x < 100]
        want[r.id] = len(recent) < 3
        state[r.address] = recent + [t] * want[r.id]
        failures, until = lock.get(r.address, (0, 0))
        locked[r.id] = "blocked" if until > t else "ok" if r.ok else "failed"
        if until <= t:
            lock[r.address] = (0, 0) if r.ok else (0, t + 50) if failures + 1 >= 2 else (failures + 1, until)
    assert {k: v for k, v in got.items() if k != -1} == want and {k: v for k, v in outcomes.items() if k != -1} == locked


@pytest.mark.parametrize("cut", [1, 4])
def test_lockouts_of_a_stream_in_any_batches(spark, tmp_path, cut):
    import random

    rng = random.Random(cut)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"k{rng.randrange(3)}", start + dt.timedelta(seconds=20 * (i // 2)), rng.random() < 0.4) for i in range(80)]
    kind = "id int, address string, ts timestamp, ok boolean"
    # a row far ahead of all others lets the watermark pass them; rows come out of order within a file
    end = [(1000, "end", start + dt.timedelta(days=9), True)]
    for k in range(cut):
        part = [r for i, r in enumerate(rows) if i * cut // len(rows) == k]
        spark.createDataFrame(rng.sample(part, len(part)) + (end if k == cut - 1 else []), kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = spark.createDataFrame([], kind).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).withWatermark("ts", "5 minutes")
        name = f"locked{cut}"
        q = limits.stream_lockouts(stream, 2, 100).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {r.id: r.outcome for r in limits.lockouts(spark.createDataFrame(rows, kind), 2, 100).collect()}
    got = [(r.id, r.outcome) for r in spark.table(name).collect()]
    assert dict(got) == want and len(got) == len(want) and len(set(want.values())) == 3


def test_metering_survives_a_crash_without_counting_twice(spark, tmp_path):
    rows = [(i, f"u{i % 4}", dt.datetime(2024, 1, 1, 18, 0) + dt.timedelta(minutes=i), i % 7 - 1) for i in range(90)]
    kind = "id int, user_id string, ts timestamp, tokens int"
    df = spark.createDataFrame(rows, kind)
    for k in range(3):
        df.where(f"id div 30 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ledger, at = str(tmp_path / "ledger"), str(tmp_path / "at")
    writer = limits.meter(stream, ledger, "user_id", "ts", "tokens")
    whole = writer.option("checkpointLocation", at).trigger(availableNow=True).start()
    whole.awaitTermination()
    # the last batch was posted, but its commit got lost: it runs once more
    import pathlib

    for f in pathlib.Path(at, "commits").glob("*2*"):
        f.unlink()
    again = limits.meter(stream, ledger, "user_id", "ts", "tokens").option("checkpointLocation", at).trigger(availableNow=True).start()
    again.awaitTermination()
    assert any(p["batchId"] == 2 for p in again.recentProgress)
    df.createOrReplaceTempView("posted")
    want = spark.sql("SELECT user_id, CAST(ts + INTERVAL 330 MINUTES AS DATE) AS usage_date, sum(tokens) AS tokens_used FROM posted WHERE tokens > 0 GROUP BY 1, 2")
    assert sorted(map(tuple, limits.metered(spark, ledger, "user_id").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.9])
def test_pairs_of_repeated_ids_and_many_equal_sets(spark, threshold):
    import random

    rng = random.Random(8)
    rows = [(1, "g", "aa bb"), (1, "g", "aa bb"), (2, "g", "bb aa"), (3, None, "aa bb"), (4, None, "aa bb")]
    rows += [(i % 70, "h", " ".join(f"t{min(rng.randrange(9), rng.randrange(40))}" for _ in range(rng.choice((1, 2, 4, 8, 16, 32))))) for i in range(150)]
    want = []
    for k, (i, g, a) in enumerate(rows):
        for j, h, b in rows[k + 1 :]:
            x, y = set(a.split()), set(b.split())
            if i != j and g == h and g and len(x & y) / len(x | y) >= threshold:
                want.append((g, min(i, j), max(i, j), len(x & y) == len(x | y)))
    df = spark.createDataFrame(rows, "id int, subject string, t string").repartition(3)
    got = [(r.subject, r.id_a, r.id_b, r.exact) for r in near_duplicates.pairs(df, F.col("t"), threshold).collect()]
    assert sorted(got) == sorted(want) and ("g", 1, 2, True) in got


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.8])
def test_pairs_in_many_blocks_and_widths_lose_nothing(spark, monkeypatch, threshold):
    import random

    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    monkeypatch.setattr(near_duplicates, "_WIDEST", 256)
    rng = random.Random(9)
    rows = []
    for i in range(40):
        base = [f"t{rng.randrange(5000)}" for _ in range(rng.choice((3, 20, 60, 150, 400)))]
        rows += [(4 * i + k, "g" if i % 3 else "h", " ".join(w for w in base if rng.random() < 1 - 0.12 * k)) for k in range(4)]
    want = set()
    for i, g, a in rows:
        for j, h, b in rows:
            x, y = set(a.split()), set(b.split())
            if i < j and g == h and x and y and len(x & y) / len(x | y) >= threshold:
                want.add((i, j))
    found = near_duplicates.pairs(spark.createDataFrame(rows, "id int, subject string, t string"), F.col("t"), threshold)
    got = [(r.id_a, r.id_b) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 20
    # no row for each token, nor for each pair that shares one, goes through a shuffle
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(tokens" not in plan and "posexplode" not in plan


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_pairs_of_many_copies_are_made_from_classes_in_parts(spark, monkeypatch, threshold):
    monkeypatch.setattr(near_duplicates, "COPIES", 3)
    monkeypatch.setattr(near_duplicates, "TOLD", 2)
    monkeypatch.setattr(near_duplicates, "_MANY", 4)
    monkeypatch.setattr(near_duplicates, "_STEP", 2)
    monkeypatch.setattr(near_duplicates, "_WIDE", 8)
    texts = ["aa bb cc dd"] * 12 + ["aa bb cc"] * 7 + ["aa bb cc dd ee"] + ["xx yy"] * 2 + ["aa xx zz"]
    rows = [(f"k{i % 20:02}" if i != 5 else None, "g", x) for i, x in enumerate(texts)]
    want = []
    for k, (i, _, a) in enumerate(rows):
        for j, _, b in rows[k + 1 :]:
            x, y = set(a.split()), set(b.split())
            if i and j and i != j and len(x & y) / len(x | y) >= threshold:
                want.append((min(i, j), max(i, j), round(len(x & y) / len(x | y), 3)))
    found = near_duplicates.pairs(spark.createDataFrame(rows, "id string, subject string, t string").repartition(3), F.col("t"), threshold)
    assert sorted((r.id_a, r.id_b, r.overlap) for r in found.collect()) == sorted(want)


def test_near_pairs_are_not_sent_before_they_are_the_result(spark):
    rows = [(i, "g", f"aa bb cc dd t{i % 7}") for i in range(20)]
    found = near_duplicates.pairs(spark.createDataFrame(rows, "id int, subject string, t string"), F.col("t"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")] and len(found.collect()) == 190


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_few_bits_of_a_pair_are_looked_at_and_lose_nothing(threshold):
    import numpy as np

    rng = np.random.default_rng(5)
    base = [rng.choice(1 << 20, rng.integers(128, 181), replace=False) for _ in range(150)]
    sets = sorted([*base, *(np.unique(np.concatenate([x[: int(len(x) * share)], rng.choice(1 << 20, int(len(x) * (1 - share))) + (1 << 20)])) for x in base for share in (0.4, 0.75, 0.95))], key=len)
    sets = [x for x in sets if 128 <= len(x) < 182]
    n = np.array([len(x) for x in sets])
    width = near_duplicates._width(np.array([2 * 181]), threshold)[0]
    # the first half of these words is looked at; a set of 181 tokens had 16 words at 0.5, and 8 at 0.8
    assert width // 128 <= {0.5: 8, 0.8: 4}[threshold]
    tokens = np.concatenate(sets).astype(np.int64) * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF
    words = near_duplicates._parity(tokens, n, np.full(len(n), width)).view(np.uint64).reshape(len(n), -1)
    got = [(int(i), int(j)) for p, q in near_duplicates._fitting((n, words), (n, words), threshold, True, 16, 64) for i, j in zip(p, q)]
    as_sets = [set(x.tolist()) for x in sets]
    want = {(i, j) for i, x in enumerate(as_sets) for j, y in enumerate(as_sets) if i < j and len(x & y) / len(x | y) >= threshold}
    assert want and want <= set(got) and len(got) == len(set(got)) < len(want) + 50


def test_participants_make_each_pair_once(spark):
    df = spark.createDataFrame([(i, "g", f"aa bb cc dd t{i % 7}") for i in range(20)] + [(20, "g", "zz")], "id int, subject string, t string")
    got = near_duplicates.participants(df.select("id"), near_duplicates.pairs(df, F.col("t")))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    assert sorted(r.id for r in got.collect()) == list(range(20))


def test_real_dismissals_leave_out_copies_and_send_no_text(spark, tmp_path):
    rows = [(i, "g", x) for i, x in enumerate(["aa bb cc", "aa bb cc", "AA bb cc", "aa bb cc", "aa bb", None, None, "aa bb"])]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = branches.j2_real_dismissals(spark, str(tmp_path))
    own = [(i, j) for i, _, a in rows for j, _, b in rows if i < j and a and b and not (a == b and i % 2 == 0)]
    assert sorted((r.id_a, r.id_b) for r in found.collect()) == own
    # a copy is known by the digest of its text
    assert "sha2(" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("sort", "direction"), [("year", "asc"), ("year", "desc"), ("id", "asc"), ("name", "desc")])
def test_deep_pages_equal_pages(spark, sort, direction):
    rows = [(i * 37 % 400, "S", None if i % 9 == 0 else i % 3, f"n{i % 50}") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, subject string, year int, name string").repartition(3)
    for page in (1, 2, 7, 8, 9, 40):
        spec = search.SearchSpec(sort=sort, direction=direction, page=page, page_size=51, sortable=("id", "year", "name"), columns=("id",))
        assert [r.id for r in search.deep_page(df, spec, ranges=5, least=60).collect()] == [r.id for r in search.page(df, spec).collect()], page
    assert search.deep_page(df.where("false"), search.SearchSpec(page=3)).collect() == []


@pytest.mark.parametrize("needle", ["ING o", "50%", "a_c%def", "ab", "", "ÜNÏ", "\\x"])
def test_substring_index_equals_scan(spark, tmp_path, needle):
    rows = [(1, "going on", None), (2, "xing", "o ing"), (3, "rate 50% ab", ""), (4, "aXc--DEFabc", "zz"), (5, None, "ünï \\x ab"), (6, "", "in"), (7, "ing o", "ING O")]
    df = spark.createDataFrame(rows, "id int, question string, option_a string")
    columns = ["question", "option_a"]
    substring_index.store(substring_index.postings(df, columns), str(tmp_path / "grams"))
    found, checked = substring_index.search(df, spark.read.parquet(str(tmp_path / "grams")), needle, columns)
    want = {r.id for r in df.where(search.contains(needle, F.col("question"), F.col("option_a"))).collect()}
    n = checked.first().checked
    assert {r.id for r in found.collect()} == want and len(want) <= n <= (7 if not substring_index.needle_grams(needle) else 3)


@pytest.mark.parametrize("most", [30, 2 << 20])
def test_substring_index_holds_lists(spark, tmp_path, most):
    rows = [(i, "Shared words \U0001f600\0\0 " * 2 + str(i), "ab" if i % 2 else f"x{i % 3}yz\u4e2d") for i in range(60)] + [(60, None, None), (61, "abc" * 40, "")]
    df = spark.createDataFrame(rows, "id int, question string, option_a string").coalesce(1)
    want = {}
    for i, *texts in rows:
        for t in texts:
            for k in range(len(t or "") - 2):
                want.setdefault(t[k : k + 3].lower(), set()).add(i)
    found = substring_index.postings(df, ["question", "option_a"], most=most)
    lists, got = found.collect(), {}
    for r in lists:
        assert len(set(r.ids)) == len(r.ids)
        got.setdefault(r.gram, set()).update(r.ids)
    assert got == want and (most < 100 or len(lists) == len(want))
    # neither a row nor a shuffled row for each trigram of each text
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "explode" not in plan
    substring_index.store(found, str(tmp_path / "grams"))
    hits, checked = substring_index.search(df, spark.read.parquet(str(tmp_path / "grams")), "words%29", ["question", "option_a"])
    # no trigram of its second part, so the first part's are looked up
    assert checked.first().checked == 60 and {r.id for r in hits.collect()} == {29}


def test_stored_tables_rewrite_touched_parts_only(spark, tmp_path, monkeypatch):
    kind = "id int, chapter string, version int"
    table = stored.StoredTable(spark, f"file://{tmp_path}/t", ["id"], 8)
    rows = [(i, "a", 1) for i in range(100)]
    table.replace(spark.createDataFrame(rows, kind))
    before = table.manifest()
    upsert = lambda t, r: merge.upsert(t, r, ["id"], "version")
    assert len(before) == 8 and table.change(spark.createDataFrame([(7, "b", 2)], kind), upsert) == 1
    after = table.manifest()
    assert sum(before[k] != after[k] for k in before) == 1
    state = lambda: {r.id: (r.chapter, r.version) for r in table.read().collect()}
    want = {i: ("a", 1) for i in range(100)} | {7: ("b", 2)}
    assert state() == want
    # a change that crashes before its manifest is there leaves the table as it was
    with monkeypatch.context() as m:
        m.setattr(stored.StoredTable, "_switch", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.change(spark.createDataFrame([(8, "c", 3), (9, "c", 3)], kind), upsert)
    assert state() == want and table.version() == 2
    table.change(spark.createDataFrame([(7, None, None)], kind), lambda t, r: merge.delete(t, r))
    table.change(spark.createDataFrame([(8, "p", None)], kind), lambda t, r: merge.patch(t, r))
    assert state() == {k: v for k, v in want.items() if k != 7} | {8: ("p", 1)}
    assert table.change(spark.createDataFrame([], kind), upsert) == 0
    with pytest.raises(RuntimeError):
        table._switch({}, table.version())


def test_a_thousand_keywords(spark, monkeypatch):
    import random

    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    keywords = [(i % 40, f"c{i % 40}", make(rng.randrange(1, 7))) for i in range(1000)] + [(3, "c3", None), (50, "last", "ABC")]
    texts = [(i, make(rng.randrange(0, 60)).upper() if i % 2 else make(5)) for i in range(80)] + [(900, None), (901, "")]
    best = {}
    for i, t in texts:
        low = (t or "").lower()
        hits = {}
        for o, c, k in keywords:
            if k is not None and k.lower() in low:
                hits[o, c] = hits.get((o, c), 0) + 1
        best[i] = min(hits, key=lambda x: (-hits[x], x))[1] if hits else None
    table, df = spark.createDataFrame(keywords, "ordinal int, chapter string, keyword string"), spark.createDataFrame(texts, "id int, question string")
    for size in (100_000, 7):
        monkeypatch.setattr(lookup, "AUTOMATON", size)
        assert {r.id: r.tagged_chapter for r in lookup.keyword_class(df, table).collect()} == best
    only = lookup.keyword_class(df, table, only=F.col("id") < 5).collect()
    assert len(only) == len(texts) and all(r.tagged_chapter == (best[r.id] if r.id < 5 else None) for r in only)
    fragments = spark.createDataFrame([(2, "b-c", "two"), (1, "Bc", "one"), (3, "a", "three")], "ordinal int, fragment string, chapter string")
    names = spark.createDataFrame([(1, "x_b_c"), (2, "abc"), (3, "zA"), (4, "q"), (5, None)], "id int, name string")
    want = {1: None, 2: "one", 3: "three", 4: None, 5: None}
    assert {r.id: r.chapter for r in lookup.first_fragment(names, fragments, F.col("name")).collect()} == want


def _nearest_by_hand(rows, queries, k, at_least):
    out = []
    for q, v in queries:
        scored = []
        for i, x in rows:
            if x and v and len(x) == len(v) and None not in x and np.isfinite(x).all() and np.any(x) and None not in v and np.isfinite(v).all() and np.any(v):
                s = round(float(np.dot(x, v) / (np.linalg.norm(x) * np.linalg.norm(v))), 6)
                scored += [(-s, i)] if s > at_least else []
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("rows_of_a_tile", "at_least", "k"), [(8192, 0.5, 3), (7, 0.5, 3), (7, -2.0, 4), (40, 0.99, 50)])
def test_nearest_of_each(spark, monkeypatch, rows_of_a_tile, at_least, k):
    monkeypatch.setattr(pivots, "ROWS", rows_of_a_tile)
    monkeypatch.setattr(pivots, "QUERIES", rows_of_a_tile)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    near = [(centres[i % 12] + rng.normal(size=8) * 0.1).round(3).tolist() for i in range(300)]
    # a third of all rows alike, other sizes, and what takes no part
    vectors = near + [near[0]] * 150 + [[1.0, 2.0], [2.0, 4.0], [1.0], None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [1.0] * 7]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, near[3]), (3, near[3])]
    queries = rows[::9] + rows[450:] + [(0, near[0])]
    df = lambda x: spark.createDataFrame([(i, v, "c") for i, v in x], "id long, embedding array<double>, q string")
    got = pivots.nearest(df(rows), df(queries), k, at_least)
    assert sorted(map(tuple, got.found.collect())) == _nearest_by_hand(rows, queries, k, at_least)
    n = got.pruning.first()
    assert 0 < n.compared <= n.pairs
    if at_least >= 0.5:
        assert n.compared < n.pairs / 2


def test_nearest_without_rows(spark):
    none, one = (spark.createDataFrame(x, "id string, embedding array<float>") for x in ([], [("a", [1.0, 0.0])]))
    for rows, queries in ((none, one), (one, none), (none, none)):
        found, pruning = pivots.nearest(rows, queries)
        assert found.collect() == [] and pruning.first() == (0, 0)
    assert [tuple(r) for r in pivots.nearest(one, one).found.collect()] == [("a", 1, "a", 1.0)]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 30, 57])
def test_pages_end_at_a_short_or_empty_one(spark, tmp_path, n):
    table = pa.table({"id": list(range(n)), "other": ["x"] * n}, pa.schema([("id", pa.int64()), ("other", pa.string())]))
    asked = tmp_path / "asked"
    asked.mkdir()

    def fetch(offset, limit):
        (asked / str(offset)).touch()
        return table.slice(offset, limit)

    assert sorted(r.id for r in paged.paged(spark, f"service_{n}", fetch, "id long", size=10, readers=3).collect()) == list(range(n))
    assert len(list(asked.iterdir())) <= n // 10 + 1 + 3
    # the number that a service tells may be out of date, in either direction
    for rows in (n, n // 2, n + 15):
        assert sorted(r.id for r in paged.paged(spark, f"service_{n}_{rows}", fetch, "id long", size=10, rows=rows, pages_each=2).collect()) == list(range(n))


def test_parquet_pages(spark, tmp_path):
    for name, ids in (("b", range(7, 20)), ("a", range(7)), ("c", [])):
        pq.write_table(pa.table({"id": pa.array(ids, pa.int64()), "x": pa.array(ids, pa.int64())}), tmp_path / f"{name}.parquet", row_group_size=5)
    (tmp_path / "_SUCCESS").touch()
    service = paged.ParquetPages(str(tmp_path), ["id"])
    assert service(0, 9).column("id").to_pylist() == list(range(9)) and service(4, 100).column("id").to_pylist() == list(range(4, 20))
    assert service(20, 5).num_rows == 0 and service.rows() == 20 and service(19, 5).column_names == ["id"]
    assert sorted(r.id for r in paged.paged(spark, "stored_pages", service, "id long", size=4, readers=2).collect()) == list(range(20))


def test_page_images(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\f" + b"two" * 40)
    (tmp_path / "b.pdf").write_bytes(b"!")

    def render(content):
        if content == b"!":
            raise ValueError
        yield from content.split(b"\f")

    found = files.page_images(files.listing(spark, str(tmp_path)), render)
    assert sorted((r.page, r.image) for r in found.collect()) == [(1, "b25l"), (2, "dHdv" * 40)]


def test_pages_of_copies(spark):
    contents = {"a": b"one\ftwo\fthree", "b": b"!", "c": b"", "d": b"\f" * 2100 + b"end", "e": b"one\f"}
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in contents.items()], "path string, content binary").coalesce(1)

    def render(path):
        with open(path, "rb") as f:
            content = f.read()
        if content == b"!":
            raise ValueError
        yield from content.split(b"\f")

    want = {(p, n, base64.b64encode(x).decode()) for p, c in contents.items() if c != b"!" for n, x in enumerate(c.split(b"\f"), 1)}
    got = [tuple(r) for r in files.page_images(df, render, by_path=True).collect()]
    assert set(got) == want and len(got) == len(want)
    texts = files.page_texts(df, lambda path: [x.decode() for x in render(path)], "|", by_path=True).collect()
    assert {(r.path, r.pages, r.text) for r in texts} == {("a", 3, "one|two|three"), ("b", 0, None), ("c", 1, ""), ("d", 2101, "end"), ("e", 2, "one")}
    assert inspect.isgenerator(branches._pages_of("none"))
