"""Queries of exam papers and list questions, made of whole documents, with SQL that finds the same by windows over lines instead of folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import parse
from ..sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: What follows the sentences of a paper, in turn: options of all kinds, answers before and after them, lines that go on, none.
TAILS = {
    "standard": ["(1) one\n(2) two\nand more\n(3) three\n(4) four\nAns. (3)", "a. first\nB. second\n  and third \nAns. [c]", "Ans. 2\nstray\n(1) late", "which goes on\nand the means ans. B here\n(4) last", "neither option nor answer", "(1) x\n7. a numbered line, as it stands here\n(2) y\nans. d", "(2) two only"],
    "sol": ["(1) one\n(2) two\nAnswer: (2)\nSol. because\n(3) never read", "a. first\nmore\nB. second\nSol: c\nd. fourth", "the transcription of it\nmeans a lot\n(4) four", "Students find this hard", "ANS [d]\nnot read", "(1) x\nAns.4"],
    "q_format": ["(1) one\n(3) three\ngoes on\nAns. [3]\nSol. x", "ans. [2]\na. no option\n(2) two", "Ans. [1]\n(1) late\nSolution: none\n(2) never", "Ans. [7]", "(4) four"],
    "abcd_inline": ["a. one\nb. two\nmore\nb.x\nAns: B", "Answer d\nit goes on\na. one", "the transcript answers a\nb. only this", "b.x\na. one\nc. three\nC. again", "A. one\n(1) no option\nans a\nd. four"],
}
SEPARATOR = {"sol": "\n \n"}


def _text(fmt: str, text: Column) -> Column:
    """A paper of a text: each sentence is a question, with a number beyond all limits now and then."""
    sentences = F.filter(F.split(text, r"\.\s+"), lambda s: F.length(s) > 0)
    tails, head, sep = F.array(*map(F.lit, TAILS[fmt])), "Q." if fmt == "q_format" else "", SEPARATOR.get(fmt, "\n")

    def asked(s, i):
        number = F.when(i % 50 == 49, F.lit("99999999999")).otherwise((i + 1).cast("string"))
        return F.concat(F.lit(head), number, F.lit(" " if head else ". "), F.regexp_replace(s, r"\s+", " "), F.lit("\n"), F.element_at(tails, (i % len(TAILS[fmt]) + 1).cast("int")))

    return F.concat(F.lit(sep), F.array_join(F.transform(sentences, asked), sep))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _text_sql(fmt: str) -> str:
    head, sep = "Q." if fmt == "q_format" else "", SEPARATOR.get(fmt, "\n")
    tails = ", ".join(map(_quoted, TAILS[fmt]))
    asked = f"{_quoted(head)} || CASE WHEN i % 50 = 0 THEN '99999999999' ELSE i::VARCHAR END || {_quoted(' ' if head else '. ')} || regexp_replace(s, '\\s+', ' ', 'g') || chr(10) || ([{tails}])[(i - 1) % {len(TAILS[fmt])} + 1]"
    return f"{_quoted(sep)} || array_to_string(list_transform(list_filter(string_split_regex(text, '\\.\\s+'), lambda s: length(s) > 0), lambda s, i: {asked}), {_quoted(sep)})"


_WHITE = r"[\s\x0B\x85\p{Z}]"
#: Where questions begin, without looking ahead: (what goes, what stays); twice, since a match takes the blank that the next begins with.
_BEGIN = {"standard": (r"\n", r"\d+\.[\s\n]"), "sol": (r"\n\s*\n\s*", r"\d+\."), "q_format": (r"\n", r"Q\.\d+\s"), "abcd_inline": (r"\n", r"\s*\d+\.")}
_ANSWER = fixed.PAPER_ANSWER | parse.WHOLE_ANSWER


def _strip(value: str) -> str:
    return f"regexp_replace({value}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"


def _hits(words: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower(question), '{w}')::INTEGER" for w in words) + ")"


def parsed_sql(fmt: str, papers: str, name: str = "") -> str:
    """CTEs of the questions ``found_<name>`` (id, number, question, options, correct_answer, b) of ``papers`` (id, text), by windows over lines."""
    n, number = name or fmt, fixed.PAPER_NUMBER[fmt]
    noise = "text"
    for pattern in fixed.PAGE_NOISE:
        noise = f"regexp_replace({noise}, '{pattern}', '', 'g')"
    gone, stays = _BEGIN[fmt]
    cut = noise
    for _ in range(2):
        cut = f"regexp_replace({cut}, '{gone}({stays})', chr(1) || '\\1', 'g')"
    answer = f"regexp_extract(line, '{_ANSWER[fmt]}', 1)"
    answer = {"q_format": f"translate({answer}, '1234', 'abcd')", "abcd_inline": f"lower({answer})"}.get(fmt, answer)
    options = fixed.PAPER_OPTIONS[fmt]
    letter = f"translate(lower(coalesce({', '.join(f'''nullif(regexp_extract(line, '{p}', 1), '')''' for p in options)}, '')), '1234', 'abcd')"
    body = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN regexp_extract(line, '{p}', 2)" for p in options) + " ELSE line END"
    stop = f"min(CASE WHEN regexp_matches(line, '{fixed.PAPER_STOP[fmt]}') THEN l END) OVER (PARTITION BY id, b)" if fmt in fixed.PAPER_STOP else "NULL"
    closes = "letter <> ''" if fmt == "abcd_inline" else "letter <> '' OR answer <> ''"
    loose = "AND NOT regexp_matches(line, '(?i)^[a-d]\\.')" if fmt == "abcd_inline" else ""
    in_range = "TRUE" if fmt in ("sol", "q_format") else f"TRY_CAST(regexp_extract(block, '{number}', 1) AS BIGINT) BETWEEN 1 AND {fixed.PAPER_LAST_NUMBER}"
    keep = {"standard": "AND (option_a <> '' OR correct_answer <> '')", "abcd_inline": "AND option_a <> ''"}.get(fmt, "")
    option = ", ".join(f"coalesce({_strip(f'''string_agg(body, ' ' ORDER BY l) FILTER (own = '{k}' AND opt = last_{k})''')}, '') AS option_{k}" for k in parse.LETTERS)
    lasts = ", ".join(f"max(CASE WHEN letter = '{k}' THEN l END) OVER (PARTITION BY id, b) AS last_{k}" for k in parse.LETTERS)
    return f"""cut_{n} AS (SELECT id, string_split({cut}, chr(1)) AS blocks FROM ({papers})),
blocks_{n} AS (SELECT id, b, {_strip('block')} AS block FROM (SELECT id, unnest(blocks) AS block, unnest(range(1, len(blocks) + 1)) AS b FROM cut_{n})),
rows_{n} AS (SELECT id, b, TRY_CAST(regexp_extract(block, '{number}', 1) AS BIGINT) AS number, unnest(string_split(block, chr(10))) AS line, unnest(range(1, len(string_split(block, chr(10))) + 1)) AS l
  FROM blocks_{n} WHERE regexp_matches(block, '{number}') AND {in_range}),
lines_{n} AS (SELECT * EXCLUDE (line), {_strip('line')} AS line FROM rows_{n}),
read_{n} AS (SELECT *, {stop} AS stop FROM lines_{n} WHERE line <> ''),
marked_{n} AS (SELECT id, b, number, l, line, {answer} AS answer, CASE WHEN {answer} <> '' THEN '' ELSE {letter} END AS letter, {body} AS body FROM read_{n} WHERE stop IS NULL OR l < stop),
state_{n} AS (SELECT *, coalesce(min(CASE WHEN {closes} THEN l END) OVER (PARTITION BY id, b), 1 << 30) AS closed,
  max(CASE WHEN letter <> '' THEN l END) OVER (PARTITION BY id, b ORDER BY l) AS opt, {lasts} FROM marked_{n}),
owned_{n} AS (SELECT s.*, CASE WHEN s.answer = '' AND (s.l = s.opt OR s.l > s.closed {loose.replace('line', 's.line')}) THEN o.letter END AS own FROM state_{n} s LEFT JOIN marked_{n} o ON o.id = s.id AND o.b = s.b AND o.l = s.opt),
got_{n} AS (SELECT id, b, any_value(number) AS number,
  coalesce({_strip(f"regexp_replace(string_agg(regexp_replace(line, '{number}', ''), ' ' ORDER BY l) FILTER (l < closed AND answer = '' AND letter = ''), '{_WHITE}+', ' ', 'g')")}, '') AS question, {option},
  coalesce(arg_max(answer, l) FILTER (answer <> ''), '') AS correct_answer FROM owned_{n} GROUP BY id, b),
found_{n} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b) - 1 AS position, count(*) OVER (PARTITION BY id) AS total FROM got_{n} WHERE length(question) > {fixed.QUESTION_LENGTH} {keep})"""


_COLUMNS = "id, position::INTEGER AS position, number, question, option_a, option_b, option_c, option_d, correct_answer"


def _papers(spark: SparkSession, sf: str, fmt: str | None = None) -> DataFrame:
    d = files.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    if fmt:
        kind, body = F.lit(fmt), _text(fmt, F.col("text"))
    else:
        kind = F.element_at(F.array(*map(F.lit, [*parse.FORMATS, "odd"])), (F.col("id") % 5 + 1).cast("int"))
        body = _text("standard", F.col("text"))
        for k, name in enumerate(parse.FORMATS[1:]):
            body = F.when(F.col("id") % 5 == k + 1, _text(name, F.col("text"))).otherwise(body)
    return d.select("id", F.lit(2020).alias("year"), kind.alias("format"), body.alias("text"))


def _register(name: str, fmt: str) -> None:
    def run(spark, sf):
        return parse.questions(_papers(spark, sf, fmt)).select("id", "position", "number", "question", *[f"option_{k}" for k in parse.LETTERS], "correct_answer")

    QUERIES[name] = run
    ORACLES[name] = f"WITH {parsed_sql(fmt, f'SELECT doc_id AS id, {_text_sql(fmt)} AS text FROM documents')} SELECT {_COLUMNS} FROM found_{fmt}"


for _name, _fmt in (("u4_parse_standard", "standard"), ("u5_parse_solutions", "sol"), ("u6_parse_q_format", "q_format"), ("u7_parse_inline", "abcd_inline")):
    _register(_name, _fmt)


def u8_parse_by_format(spark, sf):
    return parse.questions(_papers(spark, sf)).select("id", "position", "total", "number", "subject")


_BY_FORMAT = [("standard", "standard", 0), ("sol", "sol", 1), ("q_format", "q_format", 2), ("abcd_inline", "abcd_inline", 3), ("standard", "odd", 4)]
QUERIES["u8_parse_by_format"] = u8_parse_by_format
ORACLES["u8_parse_by_format"] = (
    "WITH "
    + ",\n".join(parsed_sql(fmt, f"SELECT doc_id AS id, {_text_sql(fmt)} AS text FROM documents WHERE doc_id % 5 = {k}", name) for fmt, name, k in _BY_FORMAT)
    + ",\nevery AS ("
    + " UNION ALL ".join(f"SELECT id, position, total, number, question FROM found_{name}" for _, name, _ in _BY_FORMAT)
    + f"""),
h AS (SELECT *, position / total::DOUBLE AS ratio, {_hits(fixed.BIOLOGY_WORDS)} AS b, {_hits(fixed.CHEMISTRY_WORDS)} AS c, {_hits(fixed.PHYSICS_WORDS)} AS p FROM every)
SELECT id, position::INTEGER AS position, total::INTEGER AS total, number, CASE WHEN greatest(b, c, p) = 0 THEN CASE WHEN ratio < 0.33 THEN 'Physics' WHEN ratio < 0.66 THEN 'Chemistry' ELSE 'Biology' END
WHEN b >= c AND b >= p THEN 'Biology' WHEN c >= p THEN 'Chemistry' ELSE 'Physics' END AS subject FROM h"""
)

_PLAIN = "list_transform(list_filter(string_split_regex(text, '\\.\\s+'), lambda s: length(s) > 0), lambda s, i: i::VARCHAR || '. ' || regexp_replace(s, '\\s+', ' ', 'g') || {rest} || ((i - 1) % 4 + 1)::VARCHAR || ')')"
_PLAIN = _PLAIN.format(rest=_quoted("\n(1) one\n(2) two\n(3) three\n(4) four\nAns. ("))
# the query of this name is registered beside the others
ORACLES["u4_parse_papers"] = f"""WITH {parsed_sql("standard", f"SELECT doc_id AS id, chr(10) || array_to_string({_PLAIN}, chr(10)) AS text FROM documents")},
h AS (SELECT id, position, number, question, option_a, correct_answer, position / total::DOUBLE AS ratio, {_hits(fixed.BIOLOGY_WORDS)} AS b, {_hits(fixed.CHEMISTRY_WORDS)} AS c, {_hits(fixed.PHYSICS_WORDS)} AS p FROM found_standard)
SELECT id, position::INTEGER AS position, number, question, option_a, correct_answer, CASE WHEN greatest(b, c, p) = 0 THEN CASE WHEN ratio < 0.33 THEN 'Physics' WHEN ratio < 0.66 THEN 'Chemistry' ELSE 'Biology' END
WHEN b >= c AND b >= p THEN 'Biology' WHEN c >= p THEN 'Chemistry' ELSE 'Physics' END AS subject FROM h"""


# --- list questions, statements, marks ----------------------------------------------------------


def lists_sql(source: str) -> str:
    """preamble, items_1, items_2, trailer of (doc_id, question): markers are set apart by chr(1), those behind blanks in two passes."""
    header, item, roman = fixed.LIST_HEADER.replace("(list|column)", "(?:list|column)"), "[a-hA-H]", "[ivxIVX]{1,4}"
    one, two, trailer = header.replace("(I{1,2})", "I"), header.replace("(I{1,2})", "II"), fixed.LIST_TRAILER
    dotted = f"(^|\\s)((?:{item}|[0-9]{{1,2}}|{roman})\\.)(\\s|$)"
    marked = f"regexp_replace(body, '\\(\\s*(?:{item}|{roman})\\s*\\)', chr(1) || '\\0', 'g')"
    for _ in range(2):
        marked = f"regexp_replace({marked}, '{dotted}', '\\1' || chr(1) || '\\2\\3', 'g')"
    cleaned = _strip(f"regexp_replace({_strip('x')}, '{fixed.LIST_REPEATED_HEADER}', '')")
    items = lambda kind: f"list_filter(list_transform(list_filter(string_split({marked}, chr(1)), lambda x: regexp_matches(x, '{kind}')), lambda x: {cleaned}), lambda x: x <> '')"
    first, second = f"^(?:\\(\\s*{item}\\s*\\)|(?:{item}|[0-9]{{1,2}})\\.(?:\\s|$))", f"^(?:\\(\\s*{roman}\\s*\\)|{roman}\\.(?:\\s|$))"
    return f"""WITH q AS ({source}),
h AS (SELECT *, regexp_extract(question, '(?s)^(.*){one}(.*)$', 1) AS head, regexp_extract(question, '(?s)^(.*){one}(.*)$', 2) AS rest FROM q),
c AS (SELECT *, regexp_matches(question, '{one}') AND regexp_matches(rest, '{two}') AS "both", CASE WHEN regexp_matches(rest, '{trailer}') THEN regexp_extract(rest, '(?s)^(.*?){trailer}', 1) ELSE rest END AS body FROM h),
i AS (SELECT *, substr(rest, length(body) + 1) AS trailer, {items(first)} AS a, {items(second)} AS b FROM c),
f AS (SELECT *, "both" AND len(a) > 0 AND len(a) = len(b) AS fit FROM i)
SELECT doc_id, CASE WHEN fit THEN {_strip('head')} END AS preamble, CASE WHEN fit THEN array_to_string(a, '|') END AS items_1, CASE WHEN fit THEN array_to_string(b, '|') END AS items_2, CASE WHEN fit THEN {_strip('trailer')} END AS trailer FROM f"""


def statements_sql(source: str) -> str:
    """intro, parts, trailer of (doc_id, question): pieces are rows, which belong to the last label that begins a part."""
    label, trailer = fixed.STATEMENT_LABEL, fixed.STATEMENT_TRAILER.replace("(in", "(?:in")
    return f"""WITH q AS ({source}),
p AS (SELECT doc_id, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(question, '{label}', chr(1) || '\\0', 'g'), chr(1)) AS ps FROM q)),
l AS (SELECT *, regexp_replace(lower(regexp_extract(piece, '^{label}')), '[^a-z0-9]', '', 'g') AS label FROM p),
k AS (SELECT *, label <> '' AND i = max(i) OVER (PARTITION BY doc_id, label) AS begins FROM l),
g AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS part, sum(begins::INTEGER) OVER (PARTITION BY doc_id) AS parts FROM k),
t AS (SELECT doc_id, part, parts, string_agg(piece, '' ORDER BY i) AS body, first(regexp_extract(piece, '^{label}') ORDER BY i) AS head FROM g GROUP BY 1, 2, 3),
e AS (SELECT *, CASE WHEN part = parts AND regexp_matches(substr(body, length(head) + 1), '{trailer}') THEN length(head) + length(regexp_extract(substr(body, length(head) + 1), '(?s)^(.*?){trailer}', 1)) ELSE length(body) END AS cut FROM t)
SELECT doc_id, CASE WHEN any_value(parts) >= 2 THEN coalesce({_strip("string_agg(body, '') FILTER (part = 0)")}, '') END AS intro,
CASE WHEN any_value(parts) >= 2 THEN string_agg({_strip('substr(body, 1, cut)')}, '|' ORDER BY part) FILTER (part > 0) END AS parts,
CASE WHEN any_value(parts) >= 2 THEN {_strip("any_value(substr(body, cut + 1)) FILTER (part = parts)")} END AS trailer FROM e GROUP BY doc_id"""


def boundary_sql(source: str) -> str:
    """boundary of (doc_id, text), character by character."""
    pair = "coalesce(cs[i], '') || coalesce(cs[i + 1], '')"
    step = f"""CASE WHEN s.skip THEN {{'open': s.open, 'skip': false, 'safe': CASE WHEN s.open = '' THEN i ELSE s.safe END}}
WHEN s.open IN ('', '$$') AND {pair} = '$$' THEN {{'open': CASE s.open WHEN '' THEN '$$' ELSE '' END, 'skip': true, 'safe': s.safe}}
WHEN s.open IN ('', '$') AND cs[i] = '$' THEN {{'open': CASE s.open WHEN '' THEN '$' ELSE '' END, 'skip': false, 'safe': CASE s.open WHEN '' THEN s.safe ELSE i END}}
WHEN s.open IN ('', '**') AND {pair} = '**' THEN {{'open': CASE s.open WHEN '' THEN '**' ELSE '' END, 'skip': true, 'safe': s.safe}}
ELSE {{'open': s.open, 'skip': false, 'safe': CASE WHEN s.open = '' THEN i ELSE s.safe END}} END"""
    return f"""WITH q AS (SELECT doc_id, list_filter(string_split(text, ''), lambda c: c <> '') AS cs FROM ({source}))
SELECT doc_id, list_reduce(range(1, len(cs) + 1), lambda s, i: {step}, {{'open': '', 'skip': false, 'safe': 0::BIGINT}}).safe::INTEGER AS boundary FROM q"""


def _lists(d: DataFrame, question: Column) -> DataFrame:
    got = parse.split_lists(d.select("doc_id", question.alias("question")))
    return got.select("doc_id", "lists.preamble", F.array_join("lists.items_1", "|").alias("items_1"), F.array_join("lists.items_2", "|").alias("items_2"), "lists.trailer")


def _statements(d: DataFrame, question: Column) -> DataFrame:
    got = parse.split_statements(d.select("doc_id", question.alias("question")))
    return got.select("doc_id", "statements.intro", F.array_join("statements.parts", "|").alias("parts"), "statements.trailer")


#: Layouts of list questions around a text, in turn: headers in front, one list after the other, columns of numbers, a repeated header, unequal lists, no second list.
LAYOUTS = [
    ("Match List I with List II. List I List II (A) ", " (I) x (B) y (II) z Choose the answer"),
    ("Match the lists: List-I (A) aa; (B) ", " List–II [kind]: ( i ) cc ( ii ) dd"),
    ("Column I 1. one 2. ", " Column II i. first ii. second Select one"),
    ("List I with List II: List - I a. ", " List II: (I) only; List-II: identify it"),
    ("List I List II (A) ", " (B) two (I) x"),
    ("List I alone (A) ", " (I) x"),
]
LABELS = [
    ("Given: Assertion (A): ", " Reason (R): so. Choose one"),
    ("One is labelled Assertion (A): the other Reason (R): Assertion (A): ", " Reason (R): they eat. In the light of this, choose"),
    ("Statement I: ", " Statements - 2 : y\n"),
    ("Statement a: ", " Statement A: again"),
    ("", " reason: select it"),
]


def u9_lists_in_all_layouts(spark, sf):
    d = files.table(spark, sf, "documents").withColumn("k", (F.col("doc_id") % len(LAYOUTS) + 1).cast("int"))
    before, after = (F.element_at(F.array(*[F.lit(x[i]) for x in LAYOUTS]), F.col("k")) for i in (0, 1))
    return _lists(d, F.concat(before, "text", after))


def u10_statements_of_all_kinds(spark, sf):
    d = files.table(spark, sf, "documents").withColumn("k", (F.col("doc_id") % len(LABELS) + 1).cast("int"))
    before, after = (F.element_at(F.array(*[F.lit(x[i]) for x in LABELS]), F.col("k")) for i in (0, 1))
    return _statements(d, F.concat(before, "text", after))


def u11_boundary_among_marks(spark, sf):
    d = files.table(spark, sf, "documents").select("doc_id", F.replace(F.replace(F.replace("text", F.lit("ou"), F.lit("$$")), F.lit("en"), F.lit("**")), F.lit("t"), F.lit("$")).alias("text"))
    return parse.with_boundary(d).select("doc_id", "boundary")


def _around(pairs: list[tuple[str, str]]) -> str:
    before, after = (", ".join(_quoted(x[i]) for x in pairs) for i in (0, 1))
    return f"SELECT doc_id, ([{before}])[doc_id % {len(pairs)} + 1] || text || ([{after}])[doc_id % {len(pairs)} + 1] AS question FROM documents"


QUERIES |= {f.__name__: f for f in (u9_lists_in_all_layouts, u10_statements_of_all_kinds, u11_boundary_among_marks)}
ORACLES |= {
    "u9_lists_in_all_layouts": lists_sql(_around(LAYOUTS)),
    "u10_statements_of_all_kinds": statements_sql(_around(LABELS)),
    "u11_boundary_among_marks": boundary_sql("SELECT doc_id, replace(replace(replace(text, 'ou', '$$'), 'en', '**'), 't', '$') AS text FROM documents"),
    # the queries of these names are registered beside the others
    "u9_match_lists": lists_sql("SELECT doc_id, 'Match List I with List II. List I List II (A) ' || text || ' (I) x (B) y (II) z Choose the answer' AS question FROM documents"),
    "u10_statements": statements_sql("SELECT doc_id, 'Given: Assertion (A): ' || text || ' Reason (R): so. Choose one' AS question FROM documents"),
    "u11_safe_boundary": boundary_sql("SELECT doc_id, text FROM documents"),
}
