"""Exam papers and list questions, taken apart by folds and other higher-order functions; all runs in the JVM.

The patterns are fixed values; white space counts in all of Unicode, as for the producers of such texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import collapse, strip, subject_of, trimmed, without_noise

FORMATS = tuple(fixed.PAPER_BEGIN)
LETTERS = ("a", "b", "c", "d")
#: Answer patterns of two formats that match whole words only; the fixed ones, for ``compat``, also match inside words.
WHOLE_ANSWER = {"sol": r"(?i)\b(?:Ans(?:wer)?|Sol)\s*[.:]?\s*[\(\[]?\b([1-4abcd])\b", "abcd_inline": r"(?i)\bAns(?:wer)?\b\s*[.:]?\s*\b([a-d])\b"}
_NONE = "cast(array() as array<string>)"


def _unicode(pattern: str) -> str:
    return "(?U)" + pattern


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _marked(line: Column, answer: Column, fmt: str) -> Column:
    """What a line is by itself: an answer, an option with its letter and text, or neither.

    Options begin with a digit 1 to 4 in brackets or, but for one format, a letter a to d and a dot; in the inline format white space must follow that.
    """
    head, second = F.substring(line, 1, 1), F.substring(line, 2, 1)
    first = F.translate(head, "ABCD", "abcd")
    digit = (head == "(") & (F.substring(line, 3, 1) == ")") & second.isin("1", "2", "3", "4")
    dotted = (second == ".") & first.isin(*LETTERS)
    spaced = (trimmed(F.substring(line, 3, 1)) == "") if fmt == "abcd_inline" else F.lit(True)
    none = F.lit("")

    def kind(letter: Column, body: Column, loose: bool) -> Column:
        letter = F.when(answer == "", letter).otherwise(none) if letter is not none else none
        return F.struct(answer.alias("answer"), letter.alias("letter"), body.alias("body"), line.alias("line"), F.lit(loose).alias("loose"))

    from_digit = kind(none if fmt == "abcd_inline" else F.translate(second, "1234", "abcd"), trimmed(F.substring(line, F.lit(4), F.length(line))), True)
    # of the inline format a line that begins like an option, but isn't one, never goes on with an option
    letter = none if fmt == "q_format" else F.when(spaced, first).otherwise(none)
    from_dot = kind(letter, trimmed(F.substring(line, F.lit(3), F.length(line))), fmt != "abcd_inline")
    # most lines are of neither kind, so the kinds are told apart once
    return F.when(digit, from_digit).when(dotted, from_dot).otherwise(kind(none, F.lit(None).cast("string"), True))


def _answer(line: Column, fmt: str, compat: bool) -> Column:
    pattern = fixed.PAPER_ANSWER[fmt] if compat else WHOLE_ANSWER.get(fmt, fixed.PAPER_ANSWER[fmt])
    # most lines have none, which a plain look at them tells
    found = F.when(line.rlike("(?iu)ans|sol"), F.regexp_extract(line, _unicode(pattern), 1)).otherwise("")
    return {"q_format": F.translate(found, "1234", "abcd"), "abcd_inline": F.lower(found)}.get(fmt, found)


def _question(block: Column, fmt: str, compat: bool) -> Column:
    """A fold over the lines of a block: whether the question's text still goes on, the option that is open, and the texts of all."""
    lines = F.filter(F.transform(F.split(block, "\n"), trimmed), lambda x: x != "")
    if fmt in fixed.PAPER_STOP:

        def read(all: Column) -> Column:
            # slice() takes what stands before the first line that stops
            stop = F.array_position(F.transform(all, lambda x: x.rlike(_unicode(fixed.PAPER_STOP[fmt]))), True)
            return _bound(stop, lambda at: F.when(at > 0, F.slice(all, F.lit(1), (at - 1).cast("int"))).otherwise(all))

        lines = _bound(lines, read)
    zero = F.struct(F.lit(True).alias("open"), F.lit("").alias("option"), F.lit("").alias("answer"), *[F.expr(_NONE).alias(k) for k in ("text", *LETTERS)])

    def step(acc: Column, x: Column) -> Column:
        def state(**changed: Column) -> Column:
            return F.struct(*[changed.get(k, acc[k]).alias(k) for k in ("open", "option", "answer", "text", *LETTERS)])

        bare = F.when(x["line"].rlike(r"(?U)^\d|^Q"), F.regexp_replace(x["line"], _unicode(fixed.PAPER_NUMBER[fmt]), "")).otherwise(x["line"])
        begun = {k: F.when(x["letter"] == k, F.array(x["body"])).otherwise(acc[k]) for k in LETTERS}
        longer = {k: F.when(acc["option"] == k, F.concat(acc[k], F.array(x["line"]))).otherwise(acc[k]) for k in LETTERS}
        answered = {"answer": x["answer"]} | ({} if fmt == "abcd_inline" else {"open": F.lit(False)})
        # a line has one kind, so only what that changes is worked out
        return (
            F.when(x["letter"] != "", state(open=F.lit(False), option=x["letter"], **begun))
            .when(x["answer"] != "", state(**answered))
            .when(acc["open"], state(text=F.concat(acc["text"], F.array(bare))))
            .when((acc["option"] != "") & x["loose"], state(**longer))
            .otherwise(acc)
        )

    def done(acc: Column) -> Column:
        number = F.regexp_extract(block, _unicode(fixed.PAPER_NUMBER[fmt]), 1).try_cast("bigint")
        # what was joined has no white space at its ends but joining blanks
        options = [F.trim(F.array_join(acc[k], " ")).alias(f"option_{k}") for k in LETTERS]
        return F.struct(number.alias("number"), F.trim(collapse(F.array_join(acc["text"], " "))).alias("question"), *options, acc["answer"].alias("correct_answer"))

    answered = F.transform(lines, lambda x: F.struct(x.alias("line"), _answer(x, fmt, compat).alias("answer")))
    return F.aggregate(F.transform(answered, lambda x: _marked(x["line"], x["answer"], fmt)), zero, step, done)


def _kept(q: Column, fmt: str) -> Column:
    long = F.length(q["question"]) > fixed.QUESTION_LENGTH
    if fmt == "standard":
        return long & ((q["option_a"] != "") | (q["correct_answer"] != ""))
    return long & (q["option_a"] != "") if fmt == "abcd_inline" else long


def paper(text: Column, fmt: str, compat: bool = False) -> Column:
    """Questions of a paper of one format, as an array of (number, question, option_a to option_d, correct_answer).

    Blocks without a number or, in the standard and inline formats, of numbers outside 1 to 200, questions of 20 characters or fewer, and those without
    an option a (standard: or an answer) are left out. A number too great for a long is null. Null and empty texts have none.
    """
    blocks = F.transform(F.split(F.coalesce(text, F.lit("")), _unicode(fixed.PAPER_BEGIN[fmt])), trimmed)

    def numbered(block: Column) -> Column:
        if fmt in ("sol", "q_format"):
            return block.rlike(_unicode(fixed.PAPER_NUMBER[fmt]))
        return F.coalesce(F.regexp_extract(block, _unicode(fixed.PAPER_NUMBER[fmt]), 1).try_cast("bigint").between(1, fixed.PAPER_LAST_NUMBER), F.lit(False))

    return F.filter(F.transform(F.filter(blocks, numbered), lambda b: _question(b, fmt, compat)), lambda q: _kept(q, fmt))


def questions(papers: DataFrame, compat: bool = False, text: str = "text", fmt: str = "format") -> DataFrame:
    """One row for each question of each paper (id, text, format, year): id, year, position (from 0), total, the question's columns and its subject.

    Unknown formats are read as 'standard'. Noise of the pages goes first. A paper is one row from its text to its questions, so nothing is shuffled.
    """
    clean = papers.select("id", "year", F.col(fmt).alias("format"), without_noise(F.col(text)).alias("text"))
    found = paper(F.col("text"), "standard", compat)
    for kind in FORMATS[1:]:
        found = F.when(F.col("format") == kind, paper(F.col("text"), kind, compat)).otherwise(found)
    # the outer form keeps Spark from working the questions out once more to filter papers that have none
    each = clean.select("id", "year", found.alias("found")).select("id", "year", F.size("found").alias("total"), F.posexplode_outer("found").alias("position", "q"))
    return each.where("q IS NOT NULL").select("id", "year", "position", "total", "q.*").withColumn("subject", subject_of(F.col("question"), F.col("position"), F.col("total")))


_ITEM_STARTS = r"(?=\(\s*(?:[a-hA-H]|[ivxIVX]{1,4})\s*\))|(?<!\S)(?=(?:[a-hA-H]|[0-9]{1,2}|[ivxIVX]{1,4})\.(?:\s|$))"
_FIRST_KIND, _SECOND_KIND = (rf"^(?:\(\s*{x}\s*\)|{y}\.(?:\s|$))" for x, y in (("[a-hA-H]", "(?:[a-hA-H]|[0-9]{1,2})"), ("[ivxIVX]{1,4}", "[ivxIVX]{1,4}")))


def _before(text: Column, pattern: str, start: Column | int = 1) -> tuple[Column, Column]:
    """``text`` before the first match of ``pattern`` at or after ``start``, and stripped from it on (empty without a match)."""
    rest = F.substring(text, start, F.length(text)) if not isinstance(start, int) else text
    at = F.regexp_instr(rest, F.lit(pattern)) + (start - 1 if not isinstance(start, int) else 0)
    some = F.regexp_instr(rest, F.lit(pattern)) > 0
    return F.when(some, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(some, strip(F.substring(text, at, F.length(text)))).otherwise("")


def split_lists(df: DataFrame, text: str = "question") -> DataFrame:
    """Adds lists: (preamble, items_1, items_2, trailer) of a match-the-lists question; null fields for other texts.

    The items begin behind the last header of list I that a header of list II follows at some distance: both lists may have their headers in front, or each before its own items.
    Letters and numbers belong to list I, roman numerals to list II, in whatever order they come. A header that is
    left at an item's end goes; a closing request ("choose ...") is the trailer. Lists of different lengths give nulls.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    one, two = (fixed.LIST_HEADER.replace("(I{1,2})", x) for x in ("I", "II"))
    last = r"(?s)^(.*)" + one.replace("(list|column)", "(?:list|column)") + "(.*)$"
    parts = df.withColumn("_head", F.regexp_extract(whole, _unicode(last), 1)).withColumn("_body", F.regexp_extract(whole, _unicode(last), 2))
    some = whole.rlike(_unicode(one)) & F.col("_body").rlike(_unicode(two))
    body, trailer = _before(F.col("_body"), _unicode(fixed.LIST_TRAILER))

    def items(kind: str) -> Column:
        cleaned = F.transform(F.filter(F.split(body, _unicode(_ITEM_STARTS)), lambda x: x.rlike(_unicode(kind))), lambda x: strip(F.regexp_replace(strip(x), _unicode(fixed.LIST_REPEATED_HEADER), "")))
        return F.filter(cleaned, lambda x: x != "")

    parts = parts.withColumns({"_first": items(_FIRST_KIND), "_second": items(_SECOND_KIND), "_trailer": trailer})
    fit = some & (F.size("_first") > 0) & (F.size("_first") == F.size("_second"))
    fields = {"preamble": strip(F.col("_head")), "items_1": F.col("_first"), "items_2": F.col("_second"), "trailer": F.col("_trailer")}
    return parts.withColumn("lists", F.struct(*[F.when(fit, c).alias(k) for k, c in fields.items()])).drop("_head", "_body", "_first", "_second", "_trailer")


def split_statements(df: DataFrame, text: str = "question") -> DataFrame:
    """Adds statements: (intro, parts, trailer) of an assertion-and-reason question; null fields with fewer than two different labels.

    Of a label that repeats, the last one begins a part; the earlier ones stay in what stands before.
    """
    # a pattern that looks ahead splits before each label and takes nothing away
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), _unicode(f"(?={fixed.STATEMENT_LABEL})"))
    label = lambda x: F.regexp_replace(F.lower(F.regexp_extract(x, _unicode("^" + fixed.STATEMENT_LABEL), 0)), "[^a-z0-9]", "")
    split = df.withColumn("_pieces", pieces).withColumn("_labels", F.transform("_pieces", label))
    last = F.filter(F.sequence(F.lit(1), F.size("_pieces")), lambda i: (F.element_at("_labels", i) != "") & (F.array_position(F.slice("_labels", i + 1, F.size("_labels")), F.element_at("_labels", i)) == 0))
    split = split.withColumn("_last", last)
    joined = lambda a, b: F.array_join(F.slice("_pieces", a, b - a), "")
    ends = F.concat(F.slice("_last", 2, F.size("_pieces")), F.array(F.size("_pieces") + 1))
    parts = F.transform("_last", lambda a, i: joined(a, F.get(ends, i)))
    split = split.withColumn("_parts", F.when(F.size("_last") >= 2, parts))
    final = F.element_at("_parts", -1)
    body, trailer = _before(final, _unicode(fixed.STATEMENT_TRAILER), F.length(F.regexp_extract(final, _unicode("^" + fixed.STATEMENT_LABEL), 0)) + 1)
    all_parts = F.transform(F.concat(F.slice("_parts", F.lit(1), F.size("_parts") - 1), F.array(body)), strip)
    some = F.col("_parts").isNotNull()
    fields = {"intro": strip(joined(F.lit(1), F.get("_last", F.lit(0)))), "parts": all_parts, "trailer": trailer}
    return split.withColumn("statements", F.struct(*[F.when(some, c).alias(k) for k, c in fields.items()])).drop("_pieces", "_labels", "_last", "_parts")


#: Plain characters and closed marks, as many as there are, without going back.
_SAFE = r"(?s)^(?:[^$*]++|\$\$.*?\$\$|\$(?!\$)[^$]*+\$|\*\*.*?\*\*|\*(?!\*))*+"


def with_boundary(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds boundary: length of the longest prefix that leaves no ``$$``, ``$`` or ``**`` open; what stands between two marks opens nothing."""
    return df.withColumn("boundary", F.length(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), _SAFE, 0)))
