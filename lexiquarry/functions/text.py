"""Column functions on text; all run in the JVM."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: What ``str.strip`` and ``str.split`` of the data's producers take as white space, no-break space among it.
_SPACE = r"(?U)\s+"


def blank(c: Column) -> Column:
    """Null or empty, not white space."""
    return c.isNull() | (c == "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: All characters that Unicode calls white space.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """``strip`` by looking at the ends alone."""
    return F.btrim(c, F.lit(_BLANKS))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(c, _SPACE, " ")


def words(c: Column) -> Column:
    """Words between white space; an empty array for null and blank texts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), _SPACE), lambda w: w != "")


def token_set(c: Column, stopwords: Sequence[str] = fixed.STOPWORDS) -> Column:
    """Distinct lower-case [a-z0-9] words of more than one character that are no stop word."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " ")
    # array_except() keeps each word once
    return F.array_except(F.filter(parts, lambda w: F.length(w) > 1), F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.expr("cast(array() as array<string>)"))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two token sets; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def joined(*parts: Column) -> Column:
    """The parts that are neither null nor empty, joined by blanks."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def hits(c: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords the text contains, in any case."""
    # a plain sum, so that the lower-case text is made once
    low = F.lower(F.coalesce(c, F.lit("")))
    return functools.reduce(operator.add, [F.contains(low, F.lit(k.lower())).cast("int") for k in keywords], F.lit(0))


def subject_of(c: Column, position: Column, total: Column) -> Column:
    """Subject with most keywords; biology, then chemistry, wins ties; without any, the place in the paper decides."""
    bio, chem, phys = (hits(c, k) for k in (fixed.BIOLOGY_WORDS, fixed.CHEMISTRY_WORDS, fixed.PHYSICS_WORDS))
    ratio = position / total
    return (
        F.when(F.greatest(bio, chem, phys) == 0, F.when(ratio < 0.33, "Physics").when(ratio < 0.66, "Chemistry").otherwise("Biology"))
        .when((bio >= chem) & (bio >= phys), "Biology")
        .when(chem >= phys, "Chemistry")
        .otherwise("Physics")
    )


def subject_of_file(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("bo"), "Biology").when(low.contains("ch"), "Chemistry").when(low.contains("ph"), "Physics").otherwise("Biology")


def class_of_file(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.startswith("le"), 12).when(low.startswith("ke"), 11).otherwise(11)


def normal_answer(c: Column) -> Column:
    """Answers of all encodings as a letter: trimmed, lower-case, 1-4 as a-d."""
    return F.translate(F.lower(F.trim(c)), "1234", "abcd")


_ANSWER = r"(?i)Ans\.\s*\[(\d)\]"


def embedded_answer(c: Column) -> Column:
    """Letter of an answer marker inside an option; null without one, or where the digit is none of 1-4."""
    digit = F.regexp_extract(F.coalesce(c, F.lit("")), _ANSWER, 1)
    return F.when(digit.isin("1", "2", "3", "4"), F.translate(digit, "1234", "abcd"))


def without_answer(c: Column) -> Column:
    """The option without its markers; untouched where it has none."""
    return F.when(F.coalesce(c, F.lit("")).rlike(_ANSWER), strip(F.regexp_replace(c, r"\s*Ans\.\s*\[\d\]", ""))).otherwise(c)


def without_noise(c: Column) -> Column:
    for pattern in fixed.PAGE_NOISE:
        c = F.regexp_replace(c, pattern, "")
    return c


def garbled(c: Column, least: int = 40, ratio: float = 0.3) -> Column:
    """Too short, or too few letters and digits, once stripped."""
    text = strip(F.coalesce(c, F.lit("")))
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return (F.length(text) < least) | (alnum < ratio * F.length(text))


def key_of(c: Column) -> Column:
    """SHA-256 of a text, in hex."""
    return F.sha2(c, 256)


def local_date(ts: Column) -> Column:
    """Date of a UTC time at +05:30."""
    return F.to_date(ts + F.expr("INTERVAL 330 MINUTES"))


def first_address(c: Column) -> Column:
    return F.trim(F.get(F.split(c, ","), F.lit(0)))


def is_phone(c: Column) -> Column:
    return c.rlike(r"^\+[0-9]{7,}$")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def local_digits(c: Column, exempt: Column | None = None) -> Column:
    out = F.translate(c, fixed.DIGITS, fixed.DEVANAGARI)
    return out if exempt is None else F.when(exempt, c).otherwise(out)


def is_complex(c: Column) -> Column:
    return (hits(c, fixed.COMPLEX_WORDS) > 0) | (F.size(words(c)) > fixed.COMPLEX_LENGTH)


def escape_html(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_tail(c: Column) -> Column:
    """The open end of a text that is still being written: escaped, with its line ends kept."""
    return F.replace(escape_html(c), F.lit("\n"), F.lit("<br>"))


def without_fences(c: Column) -> Column:
    """JSON text without the code fences around it."""
    return strip(F.regexp_replace(c, r"```(?:json)?", ""))


def preview(c: Column, n: int = 90) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def extension(name: Column, default: str = "png") -> Column:
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise(default)


def chat_role(c: Column) -> Column:
    return F.when(c == "user", "user").otherwise("assistant")


def option_shown(text: Column, image: Column) -> Column:
    return ~blank(text) | ~blank(image)


def is_correct_option(letter: str, answer: Column) -> Column:
    return F.coalesce(F.lower(F.trim(answer)) == letter, F.lit(False))
