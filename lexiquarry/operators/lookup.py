"""Joins with arrays, dictionaries, bands and keyword tables. Small tables are broadcast by Spark itself, by their size."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def members(sets: DataFrame, questions: DataFrame, ids: str = "question_ids", id: str = "id") -> DataFrame:
    """Active questions of each set; ids without a question vanish."""
    keys = [c for c in sets.columns if c != ids]
    return sets.select(*keys, F.explode(ids).alias(id)).join(questions.where("is_active"), id)


def translate(df: DataFrame, dictionary: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``out``: the dictionary's text (key, text) for the key, or the key itself."""
    return df.join(dictionary.select(F.col("key").alias(key), F.col("text").alias("_text")), key, "left").withColumn(out, F.coalesce("_text", key)).drop("_text")


#: Patterns of an automaton at most; longer tables take several, one after the other.
AUTOMATON = 100_000


def _best_match(text: Column, patterns: Sequence[str], best: Callable[[set[int]], int | None]) -> Column:
    """best(indexes of the ``patterns`` that the text contains), by one pass over each text, however many patterns there are."""
    plain = sorted({p: None for p in patterns if p})
    places: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        places.setdefault(p, []).append(i)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automata = []
        for at in range(0, len(plain), AUTOMATON):
            automata.append(ahocorasick.Automaton())
            for p in plain[at : at + AUTOMATON]:
                automata[-1].add_word(p, p)
            automata[-1].make_automaton()
        for texts in batches:
            out = []
            for t in texts:
                found = {p for a in automata for _, p in a.iter(t)} if t else set()
                out.append(best({i for p in (*found, "") for i in places.get(p, ())}))
            yield pd.Series(out, dtype="Int32")

    return F.pandas_udf(run, "int")(text)


def first_fragment(df: DataFrame, fragments: DataFrame, name: Column, id: str = "id") -> DataFrame:
    """Adds the columns of the first fragment (ordinal, fragment, ...) that a file name contains; nulls if none does.

    Case and '-' or '_' don't matter. fragments is a declared table, which goes to all tasks as an automaton; names stay in place.
    """
    rest = [c for c in fragments.columns if c not in ("ordinal", "fragment")]
    rows = fragments.where("fragment IS NOT NULL").select("ordinal", F.upper("fragment").alias("fragment"), *rest).orderBy("ordinal", *rest).collect()
    plain = F.replace(F.upper(F.coalesce(name, F.lit(""))), F.lit("-"), F.lit("_"))
    # a null name contains nothing, not even an empty fragment
    at = F.when(name.isNotNull(), _best_match(plain, [r.fragment for r in rows], lambda found: min(found, default=None)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fragments.schema.fields if f.name in rest)
    table = df.sparkSession.createDataFrame([(i, *[r[c] for c in rest]) for i, r in enumerate(rows)], f"_at int, {kinds}")
    return df.withColumn("_at", at).join(table, "_at", "left").drop("_at")


def keyword_class(df: DataFrame, keywords: DataFrame, text: str = "question", id: str = "id", only: Column | None = None) -> DataFrame:
    """Adds chapter: of the keyword table's (ordinal, chapter, keyword) chapters, that with most keywords contained in any case; the first at ties, null without any.

    The table is declared and goes to all tasks as an automaton, so a text is read once, whatever the number of keywords, and stays in place.
    A keyword that a chapter has twice counts twice. ``only`` restricts the tagging to some rows, such as the untagged.
    """
    rows = keywords.where("keyword IS NOT NULL").select("ordinal", "chapter", F.lower("keyword").alias("word")).collect()
    first: dict[str, int] = {}
    for r in rows:
        first[r.chapter] = min(first.get(r.chapter, r.ordinal), r.ordinal)
    chapters = sorted(first, key=lambda c: (first[c], c))
    number = {c: i for i, c in enumerate(chapters)}
    owner = [number[r.chapter] for r in rows]

    def best(found: set[int]) -> int | None:
        hits = Counter(owner[i] for i in found)
        return min(hits, key=lambda c: (-hits[c], c)) if hits else None

    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    at = _best_match(low, [r.word for r in rows], best)
    table = df.sparkSession.createDataFrame(list(enumerate(chapters)), "_at int, tagged_chapter string")
    return df.withColumn("_at", at if only is None else F.when(only, at)).join(table, "_at", "left").drop("_at")


def recurring(images: DataFrame, page: str = "page", xref: str = "xref") -> DataFrame:
    """Images on more than one page."""
    return images.groupBy(xref).agg(F.count_distinct(page).alias("pages")).where("pages > 1")


def latest_of(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")
