"""License scan: positional index of rare template words, verified by key phrases.

Everything runs inside each row with built-in functions: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortide.llm.words import positions, words, words_sql


@dataclass(frozen=True)
class Template:
    """Words of a notice; its first ``key`` words are the mandatory phrase."""

    label: str
    text: str
    key: int
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


# Phrases and labels that results must carry, then notices in common use.
BASE = (
    Template("cc-by", "cc by", 2, True),
    Template("gpl", "general public license", 3, True),
    Template("reserved", "all rights reserved", 3, True),
)
OWN = (
    Template("agpl", "affero general public license", 4),
    Template("apache", "apache license version 2 0", 2),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", 8),
    Template("cc", "creative commons attribution 4 0 international license", 2),
    Template("cc-by-nc", "cc by nc 4 0", 3),
    Template("cc-by-nd", "cc by nd 4 0", 3),
    Template("cc-by-sa", "cc by sa 4 0", 3),
    Template("cc0", "cc0 1 0 universal", 3),
    Template("lgpl", "lesser general public license", 4),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", 4),
    Template("mit", "mit license", 2),
    Template("mpl", "mozilla public license version 2 0", 3),
    Template("spdx", "spdx license identifier", 3),
    Template("unlicense", "free and unencumbered software released into the public domain", 4),
)
TEMPLATES = BASE + OWN


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> dict[str, int]:
    """Over all documents, how many hold each template word (as many rows as template words)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = docs.select(
        F.explode(F.array_distinct(F.filter(words(F.col(text)), lambda w: w.isin(vocabulary)))).alias("word")
    )
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def rare_index(templates: tuple[Template, ...], frequency: dict[str, int]) -> list[tuple[str, int, int]]:
    """Postings (word, template, place) of each template's rarest word: the one of highest IDF
    within its mandatory phrase, the first of equals."""
    out = []
    for number, t in enumerate(templates):
        place = min(range(t.key), key=lambda j: (frequency.get(t.words[j], 0), j))
        out.append((t.words[place], number, place))
    return out


def _at(w: Column, place: Column) -> Column:
    return F.get(w, place)


def _holds(w: Column, start: Column, t: Template) -> Column:
    same = F.lit(True)
    for j in range(t.key):
        same = same & F.coalesce(_at(w, start + j) == t.words[j], F.lit(False))
    return same


def _share(w: Column, start: Column, t: Template) -> Column:
    """Part of the template's words that stand at their places."""
    n = F.lit(0)
    for j, word in enumerate(t.words):
        n = n + F.when(_at(w, start + j) == word, 1).otherwise(0)
    return n / len(t.words)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """Add to every row ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels``, ``score`` and ``matches`` (label, start, share, base).

    A place counts when all words of the mandatory phrase stand there; ``score`` is the best share of
    a template's words at a place, 0 without one.  Null or empty texts have no words; rows are
    handled one by one, so ties, copies and an empty table need no rule.  Columns of those names in
    the input are replaced.
    """
    postings = rare_index(templates, document_frequencies(docs, templates, text))
    anchors = sorted({word for word, _, _ in postings})
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    rows = docs.drop(*own).withColumn("_w", words(F.col(text)))
    rows = rows.withColumn("n_words", F.size("_w"))
    w = F.col("_w")
    # places of anchor words: few, as these are the rarest words of the templates
    rows = rows.withColumn("_at", F.filter(positions(F.col("n_words")), lambda i: _at(w, i).isin(anchors)))

    def places(word: str, t: Template, place: int) -> Column:
        starts = F.transform(F.filter("_at", lambda i: _at(w, i) == word), lambda i: i - place)
        return F.transform(
            F.filter(starts, lambda s: (s >= 0) & _holds(w, s, t)),
            lambda s: F.struct(
                F.lit(t.label).alias("label"),
                s.alias("start"),
                _share(w, s, t).alias("share"),
                F.lit(t.base).alias("base"),
            ),
        )

    found = [places(word, templates[number], place) for word, number, place in postings]
    none = F.array().cast("array<struct<label:string,start:int,share:double,base:boolean>>")
    rows = rows.withColumn("matches", F.when(F.size("_at") > 0, F.concat(*found)).otherwise(none))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")

    return rows.withColumns(
        {
            "n_words": F.col("n_words").cast("long"),
            "n_base": F.size(base).cast("long"),
            "first_word": F.array_min(starts).cast("long"),
            "last_word": F.array_max(starts).cast("long"),
            "base_labels": labels(base),
            "labels": labels(F.col("matches")),
            "score": F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)),
        }
    ).drop("_w", "_at")


def scan_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same in DuckDB's SQL, without an index: every place is tried for every template."""

    def starts(t: Template) -> str:
        same = " and ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(t.words[: t.key]))
        return f"list_filter(range(len(w)), lambda i: coalesce({same}, false))"

    def share(t: Template) -> str:
        return " + ".join(f"(case when w[i + {j + 1}] = '{x}' then 1 else 0 end)" for j, x in enumerate(t.words))

    parts = [
        f"list_transform({starts(t)}, lambda i: {{'label': '{t.label}', 'start': i, "
        f"'share': ({share(t)}) / {float(len(t.words))}::double, 'base': {str(t.base).lower()}}})"
        for t in templates
    ]
    return f"""
with d as (select doc_id, {words_sql("text")} as w from documents),
m as (select doc_id, len(w) as n_words, flatten([{", ".join(parts)}]) as matches from d),
b as (select *, list_filter(matches, lambda x: x.base) as base from m)
select doc_id, n_words::bigint as n_words, len(base)::bigint as n_base,
       list_min(list_transform(base, lambda x: x.start))::bigint as first_word,
       list_max(list_transform(base, lambda x: x.start))::bigint as last_word,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label))), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(matches, lambda x: x.label))), ','), '') as labels,
       coalesce(list_max(list_transform(matches, lambda x: x.share)), 0.0)::double as score
from b
"""
