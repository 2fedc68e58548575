"""Licence scan with a positional index of rare words, in DataFrame functions only.

Each licence template has a mandatory key phrase. The two words of the phrase that are rarest over all documents (highest
IDF) are its index entries, with their places in the template. A file looks its words up in that index; two entries that
agree on where the template would start make a candidate, and the whole phrase is then verified word by word. Everything
but the word counts happens inside a row, so nothing is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.llm.common import documents


@dataclass(frozen=True)
class Template:
    """``key`` is the mandatory phrase; it stands in ``text``. Base templates count towards the base columns."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrase(self) -> list[str]:
        return self.key.split()

    @property
    def start(self) -> int:
        """Where the phrase stands in the text."""
        words, phrase = self.words, self.phrase
        return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


# fixed values: the phrases and labels every scan reports
BASE = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
)
# fixed values: openings of public licence notices, words in lower case without marks
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0 the license", "apache license version 2"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("epl", "eclipse public license v 2 0", "eclipse public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by", "creative commons attribution 4 0 international", "creative commons attribution 4 0"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages"),
)
#: Separators of words: all of ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The one letter outside ASCII whose lower case is in it; it is put out of the way before lower().
KELVIN = "K"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case. Letters outside ASCII may change case, which no ASCII word can match."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("ĸ")))
    return F.filter(F.split(plain, SEPARATORS), lambda w: w != "")


def word_idf(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> dict[str, float]:
    """IDF of the templates' key words over all documents; a word that no document has counts as rarest."""
    wanted = sorted({w for t in templates for w in t.phrase})
    held = F.array_distinct(F.filter(words_of(F.col(text_col)), lambda w: w.isin(wanted)))
    # one more row stands for the number of documents; the result has as many rows as there are key words
    counted = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = {r["word"]: r["n"] for r in counted.collect()}
    total = counts.pop("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in wanted}


def _entries(template: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The two rarest words of the key phrase with their places in the template; equal ones in order of the phrase."""
    rarest = sorted(range(len(template.phrase)), key=lambda i: (-idf[template.phrase[i]], i))[:2]
    return [(template.phrase[i], template.start + i) for i in rarest]


def _starts(template: Template, entries: list[tuple[str, int]]) -> Column:
    """Where the template starts, by relative position: places that both entries agree on and the phrase confirms."""

    def places(word: str, at: int) -> Column:
        return F.transform(F.filter("_hits", lambda h: h["w"] == word), lambda h: h["i"] - at)

    agreed = F.array_intersect(*[places(w, at) for w, at in entries]) if len(entries) > 1 else places(*entries[0])
    phrase = F.array(*[F.lit(w) for w in template.phrase])
    return F.filter(agreed, lambda s: F.slice("_words", s + template.start + 1, len(template.phrase)) == phrase)


def _found(template: Template, starts: Column) -> Column:
    return F.transform(
        starts,
        lambda s: F.struct(F.lit(template.label).alias("label"), F.lit(template.base).alias("base"), (s + template.start).cast("long").alias("start")),
    )


def _share(template: Template, starts: Column) -> Column:
    """The largest share of the template's words that stand in their places."""
    words = template.words

    def matched(s: Column) -> Column:
        same = sum(F.when(F.get("_words", s + i) == w, 1).otherwise(0) for i, w in enumerate(words))
        return same.cast("double") / len(words)

    return F.coalesce(F.array_max(F.transform(starts, matched)), F.lit(0.0))


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, found (array of label, base, start of phrase, for every verified place)
    and score, the best share of a template's words in place (0 where no key phrase stands).

    Null text counts as empty and has no words. Repeated rows are scanned each for itself; an empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    idf = word_idf(docs, templates, text_col)
    entries = [_entries(t, idf) for t in templates]
    indexed = sorted({w for e in entries for w, _ in e})
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("_words"))
    numbered = F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    none = F.array().cast("array<struct<w:string,i:int>>")
    hits = F.when(F.exists("_words", lambda w: w.isin(indexed)), F.filter(numbered, lambda h: h["w"].isin(indexed))).otherwise(none)
    rows = rows.select("id", "_words", F.size("_words").cast("long").alias("n_words"), hits.alias("_hits"))
    nothing = F.array().cast("array<int>")
    some = F.size("_hits") > 0
    rows = rows.select("*", *[F.when(some, _starts(t, e)).otherwise(nothing).alias(f"_at{n}") for n, (t, e) in enumerate(zip(templates, entries, strict=True))])
    found = F.concat(*[_found(t, F.col(f"_at{n}")) for n, t in enumerate(templates)])
    score = F.greatest(*[F.when(F.size(f"_at{n}") > 0, _share(t, F.col(f"_at{n}"))).otherwise(0.0) for n, t in enumerate(templates)])
    return rows.select("id", "n_words", found.alias("found"), F.when(some, score).otherwise(0.0).alias("score"))


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")


def op10_rare_token_index(spark, sf_dir: str) -> DataFrame:
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform("_base", lambda f: f["start"])
    return (
        scan(documents(spark, sf_dir))
        .withColumn("_base", base)
        .select(
            F.col("id").alias("doc_id"),
            "n_words",
            F.size("_base").cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            _labels(F.col("_base")).alias("base_labels"),
            _labels(F.col("found")).alias("labels"),
            "score",
        )
    )
