"""Licence scan by a positional index of rare words.

A template is a passage of a licence text, or a licence's name, with a label and a key phrase that must stand in it word for
word. How many documents hold each licence word is counted over the whole corpus; the positional index keeps the positions
of each template's RARE rarest words (its highest IDF). For each document and template the ANCHORS rarest of these words
that the document holds are looked up, and their positions, less those in the template, are intersected: where two words
agree, the template may stand. Each such place is then compared word by word: its share is the IDF weight of the words in
place. The label counts if the key phrase stands in place and the share is at least SHARE, so a passage may differ in
some words, or break off. Base phrases are counted apart, by the same intersection of all of their words' positions.

Only DataFrame functions are used, and nothing but the vocabulary's document counts is shuffled. The index and the vocabulary
are of fixed size. Documents that hold no two indexed words of any template are done after one pass over their words.

Cases: null text counts as empty: no words, no places, score 0. Texts of any length are read whole, and every place
counts. Of equally rare words the first in order is the rarer one. Repeated rows give equal results, empty tables empty ones. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE, ANCHORS, SHARE = 8, 4, 0.4
#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Passages of licences as their publishers word them, (label, passage, key phrase).
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistribution and use in source and binary forms"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "free and unencumbered software released into the public domain"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying documentation covered by this license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license which accompanies this distribution and is available at", "eclipse public license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
]
#: Names that stand for a licence by themselves: (label, name).
NAMES = [
    ("mit", "mit license"),
    ("apache-2.0", "apache license version 2 0"),
    ("mpl", "mozilla public license"),
    ("lgpl", "lesser general public license"),
    ("agpl", "affero general public license"),
    ("gpl-2", "general public license version 2"),
    ("gpl-3", "general public license version 3"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc0", "cc0 1 0 universal"),
    ("cc-by", "creative commons attribution"),
    ("epl", "eclipse public license"),
    ("boost", "boost software license"),
]
TEMPLATES = [*PASSAGES, *((label, name, name) for label, name in NAMES)]
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_INDEX = "array<struct<label:string,words:array<string>,weights:array<double>,must:array<int>,rare:array<struct<w:string,at:array<int>>>>>"


def words_of(text: Column) -> Column:
    """The words, A-Z lower-cased. The Kelvin sign is set aside first: it is the one other character whose lower case is ASCII."""
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("�")))
    return F.array_remove(F.split(lower, DELIMITERS), "")


def document_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word of the vocabulary, over the whole table."""
    held = docs.select(F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, vocabulary))).alias("held"))
    rows = held.select(F.explode(F.concat(F.array(F.lit("")), F.col("held"))).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in rows}
    return found.pop("", 0), found


def key_places(words: list[str], key: list[str]) -> list[int]:
    """Positions of the first occurrence of a key phrase in a template."""
    start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    return list(range(start, start + len(key)))


def build_index(templates: list[tuple[str, str, str]], n_docs: int, counts: dict[str, int]) -> list[dict]:
    """The positional index: words, weights (they add up to 1), key phrase and rare words of each template."""
    out = []
    for label, passage, key in templates:
        words = passage.split(" ")
        idf = [math.log((1 + n_docs) / (1 + counts.get(w, 0))) + 1 for w in words]
        rare = sorted({*words}, key=lambda w: (counts.get(w, 0), w))[:RARE]
        out.append({"label": label, "words": words, "weights": [x / sum(idf) for x in idf], "must": key_places(words, key.split(" ")), "rare": [{"w": w, "at": [i for i, x in enumerate(words) if x == w]} for w in rare]})
    return out


def _let(value: Column, use) -> Column:
    """use(value), with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _postings(words: Column, vocabulary: list[str]) -> Column:
    """Word to its positions, for the words of the vocabulary that are there."""
    known = F.array(*map(F.lit, vocabulary))
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda h: F.array_contains(known, h["w"]))
    held = F.array_intersect(words, known)
    return _let(hits, lambda hs: F.map_from_entries(F.transform(held, lambda w: F.struct(w, F.transform(F.filter(hs, lambda h: h["w"] == w), lambda h: h["at"])))))


def _base_places(words: Column) -> Column:
    """(label, at) of every place of a base phrase: its words' positions, less their place in the phrase, intersected."""
    phrases = [(p.split(" "), label) for p, label in BASE.items()]
    vocabulary = sorted({w for p, _ in phrases for w in p})
    none = F.array().cast("array<int>")

    def shifted(posted: Column, word: str, offset: int) -> Column:
        return F.coalesce(F.transform(F.try_element_at(posted, F.lit(word)), lambda x: x - offset), none)

    def places(posted: Column, phrase: list[str], label: str) -> Column:
        starts = reduce(F.array_intersect, [shifted(posted, w, j) for j, w in enumerate(phrase)])
        return F.transform(starts, lambda at: F.struct(F.lit(label).alias("label"), at.alias("at")))

    def all_places(posted: Column) -> Column:
        return F.concat(*[places(posted, p, label) for p, label in phrases])

    return _let(_postings(words, vocabulary), all_places)


def _template_finds(words: Column, index: list[dict]) -> Column:
    """(label, share, whole) of each template that two anchors agree on; whole: the key phrase is in place."""
    literal = F.from_json(F.lit(json.dumps(index)), _INDEX)
    vocabulary = sorted({r["w"] for t in index for r in t["rare"]})

    def offsets(posted: Column, t: Column) -> Column:
        anchors = F.slice(F.filter(t["rare"], lambda r: F.map_contains_key(posted, r["w"])), 1, ANCHORS)
        shifted = F.transform(anchors, lambda r: F.array_distinct(F.flatten(F.transform(r["at"], lambda p: F.transform(F.try_element_at(posted, r["w"]), lambda x: x - p)))))
        return _let(F.array_sort(F.flatten(shifted)), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))

    def compared(t: Column, at: Column) -> Column:
        def judged(cover: Column) -> Column:
            share = F.aggregate(F.zip_with(cover, t["weights"], lambda c, w: F.when(c, w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
            return F.struct(t["label"].alias("label"), F.round(share, 6).alias("share"), F.forall(t["must"], lambda m: F.get(cover, m)).alias("whole"))

        return _let(F.transform(t["words"], lambda w, p: F.coalesce(F.get(words, at + p) == w, F.lit(False))), judged)

    # a place in front of the text has negative positions, which F.get reads as absent
    return _let(_postings(words, vocabulary), lambda posted: F.flatten(F.transform(literal, lambda t: F.transform(offsets(posted, t), lambda at: compared(t, at)))))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    templates: (label, passage, key phrase). score: the largest share of a template's IDF weight that stands in place, 1 with a base phrase.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for _, p, _ in templates for w in p.split(" ")})
    n_docs, counts = document_counts(docs, vocabulary, text_col)
    index = build_index(templates, n_docs, counts)
    indexed = F.array(*[F.lit(w) for w in sorted({r["w"] for t in index for r in t["rare"]})]) if index else F.array().cast("array<string>")
    rarest = F.array(*[F.lit(min(p.split(" "), key=lambda w: (counts.get(w, 0), w))) for p in BASE])

    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    place = "array<struct<label:string,at:int>>"
    find = "array<struct<label:string,share:double,whole:boolean>>"
    found = _let(
        F.col("words"),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.when(F.arrays_overlap(words, rarest), _base_places(words)).otherwise(F.array().cast(place)).alias("base"),
            F.when(F.size(F.array_intersect(words, indexed)) > 1, _template_finds(words, index)).otherwise(F.array().cast(find)).alias("finds"),
        ),
    )
    rows = rows.select("doc_id", found.alias("f")).select("doc_id", "f.*")
    starts = F.transform("base", lambda b: b["at"])
    base_labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    more = F.transform(F.filter("finds", lambda x: x["whole"] & (x["share"] >= SHARE)), lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, more)).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("finds", lambda x: x["share"])), F.lit(0.0)))).alias("score"),
    )
