"""Licence scan with a positional rare-token index, in DataFrame functions alone.

The templates below are a fixed set: the sentences of well-known licences and notices. One pass cuts all texts into words and
keeps, in the shared folder, what the scan needs; one aggregation over all documents counts in how many each licence word
occurs. Of each file's licence words, those of highest IDF (RARE of each template's) are looked up in the index; a hit
names a template and the relative position at which it would lie. At each such place the template's words are compared by
position (their share, weighted by IDF, is the score) and its mandatory key phrases must stand word
for word. The base phrases go the same way as templates all of whose words are mandatory. All of this happens
inside a document's row: nothing but the word counts is shuffled. Rows without the longest word of any key phrase skip the
look-up, which changes nothing.

Defined cases: null counts as the empty text; phrases may overlap, each place counts; words are runs of a-z, 0-9 and
non-ASCII characters after A-Z are lower-cased; rows pass one by one, so repeated ids don't matter; work is linear in a
text's length; columns besides id and text don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ascii_lower, scratch

#: Fixed value: the pattern of words after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Sentences of well-known licences and notices, with the phrases that must stand in full.
TEMPLATES = (
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("unless required by applicable law or agreed to in writing",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("you may not use this file except in compliance with the license",)),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce the above copyright notice",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("to any person or organization obtaining a copy of the software",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license as published by the free software foundation",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission notice shall be included in all copies or substantial portions of the software",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("to any person obtaining a copy of this software", "publish distribute sublicense and or sell copies of the software")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable for any damages",)),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("altered source versions must be plainly marked as such",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Words of highest IDF that are looked up for a template, and the least score.
RARE, MIN_SCORE = 4, 0.6


def anchors() -> list[str]:
    """The longest word of each key phrase, and of each base phrase."""
    return sorted({max(p.split(), key=len) for _, _, phrases in TEMPLATES for p in phrases} | {max(p.split(), key=len) for p, _ in BASE})


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def template_words() -> list[str]:
    return sorted({w for _, t, _ in TEMPLATES for w in t.split()} | {w for p, _ in BASE for w in p.split()})


def cut_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_words, present (the licence words of the text) and words (of texts with an anchor) of every row, kept in the shared folder."""
    words = df.select(F.col(f"`{id_col}`").alias("id"), words_of(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("words"))
    present = F.array_intersect(F.array(*map(F.lit, template_words())), F.col("words"))
    found = words.select("id", F.size("words").cast("long").alias("n_words"), present.alias("present"), "words")
    anchored = F.arrays_overlap("present", F.array(*map(F.lit, anchors())))
    at = scratch(df.sparkSession, "licence-words")
    found.select("id", "n_words", "present", F.when(anchored, F.col("words")).alias("words")).write.parquet(at)
    return df.sparkSession.read.parquet(at)


def document_counts(rows: DataFrame) -> tuple[dict[str, int], int]:
    """In how many rows each licence word occurs, and how many rows there are."""
    counts = {r["w"]: r["n"] for r in rows.select(F.explode("present").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row for each licence word at most
    return {w: counts.get(w, 0) for w in template_words()}, rows.count()


def entries(idf: dict[str, float]) -> list[dict]:
    """Of each base phrase and template: label, whether base, words in order, their weights, mandatory (position, word)."""
    out = [{"label": label, "base": True, "words": p.split(), "idf": dict.fromkeys(p.split(), 1.0), "must": list(enumerate(p.split()))} for p, label in BASE]
    for label, text, phrases in TEMPLATES:
        words, must = text.split(), []
        for p in map(str.split, phrases):
            at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
            must += [(at + i, w) for i, w in enumerate(p)]
        out.append({"label": label, "base": False, "words": words, "idf": {w: max(idf[w], 1e-6) for w in words}, "must": must})
    return out


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and places (label, base, start, score) of every row; IDF is of df's own documents."""
    rows = cut_texts(df, id_col, text_col)
    counts, n = document_counts(rows)
    index = entries({w: math.log((n + 1) / (c + 1)) for w, c in counts.items()})
    many, literal = len(index), lambda xs: F.array(*map(F.lit, xs))
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, e in enumerate(index):
        for i, w in enumerate(e["words"]):
            postings.setdefault(w, []).append((t, i))
    # each template's words by falling IDF; of those that the file has, the first are looked up
    ranked = F.array(*[literal(sorted(e["idf"], key=lambda w, e=e: (-e["idf"][w], w))) for e in index])
    chosen = F.transform(ranked, lambda ws: F.slice(F.array_intersect(ws, F.col("present")), 1, RARE))
    # exploding one element keeps the planner from putting the choice into the look-up, where each hit would make it anew
    rows = rows.select("id", "n_words", "words", F.explode(F.array(F.when(F.col("words").isNotNull(), chosen))).alias("chosen"))
    lookup = F.create_map(*[x for w, ps in postings.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]))])
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*postings))
    # a place is one long, start x templates + template, so that equal ones are told by hashing
    places = lambda x: F.transform(
        F.filter(F.element_at(lookup, x["w"]), lambda y: (x["i"] >= y["p"]) & F.array_contains(F.get(F.col("chosen"), y["t"]), x["w"])),
        lambda y: (x["i"] - y["p"]).cast("long") * many + y["t"],
    )
    rows = rows.select("id", "n_words", "words", "chosen", F.array_distinct(F.flatten(F.transform(hits, places))).alias("candidates"))
    words = F.array(*[literal(e["words"]) for e in index])
    weights = F.array(*[literal([e["idf"][w] for w in e["words"]]) for e in index])
    must = F.array(*[F.array(*[F.struct(F.lit(i).alias("p"), F.lit(w).alias("w")) for i, w in e["must"]]) for e in index])
    label, base = literal([e["label"] for e in index]), literal([e["base"] for e in index])
    of, at = lambda c: (c % many).cast("int"), lambda c: F.floor(c / many).cast("int")
    stands = lambda c: F.forall(F.get(must, of(c)), lambda y: F.get(F.col("words"), at(c) + y["p"]).eqNullSafe(y["w"]))

    def score(c: Column) -> Column:
        """Share, by IDF, of the template's words that stand in their places."""
        pairs = F.arrays_zip(F.get(words, of(c)).alias("w"), F.get(weights, of(c)).alias("x"))
        spots = F.transform(pairs, lambda y, i: F.struct(y["x"].alias("x"), F.coalesce(F.get(F.col("words"), at(c) + i) == y["w"], F.lit(False)).alias("in")))
        both = F.aggregate(spots, F.struct(F.lit(0.0).alias("in"), F.lit(0.0).alias("all")), lambda acc, y: F.struct((acc["in"] + F.when(y["in"], y["x"]).otherwise(0.0)).alias("in"), (acc["all"] + y["x"]).alias("all")))
        return F.least(both["in"] / both["all"], F.lit(1.0))

    found = F.transform(F.filter("candidates", stands), lambda c: F.struct(F.get(label, of(c)).alias("label"), F.get(base, of(c)).alias("base"), at(c).cast("long").alias("start"), score(c).alias("score")))
    found = F.coalesce(F.filter(found, lambda x: x["score"] >= MIN_SCORE), F.expr("cast(array() as array<struct<label:string,base:boolean,start:bigint,score:double>>)"))
    return rows.select(F.col("id").alias(id_col), "n_words", found.alias("places"))
