"""Licence scan by a positional index of rare tokens, in DataFrame functions alone.

The words of short licence notices form an index: word -> (template, place in the template). How rare a licence word
is, is counted over all documents. Each template is looked up by its own rarest words, in every document that has all
words of its mandatory phrases; each place where one stands, less the place in a template, is the offset at which that
template would begin. An offset that two words agree on is a candidate. The candidate's score is the share of the
template's rarity that stands at its places, and it counts only if the template's mandatory phrases stand near where
they should. A template has as many words in the index as it takes for every offset with a sufficient score to be a
candidate, whatever else stands in the document.

Besides, the base phrases are reported wherever their words stand consecutively.

Defined results: a null text counts as empty; without words there is no label and the score is 0. Repeated words,
notices and rows need no order: labels are distinct and sorted. Result columns that clash with input columns get a
numbered suffix. An empty table gives an empty result. Words keep the characters of any other script than ASCII; only
A-Z is lower-cased.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import free_name, quoted

#: What stands between words, once A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]


def template(label: str, text: str, *phrases: str) -> Template:
    return Template(label, tuple(text.split()), tuple(tuple(p.split()) for p in phrases))


# Notices of public licences, as words, with the phrases that a match must hold.
NOTICES = (
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    template("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses"),
    template("mit", "released under the mit license", "mit license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted", "free of charge"),
    template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license"),
    template("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license", "free software foundation"),
    template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", "source and binary forms"),
    template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify", "with or without fee"),
    template("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license", "free software foundation"),
    template("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license", "free software foundation"),
    template("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from", "without specific prior written permission"),
    template("epl-1.0", "made available under the terms of the eclipse public license v1 0", "eclipse public license v1 0"),
    template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    template("epl-2.0", "made available under the terms of the eclipse public license v 2 0", "eclipse public license v 2 0"),
    template("epl-2.0", "made available under the terms of the eclipse public license v2 0", "eclipse public license v2 0"),
    template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software", "public domain"),
    template("cc0-1.0", "waived all copyright and related or neighboring rights to this work", "waived all copyright", "related or neighboring rights"),
    template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    template("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    template("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    template("zlib", "in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose", "authors be held liable for any damages arising", "permission is granted to anyone"),
    template("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license"),
    template("ofl-1.1", "licensed under the sil open font license version 1 1", "sil open font license"),
    template("eupl-1.2", "licensed under the european union public licence version 1 2", "european union public licence"),
    template("artistic-2.0", "released under the artistic license 2 0", "artistic license 2 0"),
    template("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without fee and without a written agreement"),
    template("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to"),
)
# Public identifiers of licences, as they stand in tags of source files.
TAGS = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "CC0-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "Zlib", "CDDL-1.0", "CDDL-1.1", "OFL-1.1", "EUPL-1.2", "Artistic-2.0", "PostgreSQL", "WTFPL", "MS-PL", "NCSA", "PSF-2.0", "Python-2.0",
)


def tag_template(identifier: str) -> Template:
    """The notice of a tag: its three words and those of an identifier, which must stand as they are."""
    words = "spdx license identifier " + " ".join(re.findall("[a-z0-9]+", identifier.lower()))
    return template(identifier.lower(), words, words)


TEMPLATES = (*NOTICES, *map(tag_template, TAGS))


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def _array(values: Sequence[object]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _stands(words: Column, at: Column, phrase: Sequence[str]) -> Column:
    """Whether the words of ``phrase`` stand at index ``at``, which may lie outside."""
    out = at >= 0
    for k, w in enumerate(phrase):
        out = out & F.coalesce(F.get(words, at + k) == w, F.lit(False))
    return out


def _as_struct(x: Template, weight: dict[str, float], total: float, needed: Sequence[str], probes: Sequence[str]) -> Column:
    """A template as a value of the plan: label, words with their weights, and phrases with their places."""
    texts = lambda values: _array(values) if values else F.array().cast("array<string>")
    places = [next(k for k in range(len(x.words)) if x.words[k : k + len(p)] == p) for p in x.phrases]
    phrases = [F.struct(F.lit(at).alias("at"), _array(p).alias("words")) for at, p in zip(places, x.phrases, strict=True)]
    listed = F.array(*phrases) if phrases else F.array().cast("array<struct<at:int,words:array<string>>>")
    return F.struct(
        F.lit(x.label).alias("label"), texts(x.words).alias("words"), _array([weight[w] for w in x.words]).alias("weights"), F.lit(total or 1.0).alias("total"),
        texts(needed).alias("needed"), texts(probes).alias("probes"), listed.alias("phrases"),
    )


def _rated(words: Column, at: Column, t: Column, slack: int) -> Column:
    """Label and score of a template that would begin at ``at``: the share of its rarity that stands in its places, 0 unless
    each phrase stands within ``slack`` of its place."""
    places = lambda values: F.sequence(F.lit(0), F.size(values) - 1)
    same = lambda i, w: F.coalesce(F.get(words, i) == w, F.lit(False))
    there = F.aggregate(places(t["words"]), F.lit(0.0), lambda s, p: s + F.when(same(at + p, F.get(t["words"], p)), F.get(t["weights"], p)).otherwise(F.lit(0.0)))
    stands = lambda i, phrase: (i >= 0) & F.forall(places(phrase), lambda k: same(i + k, F.get(phrase, k)))
    proven = F.forall(t["phrases"], lambda p: F.exists(F.sequence(at + p["at"] - slack, at + p["at"] + slack), lambda i: stands(i, p["words"])))
    return F.struct(t["label"].alias("label"), F.least(F.when(proven, there / t["total"]).otherwise(F.lit(0.0)), F.lit(1.0)).alias("score"))


def rarity(df: DataFrame, text_col: str, vocabulary: Sequence[str]) -> dict[str, float]:
    """Smoothed inverse document frequency of each word of a fixed ``vocabulary``, over all rows: 1 for a word in all."""
    found = F.array_intersect(_array(vocabulary), words_of(quoted(text_col)))
    # A row for all documents besides one for each word that occurs; no more than the vocabulary and one.
    counts = df.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["word"]: r["n"] for r in counts}
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) + 1 for w in vocabulary}


def probe_words(words: Sequence[str], weight: dict[str, float], min_score: float) -> tuple[list[str], int]:
    """The rarest words of a template, and how often a place of theirs counts towards the two that must agree.

    Without two places of these words no offset reaches ``min_score``. Where one place may be enough, it counts twice.
    """
    total = sum(weight[w] for w in words)
    order = sorted(set(words), key=lambda w: (-weight[w], w))
    left = total
    for k, w in enumerate(order, 1):
        left -= words.count(w) * weight[w]
        if left + weight[order[0]] < min_score * total - 1e-9:
            return order[:k], 1
    return order, 2


def scan_licenses(
    df: DataFrame,
    text_col: str = "text",
    templates: Sequence[Template] = TEMPLATES,
    min_score: float = 0.6,
    slack: int = 3,
) -> DataFrame:
    """``df`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score``.

    ``slack`` is how far a mandatory phrase may lie from its place. No word is too frequent to count: how rare words are
    decides which are looked up and what they weigh, not whether a whole notice is found.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    weight = rarity(df, text_col, vocabulary)
    totals = [sum(weight[w] for w in t.words) for t in templates]
    probes = [probe_words(t.words, weight, min_score) for t in templates]
    rare = sorted({w for found, _ in probes for w in found})
    postings = {w: [(t, p) for t, x in enumerate(templates) if w in probes[t][0] for p, v in enumerate(x.words) if v == w for _ in range(probes[t][1])] for w in rare}
    needed = [sorted({w for p in t.phrases for w in p}) for t in templates]

    tmp = {n: free_name(df, f"license_{n}") for n in ("words", "starts", "present", "probes", "codes", "found")}
    out = df.withColumn(tmp["words"], words_of(quoted(text_col)))
    words = quoted(tmp["words"])
    n = F.size(words)
    every = F.sequence(F.lit(0), n - 1)  # only where n > 0

    # Base phrases: index of each place, and which phrase.
    first_words = sorted({p.split()[0] for p in BASE_PHRASES})
    places = F.filter(every, lambda i: F.get(words, i).isin(first_words))

    def base_places(phrase: str, label: str) -> Column:
        at = F.filter(places, lambda i: _stands(words, i, phrase.split()))
        return F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    tests = [base_places(p, label) for p, label in BASE_PHRASES.items()]
    none = "array<struct<at:bigint,label:string>>"
    out = out.withColumn(tmp["starts"], F.when(F.arrays_overlap(words, _array(first_words)), F.concat(*tests)).otherwise(F.array().cast(none)))

    # Candidates: template and offset in one number, from the postings of each template's rarest words. Templates are data
    # of the plan, an array of structs, so that it holds each of them once, however many there are.
    unit, zero = 1 << 40, 1 << 30
    none = "array<bigint>"
    if rare:
        kinds = F.array(*(_as_struct(x, weight, totals[t], needed[t], probes[t][0]) for t, x in enumerate(templates)))
        index = F.create_map(*(x for w in rare for x in (F.lit(w), _array([t * unit - p + zero for t, p in postings[w]]))))
        # Columns of their own, so that they aren't worked out again for each word.
        out = out.withColumn(tmp["present"], F.array_intersect(_array(vocabulary), words))
        present = quoted(tmp["present"])
        live = F.filter(kinds, lambda t: F.size(F.array_except(t["needed"], present)) == 0)
        out = out.withColumn(tmp["probes"], F.array_intersect(F.flatten(F.transform(live, lambda t: t["probes"])), present))
        looked_up = quoted(tmp["probes"])
        hits = F.filter(every, lambda i: F.array_contains(looked_up, F.get(words, i)))
        codes = F.array_sort(F.flatten(F.transform(hits, lambda i: F.transform(F.element_at(index, F.get(words, i)), lambda c: c + i))))
        out = out.withColumn(tmp["codes"], F.when(F.size(looked_up) > 0, codes).otherwise(F.array().cast(none)))
        codes = quoted(tmp["codes"])
        agreed = F.array_distinct(F.filter(codes, lambda c, j: (j > 0) & (c == F.get(codes, j - 1))))

        def rated(code: Column) -> Column:
            at = F.pmod(code, F.lit(unit)).cast("int") - zero
            return F.transform(F.array(F.get(kinds, F.floor(code / unit).cast("int"))), lambda t: _rated(words, at, t, slack))

        found = F.filter(F.flatten(F.transform(agreed, rated)), lambda r: r["score"] >= min_score)
    else:
        found = F.array().cast("array<struct<label:string,score:double>>")
    out = out.withColumn(tmp["found"], found)

    starts, found = quoted(tmp["starts"]), quoted(tmp["found"])
    at = F.transform(starts, lambda s: s["at"])
    base = F.array_sort(F.array_distinct(F.transform(starts, lambda s: s["label"])))
    labels = F.array_sort(F.array_union(base, F.transform(found, lambda r: r["label"])))
    results = {
        "n_words": n.cast("long"),
        "n_base": F.size(starts).cast("long"),
        "first_word": F.array_min(at),
        "last_word": F.array_max(at),
        "base_labels": F.array_join(base, ","),
        "labels": F.array_join(labels, ","),
        "score": F.coalesce(F.array_max(F.transform(found, lambda r: r["score"])), F.lit(0.0)),
    }
    return out.select(*[quoted(c) for c in df.columns], *(v.alias(free_name(df, k)) for k, v in results.items()))
