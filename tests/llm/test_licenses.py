"""Labels and scores of the licence scan against brute force over all templates and offsets, and licences at large."""

from __future__ import annotations

import math
import random
import re

import pytest
from test_plain_operators import AWKWARD, documents, prose

from framescope.llm import licenses

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_scan(texts, templates, min_score=0.6, slack=3):
    """(labels, score) of each text: every template at every offset."""
    every = [words_of(t) for t in texts]
    vocabulary = {w for t in templates for w in t.words}
    weight = {w: math.log((len(texts) + 1) / (sum(w in x for x in every) + 1)) + 1 for w in vocabulary}
    out = []
    for words in every:
        labels = {label for p, label in BASE.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split()}
        best = 0.0
        for t in templates:
            total = sum(weight[w] for w in t.words)
            for at in range(-len(t.words), len(words)):
                there = sum(weight[w] for p, w in enumerate(t.words) if 0 <= at + p < len(words) and words[at + p] == w)
                if there < min_score * total - 1e-9:
                    continue
                proven = True
                for phrase in t.phrases:
                    p = next(k for k in range(len(t.words)) if t.words[k : k + len(phrase)] == phrase)
                    proven &= any(tuple(words[i : i + len(phrase)]) == phrase for i in range(max(0, at + p - slack), at + p + slack + 1))
                if proven:
                    labels.add(t.label)
                    best = max(best, there / total)
        out.append((",".join(sorted(labels)), min(best, 1.0)))
    return out


def edited(r, words, changes):
    words = list(words)
    for _ in range(changes):
        k = r.randrange(len(words) + 1)
        kind = r.random()
        if kind < 0.4 and k < len(words):
            words[k] = r.choice(["other", "license", "the", "gnu"])
        elif kind < 0.7:
            words.insert(k, r.choice(["new", "public", "of"]))
        elif k < len(words):
            del words[k]
    return words


def test_labels_and_scores_against_brute_force(spark):
    r = random.Random(3)
    texts = list(AWKWARD[:-1]) + ["License: the the license spdx spdx license identifier", "SPDX-License-Identifier: GPL-2.0-or-later", "mit license"]
    for k in range(150):
        parts = [prose(1000 + k, r.randint(0, 12))]
        for _ in range(r.randint(1, 3)):
            parts += [" ".join(edited(r, r.choice(licenses.TEMPLATES).words, r.choice([0, 0, 1, 2, 4]))), prose(2000 + k, r.randint(0, 5))]
        texts.append(" ".join(parts))
    got = {x["doc_id"]: (x["labels"], x["score"]) for x in licenses.scan_licenses(documents(spark, texts).repartition(4)).collect()}
    for k, (labels, score) in enumerate(brute_scan(texts, licenses.TEMPLATES)):
        assert got[k][0] == labels, texts[k]
        assert got[k][1] == pytest.approx(score), texts[k]
    assert len({x for labels, _ in got.values() for x in labels.split(",")}) > 30


def test_tags_and_headers_of_many_licences(spark):
    texts = {f"// SPDX-License-Identifier: {tag}\nint main() {{}}": tag.lower() for tag in licenses.TAGS}
    texts |= {
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl",
        "modify: redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3": "agpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
        "are made available under the terms of the Eclipse Public License v2.0": "epl-2.0",
        "made available under the terms of the Eclipse Public License 2.0 which is available at": "epl-2.0",
        "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0",
        "This is free and unencumbered software released into the public domain.": "unlicense",
    }
    rows = {x["doc_id"]: x["labels"].split(",") for x in licenses.scan_licenses(documents(spark, [*texts, *(prose(k, 60) for k in range(50))])).collect()}
    missed = [t for k, (t, label) in enumerate(texts.items()) if label not in rows[k]]
    assert missed == []
    assert all(rows[k] == [""] for k in range(len(texts), len(texts) + 50))


def test_plan_holds_each_template_once(spark):
    df = documents(spark, ["released under the mit license"])
    few, all_ = (len(licenses.scan_licenses(df, templates=t)._jdf.queryExecution().analyzed().toString()) for t in (licenses.NOTICES[:15], licenses.NOTICES[:30]))
    assert all_ < 3 * few
