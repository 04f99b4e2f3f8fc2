"""Second, plain versions: accuracies of rules, severity grades, and the pipeline's mixing and packing stages."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pipeline import fixture
from test_plain_operators import AWKWARD, WORD, documents, prose
from tokenizers import Tokenizer

from framescope.llm import packing, quality_rules, toxicity
from framescope.llm.common import materialize
from framescope.llm.queries import tokenizer_path


def plain_em(votes: np.ndarray, rounds: int = 200):
    """Expectation-maximisation text by text: (prior, right about good, right about bad)."""
    n, m = votes.shape
    prior, good, bad = 0.8, np.full(m, 0.97), np.full(m, 0.3)
    said, up, down = votes != 0, votes > 0, votes < 0
    for _ in range(rounds):
        like_good = np.where(up, good, np.where(down, 1 - good, 1.0)).prod(axis=1) * prior
        like_bad = np.where(up, 1 - bad, np.where(down, bad, 1.0)).prod(axis=1) * (1 - prior)
        p = like_good / (like_good + like_bad)
        new_good = np.clip((10 * 0.97 + (p[:, None] * up).sum(axis=0)) / (10 + (p[:, None] * said).sum(axis=0)), 0.5, 0.999)
        new_bad = (10 * 0.3 + ((1 - p)[:, None] * down).sum(axis=0)) / (10 + ((1 - p)[:, None] * said).sum(axis=0))
        prior, good, bad = float(np.clip(p.mean(), 0.001, 0.999)), new_good, np.minimum(np.maximum(new_bad, 1.01 - new_good), 0.999)
    return prior, good, bad


def test_accuracies_of_rules_by_a_second_version():
    r = np.random.default_rng(5)
    for _ in range(5):
        good = r.random(3000) < r.uniform(0.5, 0.9)
        votes = np.zeros((3000, 5), dtype=int)
        for j in range(5):
            right = np.where(good, r.uniform(0.85, 0.99), r.uniform(0.2, 0.8)) > r.random(3000)
            votes[:, j] = np.where(r.random(3000) < 0.3, 0, np.where(right == good, 1, -1))
        model = quality_rules.fit_votes(dict(Counter(map(tuple, votes.tolist()))), 5, tolerance=0)
        prior, g, b = plain_em(votes)
        assert model.prior == pytest.approx(prior, abs=1e-6)
        assert model.right_good == pytest.approx(g, abs=1e-6) and model.right_bad == pytest.approx(b, abs=1e-6)


def test_kept_by_a_second_version(spark):
    """The verdict of every text from votes, accuracies and posterior, worked out again from the documents."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = df.collect()
    kept = {r.doc_id: r.kept for r in quality_rules.rate_quality(df).collect()}
    counted, stats = quality_rules.with_stats(df)
    votes = {r.doc_id: tuple(r)[1:] for r in counted.select("doc_id", *quality_rules._votes_of(F.col(stats))).collect()}
    prior, g, b = plain_em(np.array([votes[r.doc_id] for r in rows]))
    close = 0
    for r in rows:
        v = np.array(votes[r.doc_id])
        odds = math.log(prior / (1 - prior)) + sum(math.log(g[j] / (1 - b[j])) if x > 0 else math.log((1 - g[j]) / b[j]) if x < 0 else 0 for j, x in enumerate(v))
        counts = dict(zip(quality_rules.STAT_FIELDS, quality_rules.text_counts(r.text), strict=True))
        failed = counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]
        if abs(odds) < 1e-3:
            close += 1
            continue
        assert kept[r.doc_id] == (not failed and odds >= 0)
    assert close < 3


def plain_grades(weights, thresholds, text):
    """(expected severity, likeliest grade, chance of any) by the formula of cumulative links."""
    low = (text or "").lower()
    words, word = [], ""
    for c in low + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    counts = Counter(w for w in words if w in weights) + Counter("^" + w[:4] for w in words if len(w) >= 4 and "^" + w[:4] in weights)
    score = sum(weights[w] * math.log(1 + n) for w, n in counts.items())
    upto = [1 / (1 + math.exp(score - t)) for t in thresholds] + [1.0]
    p = [upto[0], *(b - a for a, b in zip(upto, upto[1:], strict=False))]
    return sum(k * x for k, x in enumerate(p)), max(range(4), key=lambda k: (p[k], -k)), 1 - p[0]


def test_severity_by_a_second_version(spark):
    r = random.Random(4)
    words = ["bad", "worse", "fine", "größe", "übel", "m", "viii", "cuatro"]
    weights = {w: r.uniform(-2, 3) for w in words} | {"^" + w[:4]: r.uniform(-1, 2) for w in words if len(w) >= 4}
    texts = [*AWKWARD, "m² Ⅷ viii BAD bad_worse bad2worse", "GRÖSSE Größe größer"] + [" ".join(r.choice([*words, "other", "x1", "²"]) for _ in range(r.randint(0, 30))) for _ in range(150)]
    model = toxicity.Ordinal(weights, (0.5, 2.0, 3.5))
    for row in toxicity.grade(documents(spark, texts), model).collect():
        expected, grade, chance = plain_grades(weights, model.thresholds, texts[row.doc_id])
        assert row.expected_severity == pytest.approx(expected) and row.p_toxic == pytest.approx(chance)
        assert row.severity == grade and row.toxic == (chance >= 0.5)


def test_words_are_the_same_in_both_places(spark):
    texts = ["m² Ⅷ x½y ①a", "café naïve_x a1b", "été", "ﬁ ß", "中文 字"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    split = df.select("t", F.filter(F.split(F.lower("t"), r"[^\p{L}]+"), lambda w: w != "").alias("w")).collect()
    assert all(row.w == toxicity.words_of(row.t.lower()) for row in split)


def test_ordinal_fit_is_a_minimum():
    r = np.random.default_rng(2)
    n, m = 800, 6
    x = r.poisson(0.7, (n, m)).astype(float)
    grades = np.digitize(x @ r.normal(0, 1, m) + r.logistic(size=n), [0.5, 1.5, 3.0])
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(rows, cols, x[rows, cols], grades, m, steps=3000, rate=0.02)

    def loss(w, theta):
        score = x @ w
        upto = np.concatenate((np.zeros((n, 1)), 1 / (1 + np.exp(score[:, None] - theta[None, :])), np.ones((n, 1))), axis=1)
        return -np.log(upto[np.arange(n), grades + 1] - upto[np.arange(n), grades]).mean() + 0.5e-4 * (w * w).sum()

    best = loss(w, theta)
    assert (np.diff(theta) > 0).all()
    for _ in range(200):
        step = r.normal(0, 0.03, m + 3)
        assert loss(w + step[:m], theta + step[m:]) > best - 1e-6


# --- the pipeline's last two stages ---------------------------------------------------------------------------------


def plain_mix(rows):
    """Copies of each (id, text, source): certain ones, then Pareto ranks down to the place nearest to the target."""
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    left, target = 1.5 * sum(sizes.values()), {}
    while len(target) < len(sources):
        rest = [s for s in sources if s not in target]
        unit = left / sum(weight[s] for s in rest)
        full = [s for s in rest if unit * weight[s] > 2 * sizes[s]]
        for s in full or rest:
            target[s] = 2 * sizes[s] if full else unit * weight[s]
            left -= target[s]
    copies = Counter()
    for s in sources:
        own = [(k, t) for k, t, x in rows if x == s]
        ratio = target[s] / sizes[s] if sizes[s] else 0
        whole, p = int(ratio), ratio - int(ratio)
        mean = sum(size(t) ** 2 for _, t in own) / sizes[s] if sizes[s] else 1
        ranked = []
        for k, t in own:
            if size(t):
                copies[k, t] += whole
                digest = hashlib.md5(t.encode()).hexdigest()
                u = (int(hashlib.md5(f"17|{k}|{digest}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                if p > 0:
                    ranked.append((u / (1 - u) / (p / (1 - p) * size(t) / mean), k, t))
        want, before = target[s] - whole * sum(size(t) for _, t in own), 0
        for _, k, t in sorted(ranked):
            if 2 * before + size(t) > 2 * want:
                break
            copies[k, t] += 1
            before += size(t)
    return +copies, target


def test_mixing_stage_by_a_second_version(spark):
    docs = materialize(fixture(spark).where("doc_id <> 5").distinct(), "mix-fixture")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want, target = plain_mix(rows)
    got = Counter((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "").collect())
    assert got == want
    source = {(k, t): s for k, t, s in rows}
    taken = Counter()
    for (k, t), n in got.items():
        taken[source[k, t]] += n * len(WORD.findall(t))
    longest = max(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert all(abs(taken[s] - target[s]) <= longest for s in target)


def test_packing_stage_by_a_second_version(spark):
    texts = [prose(k, 40 + 61 * k) for k in range(25)] + [prose(99, 5000), None, "", "x", prose(3, 40 + 61 * 3)]
    docs = materialize(documents(spark, texts), "pack-fixture")
    tokenizer = Tokenizer.from_file(tokenizer_path())
    found = defaultdict(list)
    bins = defaultdict(list)
    for r in dict(corpus_pipeline.STAGES)["packing"](spark, docs, "").collect():
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for k, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        want = []
        for piece, start in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[start : start + packing.CAPACITY]
            want.append((piece, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
        assert sorted(found[k]) == want
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert len(bins) <= -(-total // packing.CAPACITY) + 1
