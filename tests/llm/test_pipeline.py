"""The pipeline's stages on a small fixture, each against a plain version of what it should do."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from test_plain_operators import SCHEMA, brute_groups, edited, prose

from framescope.llm import packing, quality_rules
from framescope.llm.common import materialize
from framescope.llm.queries import tokenizer_path


def fixture(spark):
    texts = [prose(k, 90 + 7 * k) for k in range(30)]
    texts += [edited(texts[k], k, 2) for k in range(0, 30, 3)] + texts[:4]
    passage = prose(900, 80)
    for k in (20, 21, 22):
        texts[k] = f"{texts[k]} {passage} {prose(950 + k, 60)}"
    texts += ["too short", None, "", " ".join(f"w{k}###" for k in range(200)) + " | | |" * 40]
    rows = [(k, t, "en" if k % 7 else None, f"s{k % 3}" if k % 11 else None, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA)


def test_stages(spark):
    docs = materialize(fixture(spark), "fixture")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "substring_dedup", "mixing", "packing"]
    run = lambda name, df: materialize(stages[name](spark, df, ""), "stage")

    kept = run("quality", docs)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    ids = {r["doc_id"] for r in kept.collect()}
    for r in docs.collect():
        counts = dict(zip(quality_rules.STAT_FIELDS, quality_rules.text_counts(r["text"]), strict=True))
        failed = counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]
        assert not failed or r["doc_id"] not in ids
    assert set(range(30)) <= ids

    single = run("near_duplicates", kept)
    rows = sorted({(r["doc_id"], r["text"]) for r in kept.collect()})
    want = {rows[g][0] for _, g in brute_groups([t for _, t in rows])}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(want)

    cut = run("substring_dedup", single)
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in (single, cut))
    assert before.keys() == after.keys()
    shorter = {k for k in after if len(after[k]["text"]) < len(before[k]["text"])}
    # 37 is a copy of 21 from before the passage came in: too different to be one group, yet it repeats 21's sentences.
    assert shorter == {21, 22, 37} and all(after[k]["n_chars"] == len(after[k]["text"]) for k in shorter)

    mixed = run("mixing", cut)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(after)

    packed = run("packing", mixed).collect()
    encoder = packing.WordEncoder(tokenizer_path())
    tokens = sum(copies[k] * (len(encoder.text(after[k]["text"])) // 4 + 1) for k in copies)
    assert sum(r["length"] for r in packed) == tokens
    ends = Counter()
    for r in packed:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= packing.CAPACITY


def test_empty_table_passes(spark):
    docs = fixture(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), "stage")
    assert docs.collect() == []
