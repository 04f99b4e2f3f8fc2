"""Operators against brute force, round trips and awkward input."""

from __future__ import annotations

import base64
import functools
import gzip
import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framescope.llm import archives, kneser_ney, licenses, line_dedup, mixing, ngram_join, packing, periodic_runs, quality_rules, telephony, token_alignment, toxicity
from framescope.llm.common import SpanHash, normal_words
from framescope.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))


AWKWARD = [None, "", "   \n\t ", "one", "a b c d", "x\x00y  z \U0001f600", "THE the The. " * 40, "éÉ ñ ü " * 30, prose(1, 5000)]


def documents(spark, texts, **more):
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls in any column, ties and repeated rows, empty and long texts."""
    df = documents(spark, AWKWARD)
    return df.union(df).union(spark.createDataFrame([(None, None, None, None, None), (None, "some words stand here", None, None, None)], SCHEMA))


def clashing(spark, texts):
    names = ["n_words", "kept", "rule_stats", "value", "size", "target", "taken", "piece", "start", "length", "ids", "sequence_id", "offset", "media", "media_1", "payload", "labels", "score", "toxic", "severity", "perplexity", "component_id", "n_shingles", "removed_spans", "node", "row", "a", "b", "sig", "unit_id", "group_length", "slice", "odds", "n", "gram", "block", "runs", "collapsed", "n_a", "groups", "groups_1", "k0", "segments", "codes"]
    df = documents(spark, texts)
    for n in names:
        df = df.withColumn(n, F.lit("own"))
    return df


def packed(df):
    pieces = packing.tokenize(df, tokenizer_path(), keep=[c for c in df.columns if c != "text"])
    return packing.pack(pieces, length_col=pieces.columns[-2])


TOKENIZERS = [str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]

OPERATORS = {
    "quality": lambda df: quality_rules.rate_quality(df),
    "telephony": lambda df: telephony.store_and_decode(df, keep=df.columns),
    "toxicity": lambda df: toxicity.grade(df, toxicity.Ordinal({"bad": 3.0}, (1.0, 2.0, 3.0))),
    "packing": packed,
    "mixing": lambda df: mixing.mix_sources(df, keep=df.columns),
    "join": lambda df: ngram_join.near_duplicates(df, keep=df.columns),
    "licenses": lambda df: licenses.scan_licenses(df),
    "perplexity": lambda df: kneser_ney.rate_by_perplexity(df, df.sparkSession.createDataFrame([(0, 1), (8, 1), (None, 1), (7, None)], "doc_id long, quality int"), keep=[c for c in df.columns if c != "text"]),
    "dedup": lambda df: line_dedup.dedup_lines(df),
    "periods": lambda df: periodic_runs.collapse_runs(df),
    "tokens": lambda df: token_alignment.align_tokens(df, *TOKENIZERS, keep=[c for c in df.columns if c != "text"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    df = awkward(spark)
    out = OPERATORS[name](df)
    rows = out.collect()
    if name == "packing":
        assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    else:
        assert len(rows) == df.count()
    by_id = defaultdict(set)
    for r in rows:
        if r["doc_id"] is not None and name not in ("packing", "mixing"):
            by_id[r["doc_id"]].add(str({k: v for k, v in r.asDict().items()}))
    assert all(len(v) == 1 for v in by_id.values())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark, ["x"]).where("false")).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    rows = OPERATORS[name](clashing(spark, ["some words are here", None, "bad"])).collect()
    assert len(rows) == 3
    assert {r["taken"] for r in rows} == {"own"} and {r["severity"] for r in rows} == {"own"}


def test_text_counts_and_base(spark):
    def brute(text):
        words = WORD.findall(text or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = {w for w, n in Counter(windows).items() if n > 1}
        places = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
        seen, repeats = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                repeats += line in seen
                seen.add(line)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeats, len(places)

    r = random.Random(5)
    texts = AWKWARD + ["\n".join(" ".join(r.choice("ab#|") for _ in range(r.randint(0, 9))) for _ in range(12)) for _ in range(60)]
    for text in texts:
        c = dict(zip(quality_rules.STAT_FIELDS, quality_rules.text_counts(text), strict=True))
        assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == brute(text)


def test_vote_model_recovers_accuracies():
    r = random.Random(3)
    right = [(0.98, 0.6), (0.95, 0.5), (0.97, 0.4), (0.9, 0.7)]
    patterns, truth = Counter(), []
    for _ in range(20_000):
        good = r.random() < 0.8
        votes = tuple(0 if r.random() < 0.2 else (1 if good else -1) * (1 if r.random() < (g if good else b) else -1) for g, b in right)
        patterns[votes] += 1
        truth.append((votes, good))
    model = quality_rules.fit_votes(dict(patterns), 4)
    assert abs(model.prior - 0.8) < 0.05
    assert all(abs(model.right_good[j] - right[j][0]) < 0.05 for j in range(4))
    held = sum((model.posterior(v) >= 0.5) == g for v, g in truth) / len(truth)
    assert held > 0.88


def test_quality_against_labels(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality_rules.rate_quality(df).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    bad, good = out.where("quality = 0"), out.where("quality = 1")
    assert bad.where("not kept").count() >= 0.9 * bad.count()
    assert good.where("kept").count() >= 0.98 * good.count()


def test_spark_posterior_equals_python(spark):
    df, stats = quality_rules.with_stats(documents(spark, [prose(k, 30 + 20 * k) + " ### | |" * (k % 4) for k in range(30)]))
    model = quality_rules.learn(df, stats)
    votes = quality_rules.rule_votes({f: F.col(stats)[f] for f in quality_rules.STAT_FIELDS})
    for row in df.select(F.array(*[votes[r] for r in quality_rules.RULES]).alias("v"), quality_rules.posterior_of(F.col(stats), model).alias("p")).collect():
        assert row["p"] == pytest.approx(model.posterior(row["v"]))


# --- telephony ------------------------------------------------------------------------------------------------------


def test_sound_round_trip():
    r = random.Random(1)
    for n in (0, 1, 191, 192, 193, 5000):
        payload = telephony.pad(bytes(r.randrange(256) for _ in range(n)))
        assert len(payload) % 192 == 0 and payload
        for codec in telephony.CODECS:
            assert telephony.stored_payload(telephony.store(payload, codec)) == payload


def test_tables_follow_g711():
    def mulaw(code):
        code = ~code & 0xFF
        size = ((code & 15) * 8 + 132) * 2 ** ((code >> 4) & 7) - 132
        return -size if code & 128 else size

    def alaw(code):
        code ^= 0x55
        part, low = (code >> 4) & 7, code & 15
        size = low * 16 + 8 if not part else (low * 16 + 264) * 2 ** (part - 1)
        return size if code & 128 else -size

    assert telephony.MULAW_TABLE.tolist() == [mulaw(c) for c in range(256)]
    assert telephony.ALAW_TABLE.tolist() == [alaw(c) for c in range(256)]
    assert telephony.MULAW_TABLE.max() == 32124 and telephony.ALAW_TABLE.max() == 32256


def test_adpcm_blocks_against_one_at_a_time():
    r = np.random.default_rng(2)
    blocks = r.integers(0, 256, (7, 196), dtype=np.uint8)
    blocks[:, 2] %= 89
    got = telephony.decode_adpcm(blocks)
    for block, pcm in zip(blocks, got, strict=True):
        value, index = struct.unpack("<hB", block[:3].tobytes())
        want = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(telephony.INDEX_CHANGE[code])))
                want.append(value)
        assert pcm.tolist() == want


def test_double_rate_keeps_samples_and_tones():
    t = np.arange(4000)
    tone = (8000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    out = telephony.double_rate(tone)
    assert (out[::2] == tone).all()
    want = 8000 * np.sin(2 * np.pi * 440 * (t + 0.5) / 8000)
    assert np.abs(out[1::2][10:-10] - want[10:-10]).max() < 200


def test_sound_of_rows(spark):
    rows = {r["doc_id"]: r for r in telephony.store_and_decode(documents(spark, AWKWARD)).collect()}
    for k, text in enumerate(AWKWARD):
        data = (text or "").encode("utf-8", "surrogatepass")
        assert rows[k]["n_bytes"] == len(data) and bytes(rows[k]["payload"]) == telephony.pad(data)
        tag, rate, _, pcm = telephony.read_wave(bytes(rows[k]["pcm"]))
        assert (tag, rate, len(pcm)) == (telephony.PCM, 16000, 2 * rows[k]["samples"])


# --- packing --------------------------------------------------------------------------------------------------------


def test_encoder_equals_tokenizer():
    encoder = packing.WordEncoder(tokenizer_path())
    for text in [*AWKWARD, "a<|endoftext|>b <|ENDOFTEXT|> don't DON'T. it's., İ Å é x y z ... a--b. 12ab. 'S ﬁ ǅ K.", prose(3, 400).upper()]:
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert encoder.text(text or "") == np.asarray(ids, dtype="<u4").tobytes()


def test_fullest_against_brute_force():
    r = random.Random(9)
    for _ in range(200):
        counts = {r.randint(1, 20): r.randint(1, 3) for _ in range(4)}
        room = r.randint(1, 40)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
        uses = packing.fullest(room, counts)
        assert sum(k * n for k, n in uses.items()) == max(sums)
        assert all(n <= counts[k] for k, n in uses.items())


def test_packed_pieces_are_whole(spark):
    texts = [prose(k, 20 + 137 * k % 1900) for k in range(60)] + AWKWARD
    pieces = packing.tokenize(documents(spark, texts), tokenizer_path())
    rows = packing.pack(pieces).collect()
    encoder = packing.WordEncoder(tokenizer_path())
    by_doc = defaultdict(dict)
    by_bin = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]][r["piece"]] = bytes(r["ids"])
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, text in enumerate(texts):
        assert b"".join(by_doc[k][p] for p in sorted(by_doc[k])) == encoder.text(text or "") + b"\0\0\0\0"
    for places in by_bin.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert len(by_bin) <= -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1


# --- archives -------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    htmls = ["<a>", "", None, "<a>", "x" * 40_000, "é", "<a>"]
    pages = spark.createDataFrame([(k * 3 % 7, f"http://h/{k}\r\nX: y" if k else None, h) for k, h in enumerate(htmls)] + [(None, "u", "<a>")], "page_id long, url string, html string")
    listed = archives.write_archives(pages, archive_bytes=30_000)
    got = {r["page_id"]: r for r in archives.read_archives(listed).collect()}
    want = {k * 3 % 7: h or "" for k, h in enumerate(htmls)}
    for page, html in [*want.items(), (None, "<a>")]:
        data = html.encode()
        first = min(p for p, h in want.items() if h == html)
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page == first else ("revisit", first))
        assert r["payload"] is None if page != first else bytes(r["payload"]) == data
    assert archives.read_archives(archives.write_archives(pages.where("false"))).collect() == []


def test_archives_of_a_page_that_most_rows_hold(spark):
    rows = [(k, f"u{k % 3}", "hot" if k % 3 else f"p{k % 50}", k, "x") for k in range(1, 400)] + [(None, None, "hot", 0, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long, key string")
    for hot_rows in (1, 3, 1000):  # none, one and every repeated payload counts as frequent
        got = archives.read_archives(archives.write_archives(pages, hot_rows=hot_rows)).collect()
        first = {}
        for k, _, html, *_ in rows:
            if k is not None:
                first[html] = min(first.get(html, k), k)
        want = [(k, u, None if k != first[h] else h.encode(), len(h), None if k == first[h] else first[h]) for k, u, h, *_ in rows]
        order = lambda r: (r[0] is None, r[0])
        assert sorted(((r["page_id"], r["url"], r["payload"] and bytes(r["payload"]), r["payload_bytes"], r["refers_to"]) for r in got), key=order) == sorted(want, key=order)


def test_zip_reader_takes_other_writers_files():
    record = gzip.compress(archives.make_record(4, "u", b"body", archives.payload_digest(b"body"), None))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 in a comment"
        z.writestr("archive/other.warc.gz", record * 3)
        z.writestr("deflated", b"x" * 1000, zipfile.ZIP_DEFLATED)
    data = out.getvalue()
    reader = archives.ZipRanges(lambda at, n: data[at : at + n], len(data))
    assert "deflated" not in reader.members
    assert [r["payload"] for r in archives.records_of(reader)] == [b"body"] * 3
    ours = archives.zip_of([("archive/a.warc", b"123"), ("b", b"")])
    with zipfile.ZipFile(io.BytesIO(ours)) as z:
        assert z.read("archive/a.warc") == b"123" and z.testzip() is None
    with pytest.raises(ValueError):
        archives.ZipRanges(lambda at, n: b"nothing"[at : at + n], 7)


def test_smallest_reads_are_ranges():
    data = archives._archive([(k, None, bytes([k]) * 5000, archives.payload_digest(bytes([k]) * 5000), None) for k in range(40)])
    reads = []

    def read_at(at, n):
        reads.append(n)
        return data[at : at + n]

    assert sum(1 for _ in archives.records_of(archives.ZipRanges(read_at, len(data)))) == 40
    assert max(reads[1:]) < len(data)


# --- mixing ---------------------------------------------------------------------------------------------------------


def test_targets():
    shares = mixing.share_targets([("b", 100), ("a", 1000), (None, 10), ("c", 500)])
    assert [s.source for s in shares] == ["a", "b", "c", None]
    assert sum(s.target for s in shares) == pytest.approx(1.5 * 1610)
    assert all(s.target <= 2 * s.size + 1e-9 for s in shares)
    assert mixing.share_targets([("a", 0)])[0].target == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_mix_against_brute_force(spark, weighted):
    texts = [prose(k, 5 + 31 * k % 200) for k in range(300)]
    df = documents(spark, texts).withColumn("w", (F.col("doc_id") % 7 + 1).cast("double"))
    mixed = lambda: {r["doc_id"]: r for r in mixing.mix_sources(df, weight_col="w" if weighted else None, buckets=64).collect()}
    got = mixed()
    assert {k: r["taken"] for k, r in got.items()} == {k: r["taken"] for k, r in mixed().items()}
    by_source = defaultdict(list)
    for r in got.values():
        by_source[r["source"]].append(r)
    for source, rows in by_source.items():
        target, taken = rows[0]["target"], sum(r["taken"] for r in rows)
        assert all(r["copies"] <= 2 for r in rows) and all(r["source_size"] == sum(x["size"] for x in rows) for r in rows)
        assert abs(taken - target) <= max(r["size"] for r in rows)
        u = {r["doc_id"]: r for r in rows}
        extra = [k for k, r in u.items() if r["copies"] > int(target / rows[0]["source_size"])]
        drawn = F.col("u") / (1 - F.col("u")) / (F.col("w") if weighted else F.lit(1.0))
        rank = df.where(F.col("doc_id").isin(list(u))).withColumn("u", mixing.uniform_of(17, F.col("doc_id"), F.md5("text"))).orderBy(drawn).collect()
        assert set(extra) == {r["doc_id"] for r in rank[: len(extra)]}


# --- licences -------------------------------------------------------------------------------------------------------


def test_licenses_against_brute_force(spark):
    between = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = AWKWARD + ["CC BY 4.0 and cc-by, all RIGHTS reserved. General Public License", "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person", "the mit of license", "Licensed under the Apache License, Version 2.0 (the License)", "éLicensed under CC BY-NC 4.0.", "general public licenses", "by cc by by"] + [prose(k, 50) for k in range(40)]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    for k, text in enumerate(texts):
        words = between.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = [(j, label) for p, label in licenses.BASE_PHRASES.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        r = rows[k]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not places
        assert 0 <= r["score"] <= 1
    n = len(AWKWARD)
    assert rows[n + 1]["labels"] == "mit" and rows[n + 4]["labels"] == "apache-2.0" and rows[n + 3]["labels"] == ""
    assert rows[n + 5]["labels"] == "cc-by,cc-by-nc-4.0" or "cc-by" in rows[n + 5]["labels"]


def test_every_notice_of_a_document_is_found(spark):
    texts = [" ".join(" ".join(t.words) for t in licenses.TEMPLATES)]
    texts.append(" ".join(" ".join(t.words) for t in licenses.TEMPLATES if t.label in ("apache-2.0", "mit", "bsd")))
    short = licenses.template("mit", "released under the mit license").words
    texts.append(" ".join(sorted({w for t in licenses.TEMPLATES for w in t.words} - set(short))) + " " + " ".join(short))
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, texts + [prose(k, 50) for k in range(40)])).collect()}
    assert {t.label for t in licenses.TEMPLATES} <= set(rows[0]["labels"].split(","))
    assert set(rows[1]["labels"].split(",")) == {"apache-2.0", "mit", "bsd"}
    assert "mit" in rows[2]["labels"].split(",") and rows[2]["score"] == 1
    assert all(rows[k]["labels"] == "" for k in range(3, 43))


def test_notices_are_found_however_many_rows_hold_them(spark):
    for texts in (["Released under the MIT License."], ["Released under the MIT License. " + prose(k, 20) for k in range(12)]):
        rows = licenses.scan_licenses(documents(spark, texts)).collect()
        assert [(r["labels"], r["score"]) for r in rows] == [("mit", 1.0)] * len(texts)


def test_probes_leave_no_sufficient_offset_out():
    r = random.Random(3)
    for _ in range(300):
        words = [r.choice("abcdefgh") for _ in range(r.randint(1, 7))]
        weight = {w: r.choice([1.0, 2.0, 9.0, 40.0]) for w in set(words)}
        probes, count = licenses.probe_words(words, weight, 0.6)
        for some in range(1 << len(words)):
            there = [w for k, w in enumerate(words) if some >> k & 1]
            if sum(weight[w] for w in there) >= 0.6 * sum(weight[w] for w in words):
                assert count * sum(w in probes for w in there) >= 2


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_ordinal_fit_orders_thresholds_and_finds_weights():
    r = np.random.default_rng(4)
    x = r.integers(0, 4, (3000, 3)).astype(float)
    noise = r.logistic(size=3000)
    grades = np.digitize(x @ np.array([1.5, 0.0, -1.0]) + noise, [1.0, 2.5, 4.0])
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(rows, cols, x[rows, cols], grades, 3)
    assert np.allclose(w, [1.5, 0, -1], atol=0.2) and np.allclose(theta, [1, 2.5, 4], atol=0.3)


def test_toxicity_learns_from_awkward_labels(spark):
    bad = "grim foul vile nasty"
    rows = [(k, (bad + " " if k % 2 else "") + prose(k, 12)) for k in range(120)]
    docs = spark.createDataFrame([*rows, *rows[:9], (None, bad), (500, None), (501, "")], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(120)] + [(None, 1), (7, None), (900, 1), (500, 0), (3, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert {"grim", "foul", "vile", "nasty"} <= set(model.weights) and all(model.weights[w] > 0 for w in bad.split())
    assert list(model.thresholds) == sorted(model.thresholds)
    for r in toxicity.grade(docs, model).collect():
        score = model.score(r["text"])
        above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert r["expected_severity"] == pytest.approx(sum(above)) and r["p_toxic"] == pytest.approx(above[0])
        assert r["toxic"] == (bad in (r["text"] or ""))
    for empty in (toxicity.learn(docs.where("false"), labels), toxicity.learn(docs, labels.where("toxic = 0"))):
        assert not empty.weights and not any(r["toxic"] for r in toxicity.grade(docs, empty).collect())


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels.where("doc_id % 2 = 0"))
    out = toxicity.grade(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id")
    hit, all_toxic, wrong = out.agg(F.count_if(F.expr("truth = 1 and toxic")), F.count_if(F.expr("truth = 1")), F.count_if(F.expr("truth = 0 and toxic"))).first()
    assert hit >= 0.85 * all_toxic and wrong <= 0.01 * out.count()
    assert list(model.thresholds) == sorted(model.thresholds)


# --- language model -------------------------------------------------------------------------------------------------


def brute_kneser_ney(trusted, wanted):
    counts = {5: Counter(g for t in trusted for g in kneser_ney.grams_of(t))}
    for k in (4, 3, 2, 1):
        counts[k] = Counter()
        for g, n in counts[k + 1].items():
            counts[k][g[1:]] += n if g[1] == kneser_ney.START else 1
    d = {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (sum(1 for v in c.values() if v == j) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        raw = [1 - 2 * y * (n2 / n1 if n1 else 0), 2 - 3 * y * (n3 / n2 if n2 else 0), 3 - 4 * y * (n4 / n3 if n3 else 0)]
        d[k] = [min(max(x, 0.1), j + 1 - 0.05) for j, x in enumerate(raw)]

    by_context = {k: {} for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            by_context[k].setdefault(g[:-1], {})[g] = n

    @functools.cache
    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        lower = p(g[1:])
        inside = by_context[k].get(g[:-1])
        if not inside:
            return lower
        cut = lambda n: d[k][min(n, 3) - 1] if n else 0
        n = inside.get(g, 0)
        return (max(n - cut(n), 0) + sum(map(cut, inside.values())) * lower) / sum(inside.values())

    return {g: np.log(p(g)) for g in wanted}


def test_kneser_ney_against_brute_force(spark):
    trusted = ["abra cadabra abba", "bab aba abracadabra."]
    df = documents(spark, [*trusted, "abz qq", None]).withColumn("trusted", F.col("doc_id") < 2)
    grams = kneser_ney.gram_counts(df, "text", "trusted")
    got = {r["gram"]: r["logp"] for r in kneser_ney.probabilities(grams).collect()}
    want = brute_kneser_ney(trusted, got)
    assert set(got) == {g for t in [*trusted, "abz qq"] for g in kneser_ney.grams_of(t)}
    assert all(got[g] == pytest.approx(want[g]) for g in got)


def test_blocks_equal_broadcast_and_junk_is_rejected(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    one = {r["doc_id"]: r for r in kneser_ney.rate_by_perplexity(docs, labels).collect()}
    two = {r["doc_id"]: r for r in kneser_ney.rate_by_perplexity(docs, labels, broadcast_grams=0, broadcast_labels=0, block_bytes=50_000).collect()}
    assert one.keys() == two.keys() and all(one[k]["kept"] == two[k]["kept"] for k in one)
    assert all(one[k]["perplexity"] == pytest.approx(two[k]["perplexity"]) for k in one)
    good = [r["doc_id"] for r in labels.where("quality = 1").collect()]
    assert sum(one[k]["kept"] for k in good) >= 0.95 * len(good)
    more, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rated = kneser_ney.rate_by_perplexity(more, marks).join(marks.where("quality = 0"), "doc_id").agg(F.count(F.lit(1)), F.count_if("kept")).first()
    assert rated[1] <= 0.25 * rated[0]
    # The same from its definition: counts and probabilities of plain Python, thresholds of the held-out documents.
    hashed = docs.select("doc_id", "text", "lang", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("out")).collect()
    few = hashed[:40]
    learned = [r["text"] for r in few if r["doc_id"] in good and not r["out"]]
    logp = brute_kneser_ney(learned, {g for r in few[:12] for g in kneser_ney.grams_of(r["text"] or "")})
    table = docs.where(F.col("doc_id").isin([r["doc_id"] for r in few]))
    got = {r["doc_id"]: r for r in kneser_ney.rate_by_perplexity(table, labels).collect()}
    for r in few[:12]:
        grams = kneser_ney.grams_of(r["text"] or "")
        want = np.exp(-np.mean([logp[g] for g in grams])) if grams else None
        assert got[r["doc_id"]]["perplexity"] == (pytest.approx(want) if grams else None)
    judges = sorted(got[r["doc_id"]]["perplexity"] for r in few if r["out"] and r["doc_id"] in good) or sorted(got[r["doc_id"]]["perplexity"] for r in few if r["doc_id"] in good)
    limit = judges[int(np.ceil(0.99 * len(judges))) - 1]
    assert all(x["threshold"] == limit and x["kept"] == (x["perplexity"] is not None and x["perplexity"] <= limit) for x in got.values())


def test_grams_run_across_words():
    assert kneser_ney.grams_of(" ab\t\n c ") == ["\x02\x02\x02\x02a", "\x02\x02\x02ab", "\x02\x02ab ", "\x02ab c", "ab c "]
    assert kneser_ney.grams_of(" \n") == [] and kneser_ney.grams_of("\x00\x02")[0][-1] == "\ufffd"
    scores = kneser_ney.Scores(kneser_ney.grams_of("a b\U0001f600"), [-1.0, -2.0, -3.0, -4.0, -5.0])
    assert scores.perplexities(["a  b\U0001f600", "", None])[0] == pytest.approx(np.exp(3)) and np.isnan(scores.perplexities([None])[0])


def test_encoder_equals_tokenizer_on_odd_words():
    encoder = packing.WordEncoder(tokenizer_path())
    assert encoder.by_word
    r = random.Random(2)
    letters = "abc\u0130\u0131\u00df\u00e9\u4e2d\u01c5\u03a3\u0301\u0307.,!?'\u2019#%&<09\u0663 \n\u00a0\ufb01"
    for text in ["DEN\u0130ZL\u0130.", *("".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(4000))]:
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.text(text), "<u4").tolist() == want
    encoder.by_word = False
    assert np.frombuffer(encoder.text("Some words."), "<u4").tolist() == encoder.tokenizer.encode("Some words.", add_special_tokens=False).ids


# --- substring dedup ------------------------------------------------------------------------------------------------


def test_spliced_passages_go_and_clean_texts_stay(spark):
    passage = prose(77, 70)
    line = prose(78, 30)
    texts = [prose(k, 120) for k in range(20)]
    holders = [3, 8, 12]
    for k in holders:
        texts[k] = texts[k][:200] + " mid " + passage + " and on " + texts[k][200:]
    for k in (5, 9):
        texts[k] = texts[k] + "\n" + line + "\n" + f"tail{k}"
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    for k, text in enumerate(texts):
        r = rows[k]
        assert r["text"] == "".join(text[s["start"] : s["end"]] for s in r["kept_spans"])
        assert sum(s["end"] - s["start"] for s in r["kept_spans"]) + r["removed_chars"] == len(text)
        if k not in (8, 12, 9):
            assert r["text"] == text and r["removed_chars"] == 0
    inner = passage.split(". ")[2:-2]
    for k in (8, 12):
        assert not any(s in rows[k]["text"] for s in inner)
    assert line not in rows[9]["text"] and rows[9]["text"].endswith("tail9")


def test_whole_spliced_passages(spark):
    """Passages of 51 to 60 words that begin and end in the middle of sentences, each spliced into two texts."""
    r = random.Random(21)
    sources = [prose(3000 + k, 200).split() for k in range(100)]
    passages = []
    for k, words in enumerate(sources):
        n, at = r.randint(51, 60), r.randint(1, 100)
        passages.append(" ".join(words[at : at + n]))
    hosts = [prose(4000 + k, 150).split() for k in range(200)]
    texts = []
    for k, host in enumerate(hosts):
        at = r.randint(10, 140)
        texts.append(" ".join(host[:at]) + " " + passages[k % 100] + " " + " ".join(host[at:]))
    rows = {x["doc_id"]: x for x in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert all(rows[k]["removed_chars"] == 0 for k in range(100))
    shares = []
    for k in range(100, 200):
        start = texts[k].index(passages[k - 100])
        end = start + len(passages[k - 100])
        gone = sum(max(0, min(end, x["end"]) - max(start, x["start"])) for x in rows[k]["removed_spans"])
        shares.append(gone / (end - start))
        assert rows[k]["removed_chars"] <= end - start + 2  # nothing of the host
    assert min(shares) > 0.4 and sum(x < 0.5 for x in shares) <= 3 and sum(shares) / 100 > 0.8


def test_least_of_windows():
    r = np.random.default_rng(1)
    for n, width in ((1, 16), (15, 16), (16, 16), (40, 16), (300, 7), (70_000, 16)):
        values = r.integers(0, 50, n).astype(np.uint64)
        want = {k + int(values[k : k + width].argmin()) for k in range(max(1, n - width + 1))}
        assert set(line_dedup.least_of_windows(values, width).tolist()) == want


def normal(text):
    return " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))


def test_units_equal_brute_force_digests():
    units = line_dedup.Units()
    text = "  " + prose(5, 200) + "\n" + prose(6, 40).replace(".", "") + "\nA SHORT line has five\nfour words stay here\n" + prose(5, 200)
    start, end = units.places(text)
    one, two = units(text)
    found = [normal(text[a:b]) for a, b in zip(start, end, strict=True)]
    assert all(len(n.split()) >= 12 or n == "a short line has five" for n in found) and "a short line has five" in found
    groups = defaultdict(set)
    for n, a, b in zip(found, one.tolist(), two.tolist(), strict=True):
        groups[n].add((a, b))
    assert all(len(v) == 1 for v in groups.values()) and len({x for v in groups.values() for x in v}) == len(groups)


def brute_dedup(rows):
    """Removed characters of each (id, text), comparing normal forms of units as strings."""
    units = line_dedup.Units()
    ranked = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][2]))
    first, out = {}, {}
    for k in ranked:
        key, text, mark = rows[k]
        gone = []
        for number, (a, b) in enumerate(zip(*(x.tolist() for x in units.places(text)), strict=True)):
            here = (key, mark, number)
            if first.setdefault(normal(text[a:b]), here) != here:
                gone.append((a, b))
        out[k] = sum(b - a for a, b in line_dedup.removed_spans(text, gone)) if text else 0
    return [out[k] for k in range(len(rows))]


@pytest.mark.parametrize("stretch", [100_000, 40])
def test_dedup_against_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(line_dedup, "STRETCH", stretch)
    r = random.Random(4)
    pool = [prose(k, 14) for k in range(12)] + ["News of the week: subscribe now to our letter", "Read more here", "ab ab ab ab ab ab ab ab ab ab ab ab ab ab"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 6))) + "\n" + prose(100 + k, 30) for k in range(80)] + [None, "", "x"]
    rows = [(None if k % 9 == 0 else k % 70, t) for k, t in enumerate(texts)]
    rows += rows[:12]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = line_dedup.dedup_lines(df).select("*", F.xxhash64("text").alias("after")).collect()
    marks = {(x["doc_id"], x["text"]): x["mark"] for x in df.select("doc_id", "text", F.xxhash64("text").alias("mark")).collect()}
    marked = [(*x, marks[x]) for x in rows]
    want = Counter((x[0], gone, len(x[1] or "") - gone) for x, gone in zip(marked, brute_dedup(marked), strict=True))
    assert Counter((x["doc_id"], x["removed_chars"], len(x["text"] or "")) for x in out) == want


def test_short_lines_and_null_ids(spark):
    line = "Sign up for our weekly letter by mail today"
    texts = [line + "\n" + prose(k, 60) for k in range(20)]
    rows = line_dedup.dedup_lines(documents(spark, texts)).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["doc_id"]) if r["removed_chars"] == 0] == [0]
    assert all(r["text"] == prose(r["doc_id"], 60) for r in rows if r["doc_id"])
    same = prose(500, 40)
    nulls = spark.createDataFrame([(None, same + "\n" + prose(501 + k, 40)) for k in range(2)], "doc_id long, text string")
    assert sorted(r["removed_chars"] > 0 for r in line_dedup.dedup_lines(nulls).collect()) == [False, True]


def test_every_removed_sentence_stays_somewhere(spark):
    r = random.Random(11)
    pool = [prose(k, 15) + "." for k in range(30)]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(60)]
    kept = " ".join(x["text"] for x in line_dedup.dedup_lines(documents(spark, texts)).collect())
    assert all(s in kept for s in pool if any(s in t for t in texts))


# --- n-gram join ----------------------------------------------------------------------------------------------------


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_groups(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(len(sets[k]), find(k)) for k in range(len(texts))]


def edited(text, seed, n):
    r = random.Random(seed)
    words = text.split()
    for _ in range(n):
        k = r.randrange(len(words))
        words[k] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def near_copies():
    texts = [prose(k, 6 + 13 * k) for k in range(12)]
    for k in range(40):
        base = texts[k % 12]
        texts.append(edited(base, k, max(1, len(base.split()) // (25 + k % 30))))
    for k in range(60):  # a large group in which not all are linked to one
        texts.append(edited(texts[10], 1000 + k, 1 + k % 4))
    passage = prose(500, 60)
    texts += [passage + " " + prose(600 + k, 20 + k % 15) for k in range(50)]  # one passage, different documents
    texts += ["a b c d", "A b  c d", "a b c", "", None, "a b c d e", "a b c d e f", "x y z w v u t", "x y z w v u t s"]
    return texts


@pytest.mark.parametrize(("light", "block_rows"), [(8, 4096), (8, 128), (2, 16)])
def test_join_against_all_pairs(spark, light, block_rows):
    texts = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(documents(spark, texts), light=light, block_rows=block_rows).collect()}
    assert [got[k] for k in range(len(texts))] == brute_groups(texts)


def used_signatures(sig, place, common):
    """What a set is compared by, from the definition: its first k + 1 signatures in each band, common ones last."""
    roles = {}
    for s, p in zip(sig.view(np.int64).tolist(), place.tolist(), strict=True):
        late = (p & ((1 << 28) - 1)) - (1 << 27)
        roles.setdefault(p >> 28, []).append((s in common, late, s))
    out = set()
    for role, rows in roles.items():
        slack = role & ((1 << 28) - 1)
        rows.sort()
        out |= {s for _, _, s in rows[: len(rows) - slack]}
    return out


def test_similar_sets_share_a_signature_whatever_is_common():
    r = np.random.default_rng(6)
    signatures = ngram_join.Signatures()
    for size in (4, 5, 6, 9, 20, 33, 64, 130, 400):
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
            most = ngram_join.most_differences(len(a))
            out = int(r.integers(0, most + 1))
            both = a[out:] if out < len(a) else a[:1]
            b = np.unique(np.concatenate((both, r.integers(0, 2**63, int(r.integers(0, most - out + 1)), dtype=np.uint64))))
            inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 5 * inter >= 4 * union and inter < union:
                one, two = signatures(a), signatures(b)
                every = np.concatenate((one[0], two[0])).view(np.int64)
                common = set(every[r.random(len(every)) < r.random()].tolist())
                assert used_signatures(*one, common) & used_signatures(*two, common), size


def test_shared_signatures_follow_the_definition(spark):
    sets = {k: ngram_join.Shingles()(t) for k, t in enumerate(near_copies()) if t}
    signatures = ngram_join.Signatures()
    made = {k: signatures(e) for k, e in sets.items()}
    holders = {}
    for k, (sig, _) in made.items():
        for s in sig.view(np.int64).tolist():
            holders.setdefault(s, set()).add(k)
    common = {s for s, h in holders.items() if len(h) > 3}
    want = {(s, k) for k, (sig, place) in made.items() for s in used_signatures(sig, place, common) if len(holders[s]) > 1}
    rows = [(s, k, p) for k, (sig, place) in made.items() for s, p in zip(sig.view(np.int64).tolist(), place.tolist(), strict=True)]
    got = ngram_join.shared_signatures(spark.createDataFrame(rows + rows[:50], "sig long, node long, place long"), 3).collect()
    assert {(r["sig"], r["node"]) for r in got} == want
    assert all(r["common"] == (r["sig"] in common) for r in got)


def test_span_hash_is_of_the_span_alone():
    h = SpanHash(3)
    data, starts, ends = normal_words("To be OR not to be, to be or not to be")
    got = h.spans(h.prefix(data), starts, ends)
    words = "to be or not to be, to be or not to be".split()
    assert len(set(got.tolist())) == len(set(words))
    assert [got[k] == got[0] for k in range(len(words))] == [w == "to" for w in words]
    assert zlib.crc32(bytes(data)) == zlib.crc32(" ".join(words).encode())
