"""Periodic runs, chat formatting and token alignment against brute force, on the test tables and awkward input."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_plain_operators import AWKWARD, WORD, documents, prose
from tokenizers import Tokenizer

from framescope.llm import chat_format as chats
from framescope.llm import periodic_runs, token_alignment
from framescope.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
A, B = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def brute_runs(words, min_length=6, exponent=4):
    """Every period by itself; a stretch that a smaller period fills too has that one."""
    ids = np.array([hash(w) for w in words], dtype=np.int64)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // exponent + 1):
        same = np.concatenate(([0], ids[:-q] == ids[q:], [0]))
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for s, e in zip(starts.tolist(), (ends + q).tolist(), strict=True):
            if e - s >= max(min_length, exponent * q):
                found.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapse(words, runs):
    drop = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in drop)


def test_runs_of_random_texts():
    r = random.Random(4)
    texts = [t for t in AWKWARD if t is None or len(t) < 5000]
    for k in range(300):
        words = [r.choice("ab" if k % 3 else "abcd") for _ in range(r.randint(0, 60))]
        if k % 2:
            block = words[: r.randint(1, 9)]
            words = words + block * r.randint(2, 9) + block[: r.randint(0, len(block))] + words
        texts.append(" ".join(words))
    for text in texts:
        words = WORD.findall(text or "")
        n, runs, collapsed = periodic_runs.text_runs(text)
        assert (n, runs) == (len(words), brute_runs(words))
        assert collapsed == brute_collapse(words, runs)


def test_runs_when_hashes_deceive():
    # Prefix hashes modulo a power of two can't tell the two halves of this sequence apart.
    words = [str(k.bit_count() % 2) for k in range(1 << 13)]
    assert periodic_runs.text_runs(" ".join(words))[1] == brute_runs(words)
    block = words[:2048]
    twice = [*block, *(str(1 - int(w)) for w in block)] * 2 + ["x"]
    assert periodic_runs.text_runs(" ".join(twice))[1] == brute_runs(twice)


def test_long_runs_and_slices(monkeypatch):
    words = ["a"] * 20_000 + [f"w{k}" for k in range(300)] * 20 + ["b", "a"] * 3_000
    want = periodic_runs.text_runs(" ".join(words))
    assert [(s, q) for s, _, q in want[1]] == [(0, 1), (20_000, 300), (26_000, 2)]
    monkeypatch.setattr(periodic_runs, "PAIRS", 1000)
    assert periodic_runs.text_runs(" ".join(words)) == want


def test_periodic_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert got.keys() == docs.keys()
    planted = 0
    for k, text in docs.items():
        words, h = WORD.findall(text or ""), zlib.crc32(str(k).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        planted += h % 10 == 0 and len(runs) > 0
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        want += (sha("".join("%d,%d,%d\n" % x for x in runs)), sha(brute_collapse(words, runs)))
        assert tuple(got[k])[1:] == want
    assert planted > 3


@pytest.mark.parametrize("text", [*AWKWARD, "</s>", "<s>[INST]", "[\\INST] <\\\\/s> [/SYS", "[TURN] a [SAYS] b [/TURN]", "\\[INST]\\", " </s", "[INST", "<" * 9 + "/s>"])
def test_escapes_come_back(text):
    text = text or ""
    assert chats.unescape(chats.escape(text)) == text
    turns = [("user", text), ("assistant", text), ("system", text), (text, text), ("assistant", text), ("user", "s>")]
    assert chats.read(chats.render(turns)) == turns


def test_control_strings_at_random():
    r = random.Random(8)
    atoms = ["[", "]", "<", ">", "/", "\\", "INST", "s", "SYS", "[INST]", "</s>", " ", "a", "[/INST] ", ""]
    for _ in range(2000):
        turns = [(r.choice(["user", "assistant", "system", "", "tool", "[SAYS]"]), "".join(r.choices(atoms, k=r.randint(0, 8)))) for _ in range(r.randint(1, 5))]
        text = chats.render(turns)
        assert chats.read(text) == turns
        made = chats.render_prefixes(chats.Template(), turns)
        assert made.text == text and not made.rewrites
        loss = [chats.unescape(text[x[0] : x[1]]) for x in made.losses if x]
        assert loss == [t for role, t in turns if role == "assistant"]
        assert made.spans[0][0] == 0 and made.spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(made.spans, made.spans[1:], strict=False))


def _forgetful():
    def render(turns):  # a function in a function goes to the workers by value
        last = max((k for k, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
        return "".join(f"<{role}>{text if role != 'assistant' or k == last else '...'}" for k, (role, text) in enumerate(turns))

    return render


#: Keeps only the last assistant's text.
forgetful = _forgetful()


def counting(turns):
    return "".join(f"<{k}{role}>{text}" for k, (role, text) in enumerate(turns))


def clipping(turns):
    return "".join(f"<{role}>{text[:3]}" for role, text in turns)


def test_templates_that_rewrite_history():
    turns = [("user", "hello"), ("assistant", "there"), ("user", "x"), ("assistant", "y")]
    assert chats.render_prefixes(chats.Template(forgetful), turns).rewrites == 1
    assert chats.render_prefixes(chats.Template(forgetful), turns[:3]).rewrites == 0
    made = chats.render_prefixes(chats.Template(counting), turns)
    assert made.rewrites == 0 and [made.text[a:b] for a, b in filter(None, made.losses)] == ["there", "y"]
    assert chats.render_part(chats.Template(counting), turns)[1].rewrites == 1  # turns look different behind others
    made = chats.render_part(chats.Template(clipping), turns)[1]
    assert made.rewrites == 0 and [made.text[a:b] for a, b in filter(None, made.losses)] == ["the", "y"]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def plain_digests(rows):
    """Per conversation: turns, digest of turns, length and digest of the assistants' texts."""
    out = {}
    low = lambda v: (v is not None, v)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (low(r[1]), low(r[2]), low(r[3])))
        said = "".join(t or "" for _, _, role, t in own if role == "assistant")
        out[conv] = (len(own), sha("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own)), len(said), sha(said))
    return out


def digests(df, **more):
    return {r.conv_id: tuple(r)[1:5] for r in chats.read_back(chats.format_conversations(df, **more)).collect()}


def test_conversations_of_every_kind(spark, monkeypatch):
    r = random.Random(2)
    rows = [(1, k, ("user", "assistant")[k % 2], prose(k, 3)) for k in range(1000)]
    rows += [(2, 0, "assistant", t) for t in AWKWARD] + [(3, None, None, None), (3, 1, "user", "</s>"), (None, 0, "assistant", "x")]
    rows += [(4, -3, "user", "a"), (4, 700, "assistant", "b"), (5, 900, "assistant", ""), (6, 7, "tool", "[SAYS] x"), (6, 7, "tool", "[SAYS] x")]
    rows += [(7, 5, "user", f"{k}") for k in range(300)]
    r.shuffle(rows)
    df = conversations(spark, rows).repartition(5)
    want = plain_digests(rows)
    assert digests(df) == want
    assert digests(df, block=3) == want
    assert digests(df.withColumn("part", F.lit("own")).withColumn("formatted", F.lit(1)).withColumn("whole", F.lit(2))) == want
    parts = chats.format_conversations(df, block=16).where("conv_id = 1").orderBy("block", "part").collect()
    assert len(parts) == 63 and not any(p.whole for p in parts)
    text = parts[0].opening + "".join(p.formatted for p in parts)
    assert chats.read(text) == [(role, t) for _, _, role, t in sorted(x for x in rows if x[0] == 1)]
    assert digests(df.where("false")) == {}


def test_rewritten_conversations_carry_no_loss(spark):
    df = conversations(spark, [(k, t, ("user", "assistant")[t % 2], f"t{t}") for k in (1, 2) for t in range(2 * k)])
    got = {r.conv_id: r for r in chats.format_conversations(df, chats.Template(forgetful, stand_in=())).collect()}
    assert got[1].rewrites == 0 and len(got[1].losses) == 1
    assert got[2].rewrites == 1 and got[2].losses == [] and {tuple(s) for s in got[2].spans} == {(0, 0)}


def brute_alignment(texts):
    """Whole texts through both tokenizers, bytes compared one by one."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = token_alignment._byte_letters()
    rows, count = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b.id_to_piece(k)) for k in ids_b)]
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            rows.append(([], [], []))
            continue
        owner_a, owner_b = ([k for k, x in enumerate(raw) for _ in x] for raw in (raw_a, raw_b))
        links = [(ids_a[x], ids_b[y]) for x, y in sorted(set(zip(owner_a, owner_b, strict=True)))]
        groups, last_a, last_b = [], 0, 0
        for k in range(1, len(want) + 1):
            if k == len(want) or (owner_a[k] != owner_a[k - 1] and owner_b[k] != owner_b[k - 1]):
                end_a, end_b = owner_a[k - 1] + 1, owner_b[k - 1] + 1
                groups.append((ids_a[last_a:end_a], ids_b[last_b:end_b]))
                last_a, last_b = end_a, end_b
        rows.append((ids_a, ids_b, groups, links))
        count.update(links)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for ids_a, ids_b, groups, *rest in rows:
        links = rest[0] if rest else []
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), text))
    return out


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(docs, brute_alignment([r.text for r in docs]), strict=True)}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_token_alignment"](spark, SMALL).collect()}
    assert got == {k: (*x[:6], sha(x[6]) if x[6] else "") for k, x in want.items()}


ODD = ["a  b\n\n c \t d", " ", "\n", "a ", " a", "▁x", "a▁b c", "<|endoftext|> <s></s> <unk> <0x41>", "x\r\n y", " a   b　 c", "café é \U0001f600\U0001f468‍\U0001f469", "\x00 \x1c a\x1fb \x85c", "don't we'll  'tis", "1234 56.78 ;\r\n\t)", "\n\n  lead", "tail  \n", "a b  "]


@pytest.mark.parametrize("broadcast_pairs", [0, 2_000_000])
@pytest.mark.parametrize("block_chars", [40, 1 << 25])
def test_alignment_of_odd_texts(spark, broadcast_pairs, block_chars):
    r = random.Random(6)
    atoms = [" ", "  ", "\n", "\t", "\r", "a", "the", "ing", "'s", "1", ".", "é", " ", "\U0001f600", "\x1c", "()", ");\r", " ", "zz"]
    texts = [*AWKWARD[:-1], *ODD, *("".join(r.choices(atoms, k=r.randint(1, 14))) for _ in range(250)), prose(3, 300), prose(3, 300)]
    df = documents(spark, texts).select("doc_id", "text").repartition(3)
    got = token_alignment.align_tokens(df, A, B, block_chars=block_chars, broadcast_pairs=broadcast_pairs)
    rows = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    want = brute_alignment(texts)
    assert all(rows[k] == want[k] for k in range(len(texts))) and len(rows) == len(texts)


def test_borders_follow_the_vocabularies():
    t = token_alignment.tokenizers(A, B)
    assert t.segments("ab  cd\nef \n g ") == [" ab", "  cd", "\nef", " \n g", " "]
    cut = token_alignment.Borders(["x y", "a"], ["b\n", "b"])
    assert cut("x x z b\nc") == [" x x z", " b\nc"]
