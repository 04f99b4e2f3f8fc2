"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

# Sources fill up in the order of cap over weight; one is full if the level that the rest would get is above its cap.
MIXING = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len({_WORDS.format(text="text")}), 0) AS size,
    (CAST('0x' || substr(md5('17|' || doc_id || '|' || coalesce(md5(text), '~')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place FROM w),
l AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM r),
f AS (SELECT *, rest / weights * weight > 2 * source_size AS full_ FROM l),
t AS (SELECT source, source_size, CASE WHEN full_ THEN 2.0::DOUBLE * source_size ELSE (SELECT rest / weights FROM f WHERE NOT full_ ORDER BY place LIMIT 1) * weight END AS target FROM f),
m AS (SELECT source, CASE WHEN sum(size) > 0 THEN sum(size::DOUBLE * size) / sum(size)::DOUBLE ELSE 1 END AS mean FROM d GROUP BY source),
j AS (SELECT d.*, source_size, target, mean, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN m ON d.source IS NOT DISTINCT FROM m.source),
q AS (SELECT *, CASE WHEN ratio > floor(ratio) AND size > 0 THEN (u / (1 - u)) / ((ratio - floor(ratio)) / (1 - (ratio - floor(ratio))) * (size / mean)) END AS rank FROM j),
k AS (SELECT *, CAST(floor(ratio) AS BIGINT) AS whole, target - sum(floor(ratio) * size) OVER (PARTITION BY source) AS want,
    sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM q)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN rank IS NOT NULL AND 2 * before + size <= 2 * want THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM k
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c WHERE 100 * common >= 80 * (na + nb - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)), doc_id) AS component_id FROM g
"""


def _base32(digest: str) -> str:
    """Base 32 of a 40-digit hexadecimal number, four letters from each five digits."""
    letters = []
    for k in range(8):
        v = f"CAST('0x' || substr({digest}, {1 + 5 * k}, 5) AS INT)"
        letters += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({v} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(letters)


ARCHIVES = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, {_base32("h")} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\[])(\\*)(/?(?:INST|SYS|TURN|SAYS)\]|/?s>)', '\1\\\2\3', 'g')"


CHATS = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
    UNION ALL SELECT -7, k, ['user', 'assistant'][k + 1], '</s>[INST] ok [/INST]', ['user', 'assistant'][k + 1], '</s>[INST] ok [/INST]' FROM range(2) AS x(k))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(3 + sum(length({_escaped("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 6 ELSE 23 + length({_escaped("role")}) END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLES = {"op5_mix_sources": MIXING, "op6_ngram_jaccard": JACCARD, "op8_warc_archives": ARCHIVES, "op11_chat_format": CHATS}
