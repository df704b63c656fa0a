"""DuckDB SQL with the rows of the queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


_SPACED, _PLAIN = r"'[^\x20\x09-\x0D]+'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NGRAM_JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_low('text')}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [len(w) || ' words: ' || array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n u ON u.doc_id = x.doc_id JOIN n v ON v.doc_id = y.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(u.n) + any_value(v.n) - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY 1) USING (doc_id)"""

WARC = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages), q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM m"""

HOST_RULES = f"""WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_SPACED}) GROUP BY 1),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
a AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM a) GROUP BY 1),
c AS (SELECT doc_id, host, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY 1),
m AS (SELECT least(greatest(sum(f) / sum(n), 0.000001), 0.999999) AS mean, coalesce(var_samp(f / n), 0) AS var, avg(1 / n) AS inv FROM h),
k AS (SELECT mean, CASE WHEN var - mean * (1 - mean) * inv > 1e-9 THEN greatest(mean * (1 - mean) / (var - mean * (1 - mean) * inv) - 1, 1.0) ELSE 1e6 END AS strength FROM m)
SELECT doc_id, b.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round((f + mean * strength) / (n + strength), 6) AS host_rate, NOT base_failed AND ((f + mean * strength) / (n + strength) <= 0.5 OR b.host IS NULL) AS kept FROM b JOIN h ON b.host IS NOT DISTINCT FROM h.host, k"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_low('text')}, {_PLAIN}) AS w FROM documents), b AS (SELECT item_id, regexp_extract_all({_low('text')}, {_PLAIN}) AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
f AS (SELECT doc_id, x.n, k, item_id FROM x JOIN i ON x.n = i.n AND x.g = i.g),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS pos FROM f) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM f GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

_DISTANCE = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"


def _assigned(k: int) -> str:
    return f"a{k} AS MATERIALIZED (SELECT row, p, min(struct_pack(err := {_DISTANCE}, e := e)) AS m FROM parts JOIN c{k} USING (p) GROUP BY 1, 2)"


def _refined(k: int) -> str:
    return f"""s{k} AS (SELECT p, e, i, (s - ((s % n) + n) % n) // n AS v FROM (SELECT p, m.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{k} JOIN parts USING (row, p), unnest(range(1, len(x) + 1)) AS t(i) GROUP BY 1, 2, 3)),
c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(any_value(u.c), any_value(o.c)) AS c FROM c{k} o LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS c FROM s{k} GROUP BY 1, 2) u USING (p, e) GROUP BY 1, 2)"""


VECTOR_CODES = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, vec_id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM kept, range(16) AS t(p)),
c0 AS MATERIALIZED (SELECT p, rank - 1 AS e, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM kept QUALIFY rank <= 64) USING (vec_id)),
{_assigned(0)}, {_refined(0)}, {_assigned(1)}, {_refined(1)}, {_assigned(2)},
o AS (SELECT row, string_agg(lpad(to_hex(m.e), 2, '0'), '' ORDER BY p) AS code, sum(m.err)::BIGINT AS error FROM a2 GROUP BY 1),
h AS (SELECT sha256(string_agg(c[i]::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c2, unnest(range(1, len(c) + 1)) AS t(i))
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN o USING (row), h"""

#: CRC-32 in SQL: a table of 256 steps, folded over the bytes; runs have one or two bytes a code point.
SPELLING = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda k: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k::BIGINT)) AS t),
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_low('text')}, '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
b AS (SELECT run, k, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END)) AS bytes FROM r),
d AS (SELECT run, k, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM b, crc),
w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM d) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
g AS MATERIALIZED (SELECT DISTINCT word, p, word[:p - 1] AS a, word[p + 1:] AS z FROM w, unnest(range(1, length(word) + 1)) AS t(p)),
e AS MATERIALIZED (SELECT DISTINCT x.word, w.word AS near FROM g x JOIN w ON w.word = x.a || x.z UNION SELECT DISTINCT w.word, x.word FROM g x JOIN w ON w.word = x.a || x.z UNION SELECT x.word, y.word FROM g x JOIN g y ON x.p = y.p AND x.a = y.a AND x.z = y.z AND x.word <> y.word),
f AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM (SELECT w.word, any_value(w.n) AS n, count(v.word) AS n_near, max(v.n) AS form_n, min(struct_pack(less := -v.n, form := v.word)).form AS form FROM w LEFT JOIN e USING (word) LEFT JOIN w v ON v.word = e.near GROUP BY 1)),
c(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word) JOIN f z ON z.word = c.root WHERE z.form IS NULL"""

SQL = {"op4_ngram_jaccard": NGRAM_JACCARD, "op5_warc": WARC, "op8_host_rules": HOST_RULES, "op10_decontamination": DECONTAMINATION, "op11_vector_codes": VECTOR_CODES, "op13_spelling_variants": SPELLING}
