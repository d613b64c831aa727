"""DuckDB SQL for the queries that SQL can express, over whole tables. doc_id and page_id are keys of their tables."""

from __future__ import annotations

from .quality import STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') w FROM documents),
win AS (SELECT doc_id, s, w[s:s + 12] g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) s FROM d)),
small AS (SELECT g, min(doc_id) m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) p FROM win JOIN small USING (g) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(w) x, generate_subscripts(w, 1) p FROM d),
kept AS (SELECT doc_id, count(*) n, string_agg(x, ' ' ORDER BY p) t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_WORD}') w FROM documents),
lines AS (SELECT doc_id, count(*) n, count(*) - count(DISTINCT x) dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY doc_id),
win AS (SELECT doc_id, s, w[s:s + 7] g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) s FROM d)),
twice AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) c FROM win),
again AS (SELECT doc_id, count(*) n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + 8)) p FROM twice WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
  coalesce(l.n, 0) n_lines, coalesce(l.dup, 0) n_dup_lines, coalesce(a.n, 0) n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) n_stop
  FROM d LEFT JOIN lines l USING (doc_id) LEFT JOIN again a USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_stop,
  NOT base_failed AND word_chars >= 1.5 * n_words AND word_chars <= 20 * n_words AND n_symbols <= 0.25 * n_words AND 100 * n_stop >= n_words AND n_dup_lines <= 0.5 * n_lines AS kept
FROM b"""

# Texts as hexadecimal digits, two a byte, cut into blocks that overlap, so that no string is sought from a far start.
OP4 = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
blocks AS (SELECT doc_id, n, b, h[2 * b + 1:2 * b + 1398] x FROM (SELECT doc_id, n, h, unnest(range(0, n, 500)) b FROM n)),
win AS (SELECT doc_id, b + i AS s, md5(x[2 * i + 1:2 * i + 400]) g FROM (SELECT doc_id, n, b, x, unnest(range(0, least(500, n - 199 - b))) i FROM blocks)),
again AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) before FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY g) c FROM win) WHERE c > 1),
numbered AS (SELECT doc_id, s, sum(CASE WHEN s <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) k FROM again),
spans AS (SELECT doc_id, k, min(s) a, max(s) + 200 z FROM numbered GROUP BY doc_id, k),
cut AS (SELECT doc_id, count(*) n_spans, sum(z - a) n_removed FROM spans GROUP BY doc_id),
gaps AS (SELECT doc_id, z AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY z), n) z FROM (SELECT doc_id, a, z FROM spans UNION ALL SELECT doc_id, -1, 0 FROM n) JOIN n USING (doc_id)),
kept AS (SELECT doc_id, string_agg(h[2 * a + 1:2 * z], '' ORDER BY a) t FROM gaps JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM n LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP5 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) payload_digest,
  regexp_replace(regexp_replace(lower(coalesce(url, '')), '#.*$', ''), '^[a-z][a-z0-9+.-]*://(?:www\d*\.)?', '') bare FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to,
  array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(bare, '^[^/?]*', 0), ':(80|443)$', ''), '.')), ',') || ')' || regexp_replace(bare, '^[^/?]*', '') AS url_key
FROM k"""

OP10 = rf"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} w FROM documents),
i AS (SELECT item_id, {_ITEM_WORDS} w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s:s + 12] g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, n, w[s:s + n - 1] g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM d, (SELECT DISTINCT len(g) n FROM win))),
hit AS (SELECT doc_id, s, n, item_id FROM dw JOIN win USING (g)),
covered AS (SELECT doc_id, count(*) n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP11 = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
met AS (SELECT vec_id a, vec_id b FROM embeddings UNION SELECT m.a, l.b FROM met m JOIN links l ON m.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, r.c AS component_id, e.vec_id = r.c AS kept FROM embeddings e
LEFT JOIN (SELECT a, count(*) n FROM links GROUP BY a) n ON n.a = e.vec_id JOIN (SELECT a, min(b) c FROM met GROUP BY a) r ON r.a = e.vec_id"""

# CRC-32 byte by byte over UTF-8, from its table of 256 remainders; words with one code point left out, by its place, tell
# both kinds of single edits.
OP12 = """
WITH RECURSIVE bits AS (SELECT i, i::ubigint c, 0 k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::ubigint) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, w, count(*) n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w FROM documents) GROUP BY ALL),
bytes AS (SELECT doc_id, w, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || w)) x FROM runs),
crc AS (SELECT doc_id, w, n, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, len(x)::bigint, 2), lambda i: ('0x' || x[i:i + 1])::ubigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::bigint + 1])), 4294967295::ubigint) h FROM bytes, tab),
words AS MATERIALIZED (SELECT CASE WHEN h % 97 = 0 THEN w[1:(h % length(w))::bigint] || w[(h % length(w))::bigint + 2:] ELSE w END AS word, sum(n)::bigint n FROM crc GROUP BY 1),
v AS MATERIALIZED (SELECT * FROM words WHERE n >= 3 AND length(word) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] d FROM v, range(1, length(word) + 1) t(i)),
pairs AS (SELECT a.word w, b.word o, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.d = b.word),
near AS (SELECT w, count(*) n_near, max(n) m, arg_min(o, (-n, o)) f FROM pairs GROUP BY w),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) n_near, CASE WHEN m >= 2 * v.n THEN f END form, CASE WHEN m >= 2 * v.n THEN m END form_n FROM v LEFT JOIN near ON near.w = v.word),
path AS (SELECT word, word AS step, 0 k FROM forms UNION ALL SELECT p.word, f.form, k + 1 FROM path p JOIN forms f ON f.word = p.step WHERE f.form IS NOT NULL)
SELECT f.word, form, r.root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(step, k) root FROM path GROUP BY word) r USING (word)"""


def _rounds() -> str:
    """The four rounds of OP13, each one nearest entry and one mean after the other."""
    out = []
    for k in range(5):
        out.append(f"""near{k} AS MATERIALIZED (SELECT q.vec_id, q.part, arg_min(c.entry, (q.s - 2 * list_inner_product(q.x, c.x) + c.s, c.entry)) entry, min(q.s - 2 * list_inner_product(q.x, c.x) + c.s)::bigint d FROM p q JOIN (SELECT *, list_inner_product(x, x) s FROM book{k}) c USING (part) GROUP BY q.vec_id, q.part)""")
        if k < 4:
            out.append(f"""book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) x FROM book{k} b LEFT JOIN (SELECT part, entry, list(z ORDER BY j) x FROM
  (SELECT part, entry, j, floor(sum(p.x[j]) / count(*)) z FROM near{k} JOIN p USING (vec_id, part), range(1, len(p.x) + 1) t(j) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))""")
    return ",\n".join(out)


OP13 = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT *, list_inner_product(x, x) s FROM (SELECT vec_id, part, e[part * len(e) // 4 + 1:(part + 1) * len(e) // 4] x FROM v, range(4) t(part))),
book0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 256) USING (vec_id)),
{_rounds()},
each AS (SELECT vec_id, string_agg(printf('%02x', entry::integer), '' ORDER BY part) code, sum(d)::bigint error FROM near4 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
  (SELECT sha256(string_agg(c::bigint::varchar, ',' ORDER BY part, entry, j)) FROM (SELECT part, entry, unnest(x) c, generate_subscripts(x, 1) j FROM book4)) AS codebooks_sha256 FROM each JOIN v USING (vec_id)"""


ORACLE_SQL = {"op2_substrings": OP2, "op3_quality_rules": OP3, "op4_suffix_arrays": OP4, "op5_warc": OP5, "op10_decontamination": OP10, "op11_embeddings": OP11, "op12_spelling": OP12, "op13_codebooks": OP13}
