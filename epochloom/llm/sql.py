"""DuckDB twins of the operators that SQL can express."""

from __future__ import annotations

from .quality_rules import BOILERPLATE

_PHRASES = " OR ".join("contains({{0}}, '{}')".format(p.replace("'", "''")) for p in BOILERPLATE)
_W = r"'[^\x20\x09-\x0D]+'"
#: A line with a mark after each sentence; twice, as matches of one pass don't share characters.
_MARKED = "line"
for _ in range(2):
    _MARKED = rf"regexp_replace({_MARKED}, '([.!?…][ \t])([^ \t])', '\1' || chr(57344) || '\2', 'g')"
_MARKED = rf"regexp_replace({_MARKED}, '([。！？])', '\1' || chr(57344), 'g')"

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
wl AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
w AS (SELECT rid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM wl),
g AS (SELECT rid, i, w AS a, lead(w, 1) OVER z AS b, lead(w, 2) OVER z AS c, lead(w, 3) OVER z AS e, lead(w, 4) OVER z AS f FROM w WINDOW z AS (PARTITION BY rid ORDER BY i)),
k AS (SELECT *, count(*) OVER (PARTITION BY rid, a, b, c, e, f) AS n FROM g WHERE f IS NOT NULL),
rp AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM k, (SELECT unnest(range(5)) AS o) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT rid, line, lower(line) AS low, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
lv AS (SELECT rid, line, len(w) AS n, CASE
    WHEN length(regexp_replace(line, '[^|]', '', 'g')) >= 3 THEN 'navigation'
    WHEN length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > 0.5 * len(w) THEN 'symbols'
    WHEN len(w) >= 4 AND len(list_filter(w, lambda x: regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) > 0.6 * len(w) THEN 'shouting'
    WHEN {_PHRASES.format('low')} THEN 'boilerplate'
    WHEN len(w) >= 8 AND NOT regexp_matches(rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[.!?:;…。！？]["''”’»)\]]*$') THEN 'punctuation' END AS fault
    FROM lw WHERE len(w) > 0),
lr AS (SELECT *, CASE WHEN fault IS NULL THEN n WHEN fault = 'boilerplate' AND n >= 20 THEN len(regexp_extract_all(array_to_string(list_filter(string_split({_MARKED}, chr(57344)),
    lambda x: NOT ({_PHRASES.format('lower(x)')}) OR len(regexp_extract_all(x, {_W})) >= 20), ''), {_W})) ELSE 0 END AS n_left FROM lv),
ls AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, count(fault) AS n_lines_removed, coalesce(sum(n - n_left), 0) AS n_words_lost FROM lr GROUP BY rid),
f AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_words_lost, 0) AS n_words_lost
    FROM d JOIN wl USING (rid) LEFT JOIN rp USING (rid) LEFT JOIN ls USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, CAST(n_lines_removed AS BIGINT) AS n_lines_removed, CAST(n_words_lost AS BIGINT) AS n_words_lost,
    (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words_lost <= 0.5 * n_words AND n_words - n_words_lost >= 10) AS kept FROM f
"""

SUFFIX_ARRAY = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT rid, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT rid, doc_id, h, unnest(range(length(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
hit AS (SELECT rid, i, i > coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -1000) + 50 AS fresh FROM g JOIN m USING (s) WHERE first < doc_id),
sp AS (SELECT rid, min(i) AS s, max(i) + 50 AS e FROM (SELECT rid, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY rid ORDER BY i) AS k FROM hit) GROUP BY rid, k),
gap AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS before FROM sp),
kept AS (SELECT rid, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS k, sum(e - s) AS n_removed, count(*) AS n_spans FROM gap JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_NORMAL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
it AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i + 1 : i + 13], ' ') AS win FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 12))) AS i FROM it WHERE len(w) > 0)),
dw AS (SELECT rid, i, size, array_to_string(w[i + 1 : i + size], ' ') AS win FROM (SELECT rid, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM iw))),
hit AS (SELECT rid, i, dw.size, item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN ids USING (rid)
"""

TIERED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
dn AS (SELECT rid, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
z AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM dn),
it AS (SELECT row_number() OVER () AS iid, item_id, w FROM (SELECT DISTINCT item_id, {_WORDS} AS w, text FROM benchmark)),
q AS (SELECT iid, t, count(*) AS k FROM (SELECT iid, unnest(w) AS t FROM it) GROUP BY iid, t),
p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM dn) WHERE t IN (SELECT t FROM q) GROUP BY rid, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY t),
m AS (SELECT rid, doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM dn, z),
v AS (SELECT p.rid, m.doc_id, p.t, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS v FROM p JOIN f USING (t) JOIN m USING (rid)),
s AS (SELECT iid, rid, any_value(doc_id) AS doc_id, CAST(sum(k * v) AS BIGINT) AS score FROM q JOIN v USING (t) GROUP BY iid, rid),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r JOIN it USING (iid) WHERE rank <= 20
"""

JACCARD_JOIN = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, list_sort(list_distinct(list_transform(range(greatest(len(w) - 4, least(len(w), 1))), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) AS s FROM d),
c AS MATERIALIZED (SELECT row_number() OVER () AS cid, s, min(doc_id) AS first FROM s WHERE len(s) > 0 GROUP BY s),
g AS MATERIALIZED (SELECT cid, len(s) AS n, unnest(s) AS g FROM c),
p AS (SELECT x.cid AS a, y.cid AS b, x.n AS na, y.n AS nb, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.cid < y.cid GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * o >= 80 * (na + nb - o)),
ed AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT cid, cid FROM c UNION SELECT r.a, ed.b FROM r JOIN ed ON r.b = ed.a),
root AS (SELECT r.a AS cid, min(c.first) AS component_id FROM r JOIN c ON c.cid = r.b GROUP BY r.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE component_id END AS component_id
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN root USING (cid)
"""

_TRACKING = "['fbclid', 'gclid', 'ref', 'sessionid', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term']"



def _percents(x: str) -> str:
    """Needless percent-encodings undone, the others in capitals."""
    code = "chr(try_cast('0x' || substr(s, 1, 2) AS INT))"
    coded = f"CASE WHEN regexp_full_match({code}, '[A-Za-z0-9._~-]') THEN {code} ELSE '%' || upper(substr(s, 1, 2)) END || substr(s, 3)"
    return f"array_to_string(list_transform(string_split({x}, '%'), lambda s, i: CASE WHEN i = 1 THEN s WHEN regexp_matches(s, '^[0-9A-Fa-f]{{2}}') THEN {coded} ELSE '%' || s END), '')"


_PATH = "list_reduce(list_transform(string_split(" + _percents("regexp_extract(bare, '^[^/?]*([^?]*)', 1)") + ", '/'), lambda y: [y]), lambda a, y: CASE WHEN y[1] = '.' THEN a WHEN y[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE list_concat(a, y) END)"

WARC = rf"""
WITH p0 AS (SELECT page_id, coalesce(html, '') AS body, regexp_replace(trim(url), '#.*$', '') AS whole FROM pages WHERE page_id IS NOT NULL),
p AS (SELECT page_id, body, lower(regexp_extract(whole, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(whole, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM p0),
q AS (SELECT *, list_sort(list_transform(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT list_contains({_TRACKING}, lower(regexp_extract(x, '^[^=]*', 0)))), lambda x: {_percents("x")})) AS pars FROM p),
u AS (SELECT page_id, body, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), CASE WHEN scheme = 'https' THEN ':443$' ELSE ':80$' END, ''), '^www\.', '') || regexp_replace(array_to_string({_PATH}, '/'), '/+$', '')
    || CASE WHEN len(pars) > 0 THEN '?' || array_to_string(pars, '&') ELSE '' END AS url, TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 MINUTE AS first FROM q),
b AS (SELECT *, '"' || md5(body) || '"' AS tag, strftime(first - INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') AS changed, sha1(body) AS h FROM u),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', substr(h, i, 1)) - 3, 4)), '') AS z FROM b),
c AS (SELECT *, 'sha1:' || array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(z, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(z, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(z, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(z, 5 * i + 4, 1) AS INT) + CAST(substr(z, 5 * i + 5, 1) AS INT), 1)), '') AS digest FROM bits),
r AS (SELECT *, first + INTERVAL 30 DAY AS again, page_id % 7 = 0 AS dated, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 10 = 0 THEN '"changed"' ELSE tag END AS rtag FROM c),
src AS (SELECT r.page_id, arg_max(f.page_id, (f.first, f.page_id)) AS sid FROM r JOIN c f ON f.url = r.url AND f.first < r.again GROUP BY r.page_id),
j AS (SELECT r.*, sid, s.tag AS stag, s.changed AS schanged, s.digest AS sdigest, octet_length(encode(s.body)) AS slen, CASE WHEN sid IS NULL THEN 'orphan' WHEN rtag IS NOT NULL THEN CASE WHEN rtag = s.tag THEN 'resolved' ELSE 'mismatch' END WHEN r.changed = s.changed THEN 'resolved' ELSE 'mismatch' END AS status
    FROM r LEFT JOIN src USING (page_id) LEFT JOIN c s ON s.page_id = sid)
SELECT page_id, 'response' AS kind, url, strftime(first, '%Y-%m-%dT%H:%M:%SZ') AS date, 'full' AS status, page_id AS source_id,
    array_to_string(list_sort(['content-type: text/html; charset=utf-8', 'content-length: ' || octet_length(encode(body)), 'etag: ' || tag, 'last-modified: ' || changed, 'cache-control: max-age=60', 'server: stored']), chr(10)) AS headers, digest FROM r
UNION ALL
SELECT page_id, 'revisit', url, strftime(again, '%Y-%m-%dT%H:%M:%SZ'), status, sid,
    array_to_string(list_sort(CASE WHEN status = 'resolved' THEN ['content-type: text/html; charset=utf-8', 'content-length: ' || slen, 'etag: ' || CASE WHEN dated THEN stag ELSE 'W/' || rtag END, 'last-modified: ' || CASE WHEN dated THEN changed ELSE schanged END, 'cache-control: max-age=120', 'server: stored']
    ELSE [CASE WHEN dated THEN 'last-modified: ' || changed ELSE 'etag: ' || CASE WHEN page_id % 10 = 0 THEN rtag ELSE 'W/' || rtag END END, 'cache-control: max-age=120', 'content-length: 0', 'server: revisited'] END), chr(10)), CASE WHEN status = 'resolved' THEN sdigest END FROM j
"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": QUALITY_RULES,
    "op5_suffix_array": SUFFIX_ARRAY,
    "op7_decontaminate": DECONTAMINATE,
    "op10_warc": WARC,
    "op11_jaccard_join": JACCARD_JOIN,
    "op12_tiered_search": TIERED_SEARCH,
}
