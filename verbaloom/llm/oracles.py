"""DuckDB SQL for the queries that SQL can express, written from their contracts."""

from __future__ import annotations

from . import licenses, quality

_W = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_W}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format("text")}, '{_W}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS m, array_to_string(list_slice(w, i, i + least(len(w), 8) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 8) + 1)) AS i FROM b WHERE len(w) > 0)
),
ms AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, unnest(generate_series(1, len(w) - m + 1)) AS i, w FROM d, ms WHERE len(w) >= m),
hits AS (SELECT DISTINCT doc_id, dw.m, i, item_id FROM dw JOIN win ON dw.m = win.m AND array_to_string(list_slice(w, i, i + dw.m - 1), ' ') = g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def _op7() -> str:
    phrases = " UNION ALL ".join(f"SELECT {p.split()!r} AS p, '{label}' AS label" for p, label in licenses.PHRASES)
    sets = " UNION ALL ".join(f"SELECT '{label}' AS label, {sorted(set(licenses.words_of(t)))!r} AS t" for label, t in licenses.TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({_LOWER.format("text")}, '{_W}') AS w FROM documents),
p AS ({phrases}),
t AS ({sets}),
places AS (
  SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, p, label, unnest(generate_series(1, len(w))) AS i FROM d, p WHERE contains(lower(text), p[1]))
  WHERE list_slice(w, i, i + len(p) - 1) = p
),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS ls FROM places GROUP BY doc_id),
ll AS (SELECT doc_id, list_transform(string_split({_LOWER.format("text")}, chr(10)), lambda x: regexp_extract_all(x, '{_W}')) AS ls FROM d),
runs AS (SELECT doc_id, ls, i, unnest(generate_series(1, {licenses.MAX_LINES})) AS n FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM ll)),
blocks AS (
  SELECT doc_id, list_distinct(flatten(list_slice(ls, i, i + n - 1))) AS b FROM runs
  WHERE n = 1 OR i + n - 1 <= len(ls) AND len(ls[i]) > 0 AND list_sum(list_transform(list_slice(ls, i, i + n - 1), lambda x: len(x))) <= {licenses.MAX_BLOCK_WORDS}
),
found AS (SELECT doc_id, label, len(list_intersect(b, t)) / len(t) AS c FROM blocks, t WHERE len(b) >= 1 AND len(list_intersect(b, t)) >= ceil(0.8 * len(t) - 1e-9)),
best AS (SELECT doc_id, max(c) AS c, list(DISTINCT label) AS ls FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.ls, CAST([] AS VARCHAR[]))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, CAST([] AS VARCHAR[])), coalesce(best.ls, CAST([] AS VARCHAR[]))))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best.c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def op4_features(documents: str = "documents") -> str:
    """CTEs f (counts and histograms), r (references) and j (judged) over a table."""
    p = quality.DEFAULTS
    bins = len(next(iter(quality.COMMON_WORDS.values())))
    lists = "CASE lang " + " ".join(f"WHEN '{k}' THEN {list(v)!r}" for k, v in quality.COMMON_WORDS.items()) + " END"
    jsd = lambda c, r: f"(SELECT sqrt(greatest(0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END))) FROM (SELECT unnest({c}) / greatest(list_sum({c}), 1) AS p, unnest({r}) AS q))"
    avg = lambda c, n: "[" + ", ".join(f"avg({c}[{i}] / nullif(list_sum({c}), 0))" for i in range(1, n + 1)) + "]"
    return f"""
w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, {lists} AS cw FROM {documents}),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
f0 AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS up, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS le, length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) AS di,
  CASE WHEN cw IS NULL THEN NULL ELSE list_filter(list_transform(w, lambda x: list_position(cw, lower(x))), lambda x: x > 0) END AS c FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [le - up + di, up, n_symbols, greatest(0, word_chars - le - di - n_symbols)] AS cb,
  CASE WHEN c IS NULL THEN NULL ELSE list_concat(list_transform(generate_series(1, {bins}), lambda k: len(list_filter(c, lambda x: x = k))), [n_words - len(c)]) END AS wb FROM f0),
r AS (SELECT lang, count(*) AS docs, {avg("cb", 4)} AS cr, {avg("wb", bins + 1)} AS wr FROM f WHERE NOT base_failed AND n_words >= {p["min_words"]} GROUP BY lang),
j AS (SELECT f.*, NOT base_failed AND NOT (n_words >= {p["min_words"]} AND docs >= {p["min_reference_docs"]} AND (coalesce({jsd("cb", "cr")}, 0) > {p["max_char_distance"]} OR coalesce({jsd("wb", "wr")}, 0) > {p["max_word_distance"]} + {p["word_noise"]} / sqrt(greatest(n_words, 1)))) AS kept FROM f LEFT JOIN r USING (lang))"""


OP4 = f"WITH {op4_features()} SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, coalesce(kept, NOT base_failed) AS kept FROM j"

#: The pages of the given tables hold no refresh or canonical tags, so here components are the spellings of an address.
OP10 = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest FROM pages),
n AS (SELECT *, host || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS node FROM p),
k AS (SELECT *, CASE WHEN host = '' THEN NULL ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  CASE WHEN regexp_matches(node, '^(www|m)\.[^/]*\.') THEN regexp_replace(node, '^(www|m)\.', '') ELSE node END,
  '([?&])((utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_cid|mc_eid)=[^&]*(&|$))+', '\1', 'g'), '[?&]+$', ''), '(/index)?\.html?($|\?)', '\2'), '([^/])/($|\?)', '\1\2') END AS spelling FROM n),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, arg_max(verdict, length(rh || rp)) AS v, arg_max(rh || rp, length(rh || rp)) AS rule FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
a AS (SELECT spelling, min(v) AS v FROM k JOIN m USING (page_id) WHERE spelling IS NOT NULL GROUP BY spelling)
SELECT k.page_id, host, path, rule, coalesce(m.v, a.v, 'allow') AS verdict FROM k LEFT JOIN m USING (page_id) LEFT JOIN a USING (spelling)
"""

OP1 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50 AS alone FROM l),
c AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) > 1 AS later FROM w WHERE after IS NOT NULL),
m AS (SELECT w.doc_id, w.i, w.line, alone OR coalesce(a.later, false) OR coalesce(b.later, false) AS gone FROM w LEFT JOIN c a ON a.doc_id = w.doc_id AND a.i = w.i LEFT JOIN c b ON b.doc_id = w.doc_id AND b.i = w.i - 1),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM m)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_removed, CAST(sum(head::INT) AS BIGINT) AS n_runs, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, hash(list_slice(w, i, i + 4)) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, hash(w) FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 80 * (nx.n + ny.n - o)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.doc_id WHERE r.c < b.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1,
    "op3_jaccard_join": OP3,
    "op4_quality_divergence": OP4,
    "op7_license_scan": _op7(),
    "op9_benchmark_decontamination": OP9,
    "op10_url_redirects": OP10,
}
