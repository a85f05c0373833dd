"""DuckDB SQL with the same rows as the library's queries, written from the operators' definitions."""

from __future__ import annotations

from verbaloom.functions import codes, content, literals
from verbaloom.plans import catalog


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LIT = q(content.LITERAL_TOKEN)
SPLIT = q(content.SPLIT)


def letters(t: str) -> str:
    return f"coalesce(list_sum(list_transform(string_split_regex(coalesce({t}, ''), {SPLIT}), lambda w: CASE WHEN regexp_full_match(w, {LIT}) THEN 0 ELSE length(regexp_replace(w, '\\P{{L}}+', '', 'g')) END)), 0)::BIGINT"


def rule(t: str) -> str:
    return f"CASE WHEN regexp_full_match(coalesce({t}, ''), '[{content.WHITESPACE}]*') THEN 'und' WHEN NOT {linguistic(t)} THEN 'zxx' END"


def linguistic(t: str) -> str:
    return f"list_bool_or(list_transform(string_split_regex(coalesce({t}, ''), {SPLIT}), lambda w: regexp_matches(w, '\\p{{L}}') AND NOT regexp_full_match(w, {LIT})))"


def table(pairs: dict[str, str], name: str) -> str:
    return f"{name}(k, v) AS (VALUES {', '.join(f'({q(k)}, {q(v)})' for k, v in pairs.items())})"


def values(rows: list[tuple], name: str, columns: str) -> str:
    cell = lambda x: "NULL" if x is None else q(x) if isinstance(x, str) else str(x)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"


VARIANTS = """labels AS (SELECT unnest(['__label__' || lang, upper(lang), lang || '-Latn', '__label__' || lang || '_Latn']) AS label FROM (SELECT DISTINCT lang FROM documents)
  UNION ALL SELECT unnest(['__label__als', 'iw', 'zh-Hant', 'cmn_Hans', '__label__nno_Latn', 'nb', 'scr', 'xx', 'ary', 'sh']))"""


def iso(collapse: bool, source: str, out: str) -> str:
    last = "coalesce((SELECT v FROM macro WHERE k = r), r)" if collapse else "r"
    return f"""{table(codes.OVERRIDES, "o")}, {table(codes.PART1, "p1")}, {table(codes.RETIRED, "ret")}, {table(codes.MACRO, "macro")}, {source},
a AS (SELECT *, lower(string_split_regex(regexp_replace(label, '^__label__', ''), '[-_]')[1]) AS c FROM labels),
b AS (SELECT *, coalesce((SELECT v FROM o WHERE k = c), (SELECT v FROM p1 WHERE k = c AND length(c) = 2), c) AS s FROM a),
c AS (SELECT *, coalesce((SELECT v FROM ret WHERE k = s), s) AS r FROM b),
coded AS (SELECT *, {last} AS code FROM c) {out}"""


def _to_language() -> str:
    by_part3 = {codes.PART1.get(c, c): c for c in codes.LANGUAGES.values()}
    part1 = codes.PART1 | {k: v for k, v in codes.OVERRIDES.items() if len(k) == 2}
    named = "['Spanish', 'norwegian nynorsk', 'es-ES', 'zho_Hans', 'cmn', 'arb', 'nob', 'yue', 'ary', 'iw', 'als', 'und', 'zxx', 'klingon', ' PT ']"
    return f"""WITH {table(codes.LANGUAGES, "names")}, {table(part1, "p1")}, {table(by_part3, "p3")}, {table(codes.RETIRED, "ret")}, {table(codes.MACRO, "macro")},
vals AS (SELECT DISTINCT lang AS value FROM documents UNION ALL SELECT unnest({named})),
a AS (SELECT value, upper(regexp_replace(trim(value), '[\\s-]+', '_', 'g')) AS n, string_split_regex(lower(trim(value)), '[-_]')[1] AS c FROM vals),
b AS (SELECT *, CASE WHEN length(c) = 2 THEN (SELECT v FROM p1 WHERE k = c) ELSE c END AS s FROM a),
d AS (SELECT *, coalesce((SELECT v FROM ret WHERE k = s), s) AS r FROM b)
SELECT value, coalesce((SELECT v FROM names WHERE k = n), (SELECT v FROM names WHERE v = c), (SELECT v FROM p3 WHERE k = r), (SELECT v FROM p3 WHERE k = (SELECT v FROM macro WHERE k = r)), '?') AS code FROM d"""


def human(x: str) -> str:
    mb, gb = float(1 << 20), float(1 << 30)
    return f"CASE WHEN {x} = 0 THEN '0 MB' WHEN {x} >= {gb} THEN printf('%.1f GB', {x} / {gb}) WHEN {x} >= {10 * mb} THEN printf('%.0f MB', {x} / {mb}) ELSE printf('%.1f MB', {x} / {mb}) END"


# The trigram model

_CHARS = "regexp_extract_all(lower(coalesce(text, '')), '(?s).')"
_GRAMS = "unnest(list_transform(generate_series(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram"
NB = f"""g AS MATERIALIZED (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, {_GRAMS} FROM (SELECT doc_id, {_CHARS} AS c FROM documents) WHERE len(c) > 2) GROUP BY ALL),
lg AS (SELECT lang, gram, sum(n) AS n FROM g JOIN documents USING (doc_id) WHERE lang IS NOT NULL GROUP BY ALL),
vocab AS (SELECT DISTINCT gram FROM lg),
tot AS (SELECT lang, sum(n) AS t FROM lg GROUP BY lang),
pri AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM documents WHERE lang IS NOT NULL)) AS p FROM documents WHERE lang IS NOT NULL GROUP BY lang),
m AS MATERIALIZED (SELECT lang AS language, gram, ln((coalesce(lg.n, 0) + 1.0) / (t + (SELECT count(*) FROM vocab))) AS logp FROM tot CROSS JOIN vocab LEFT JOIN lg USING (lang, gram))"""


def ranked(grams: str = "g") -> str:
    return f"""s AS (SELECT doc_id, pri.lang AS language, coalesce(x, 0) + p AS score FROM documents CROSS JOIN pri LEFT JOIN (SELECT doc_id, language, sum(n * logp) AS x FROM {grams} JOIN m USING (gram) GROUP BY ALL) y USING (doc_id) WHERE y.language = pri.lang OR y.language IS NULL),
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS w FROM s),
pr AS MATERIALIZED (SELECT doc_id, language, w / sum(w) OVER (PARTITION BY doc_id) AS probability, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, language) - 1 AS rank FROM e)"""


def detection(min_letters: int | None = None, min_score: float | None = None, min_margin: float | None = None, candidates: tuple[str, ...] | None = None, text: str = "text", grams: str = "g") -> str:
    """CTEs that end in det(doc_id, language, status, top_language, score)."""
    keep = "" if candidates is None else f"WHERE language IN ({', '.join(map(q, candidates))})"
    tests = [f"WHEN letters < {min_letters} THEN 'insufficient_text'" if min_letters else "", f"WHEN l1 IS NULL OR l1 = 'und'{f' OR p1 < {min_score}' if min_score is not None else ''} THEN 'low_confidence'", f"WHEN p1 - coalesce(p2, 0) < {min_margin} THEN 'ambiguous'" if min_margin is not None else ""]
    seen = "rule IS NULL" + (f" AND letters >= {min_letters}" if min_letters else "")
    return f"""{NB}, {ranked(grams)},
k AS (SELECT doc_id, language, probability, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS r FROM pr {keep}),
top AS (SELECT doc_id, max(language) FILTER (r = 1) AS l1, max(probability) FILTER (r = 1) AS p1, max(probability) FILTER (r = 2) AS p2 FROM k GROUP BY doc_id),
ru AS (SELECT doc_id, {rule(text)} AS rule, {letters(text)} AS letters FROM documents),
st AS (SELECT *, CASE rule WHEN 'und' THEN 'empty' WHEN 'zxx' THEN 'non_linguistic' ELSE CASE {" ".join(tests)} ELSE 'detected' END END AS status FROM ru LEFT JOIN top USING (doc_id)),
det AS (SELECT doc_id, CASE WHEN rule IS NOT NULL THEN rule WHEN status = 'detected' THEN l1 ELSE 'und' END AS language, status, CASE WHEN {seen} THEN l1 END AS top_language, CASE WHEN {seen} THEN p1 END AS score FROM st)"""


def detailed(**policy) -> str:
    return f"WITH {detection(**policy)} SELECT doc_id, language, status, top_language, round(score, 4) AS score FROM det"


# Routing

_SIZES = [("pair", "q4", 280), ("pair", "int8", 105), ("pair", "fp32", 420), ("small", "int8", 590), ("medium", "int8", 640), ("large", "int8", 1100), ("large", "fp32", 2900)]
_LICENCE = {"pair": "Apache-2.0", "large": "CC-BY-NC-4.0"}
_FILES = values([(f, p, _LICENCE.get(f, "MIT"), name, mb * pc * catalog.MB // 100) for f, p, mb in _SIZES for name, pc in (("encoder.onnx", 40), ("decoder.onnx", 59), ("tokenizer.json", 1))], "files", "family, precision, license, file, bytes")
COSTS = f"""{_FILES}, {values([(f, p, m * catalog.MB) for (f, p), m in catalog.MEASURED_MB.items()], "mem", "family, precision, b")},
costs AS (SELECT family, precision, license, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS n_files, CAST(coalesce(max(b), sum(bytes) * 4) AS BIGINT) AS memory_bytes, CASE WHEN max(b) IS NULL THEN 'estimated' ELSE 'measured' END AS memory_basis FROM files LEFT JOIN mem USING (family, precision) GROUP BY ALL)"""
_ALL = list(codes.LANGUAGES.values())
RULES = f"""{values([(p, i, f, x) for p, r in catalog.RULES.items() for i, (f, x) in enumerate(r)], "rules", "profile, priority, family, precision")},
{values(list(catalog.PAIRS), "pairs", "source, target")}, {values([(c,) for c in _ALL], "langs", "code")}, {values([(c,) for c in catalog.SMALL], "small", "code")}"""


def choice(requests: str, limits: str = "true") -> str:
    """CTEs that end in chosen(profile, source, target, family, precision). requests: SQL of (source, target)."""
    large = f"source NOT IN {catalog.NOT_LARGE} AND target NOT IN {catalog.NOT_LARGE}"
    return f"""{COSTS}, {RULES}, req AS ({requests}),
cand AS (SELECT profile, source, target, priority, family, precision FROM req, rules WHERE CASE family WHEN 'pair' THEN EXISTS (SELECT 1 FROM pairs p WHERE p.source = req.source AND p.target = req.target) WHEN 'small' THEN target IN (SELECT code FROM small) ELSE {large} END),
ok AS (SELECT cand.* FROM cand LEFT JOIN costs USING (family, precision) WHERE {limits}),
chosen AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY profile, source, target ORDER BY priority) = 1)"""


_OWN = "SELECT a.lang AS source, b.lang AS target FROM (SELECT DISTINCT lang FROM documents) a, (SELECT DISTINCT lang FROM documents) b WHERE a.lang != b.lang"
_LIMIT = f"lower(license) IN ('apache-2.0', 'mit') AND bytes <= {200 * catalog.MB}"

# Sentences: titles and single characters before a full stop end nothing, so their gap is marked first.
_END, _CLOSE = ".!?…。！？।؟۔", "\"'”’»)\\]）」』"
_BLANKS = content.WHITESPACE.replace(r"\t-\r", r"\t\x0b-\r")
_WORD = "(?:[^ \\x01\\x02]|Dr|Mr|Mrs|Ms|Prof|Sr|Sra|Jr|St)"


def _turns(column: str, pattern: str, into: str, times: int) -> str:
    """Replacements in turns: a match uses up the character it looks at, so what follows it needs another."""
    for _ in range(times):
        column = f"regexp_replace({column}, '{pattern}', {into}, 'g')"
    return column


def sentences(table: str, keys: str) -> str:
    """CTEs a, b and c: each text with its sentences parted by chr(1), and chr(2) for a blank that parts none."""
    return _SENT_PARTS.replace("doc_id", keys).replace("documents", table)


_SENT_PARTS = f"""a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^[{content.WHITESPACE}]+|[{content.WHITESPACE}]+$', '', 'g'), '[{content.WHITESPACE}]*\\n[{content.WHITESPACE}]*', chr(1), 'g'), '[{_BLANKS}]+', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, {_turns("t", "(^|[ \\x02])(" + _WORD + "\\.[" + _CLOSE.replace("'", "''") + "]*) ", "'\\1\\2' || chr(2)", 2)} AS t FROM a),
c AS (SELECT doc_id, {_turns("t", "([" + _END + "][" + _CLOSE.replace("'", "''") + "]*) ([^\\p{Ll}])", "'\\1' || chr(1) || '\\2'", 2)} AS t FROM b)"""
_SENT = f"""WITH {_SENT_PARTS}
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(1))) END::BIGINT AS n_sentences FROM c"""

_A, _Z = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SWAP = f"translate({{0}}, '{_A + _Z}', '{_Z + _A}')"
_BLANK = f"regexp_full_match(coalesce(text, ''), '[{content.WHITESPACE}]*')"

ORACLES: dict[str, str] = {
    "rule_label": f"SELECT id, {rule('text')} AS rule FROM (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, url FROM pages)",
    "letter_count": f"SELECT doc_id, {letters('text')} AS letters FROM documents",
    "linguistic_content": f"SELECT conv_id, turn, {linguistic('text')} AS linguistic, {_BLANK} AS blank FROM conversations",
    "min_letters_gate": f"SELECT conv_id, turn, CASE WHEN {letters('text')} < 40 THEN 'insufficient_text' ELSE 'model' END AS gate FROM conversations",
    "literal_tokens": f"SELECT w, count(*) AS n FROM (SELECT unnest(string_split_regex(url, {SPLIT})) AS w FROM pages UNION ALL SELECT unnest(string_split_regex(text, {SPLIT})) FROM documents) WHERE regexp_full_match(w, {LIT}) GROUP BY w",
    "iso_normalize": "WITH " + iso(False, VARIANTS, "SELECT label, code FROM coded"),
    "macro_collapse": "WITH " + iso(True, VARIANTS, "SELECT label, code FROM coded"),
    "to_language": _to_language(),
    "compact_labels": "SELECT n_name, CASE WHEN length(n_name) = 6 THEN substr(lower(n_name), 4, 3) ELSE substr(lower(n_name), 1, 3) END AS code FROM nation",
    "label_collapse_scores": "WITH " + iso(False, "labels AS (SELECT unnest(['__label__' || lang, upper(lang)]) AS label, n FROM (SELECT lang, count(*) * 1.0::DOUBLE AS n FROM documents GROUP BY lang))", "SELECT code AS language, sum(n) AS score FROM coded GROUP BY code"),
    "model_sizes": f"SELECT lang, {human('b')} AS size FROM (SELECT lang, sum(strlen(text)) AS b FROM documents GROUP BY lang)",
    "nb_train": f"WITH {NB} SELECT language, gram, round(logp, 4) AS logp FROM m",
    "nb_scores": f"WITH {NB}, {ranked()} SELECT doc_id, language, round(score, 2) AS score FROM s",
    "nb_top1": f"WITH {NB}, {ranked()} SELECT doc_id, language FROM pr WHERE rank = 0",
    "nb_topk": f"WITH {NB}, {ranked()} SELECT doc_id, rank, language FROM pr WHERE rank < 2",
    "nb_softmax": f"WITH {NB}, {ranked()} SELECT doc_id, language, round(probability, 4) AS probability FROM pr",
    "lang_histogram": f"WITH {detection()} SELECT lang, det.language, count(*) AS n FROM det JOIN documents USING (doc_id) GROUP BY ALL",
    "detect_detailed": detailed(),
    "detect_min_letters": detailed(min_letters=200),
    "detect_min_score": detailed(min_score=0.9999),
    "detect_min_margin": detailed(min_margin=0.9999),
    "detect_candidates": detailed(candidates=("de", "fr")),
    "confident_rows": f"WITH {detection()} SELECT doc_id FROM det WHERE status = 'detected' AND language = 'en' AND score >= 0.8",
    "detect_status_counts": f"WITH {detection(min_letters=200, min_score=0.9999)} SELECT status, count(*) AS n FROM det GROUP BY status",
    "detect_json_lines": f"""WITH {detection()} SELECT doc_id, '{{"text":"' || doc_id || '","language":"' || language || '","status":"' || status || '","top_language":' || coalesce('"' || top_language || '"', 'null') || ',"score":' || coalesce(CAST(round(score, 1) AS VARCHAR), 'null') || '}}' AS line FROM det""",
    "detect_batch_model": f"""WITH b AS (SELECT doc_id, {rule("text")} AS rule, {letters("text")} AS letters, length(regexp_replace(text, '[^aeiouAEIOU]', '', 'g')) / greatest(length(text), 1) AS v FROM documents)
SELECT doc_id, CASE WHEN rule IS NOT NULL THEN rule WHEN letters < 4 THEN 'und' WHEN v > 1 - v THEN 'vow' ELSE 'con' END AS language, CASE WHEN rule IS NULL AND letters >= 4 THEN round(greatest(v, 1 - v), 4) END AS score FROM b""",
    "route_pairs": f"WITH {choice(_OWN)} SELECT profile, source, target, family, precision FROM chosen",
    "route_constrained": f"WITH {choice(_OWN, _LIMIT)} SELECT profile, source, target, family, precision FROM chosen",
    "auto_choices": f"WITH {choice('SELECT code AS source, ' + q('en') + ' AS target FROM langs WHERE code != ' + q('en') + ' UNION ALL SELECT NULL, ' + q('en'))} SELECT source, family, precision FROM chosen WHERE profile = 'balance'",
    "supported_languages": f"WITH {choice('SELECT a.code AS source, b.code AS target FROM langs a, langs b WHERE a.code != b.code')} SELECT profile, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets FROM chosen GROUP BY profile",
    "model_costs": f"WITH {COSTS} SELECT * FROM costs",
    "rejected_models": f"WITH {COSTS} SELECT family, precision, CASE WHEN lower(license) != 'apache-2.0' THEN 'licence ' || license || ' is not allowed' WHEN bytes > {300 * catalog.MB} THEN printf('%.0f', bytes / {float(catalog.MB)}) || ' MB is over the limit (300 MB)' END AS reason FROM costs",
    "cache_missing": f"WITH {_FILES} SELECT family, precision, file, CAST(bytes AS BIGINT) AS bytes FROM files WHERE file = 'decoder.onnx' AND family != 'pair'",
    "plan_totals": f"""WITH {choice("SELECT unnest(['de', 'fr', 'es', 'bo']) AS source, 'en' AS target")}, used AS (SELECT DISTINCT family, precision FROM chosen WHERE profile = 'balance'),
p AS (SELECT * FROM costs JOIN used USING (family, precision))
SELECT CAST(sum(bytes) AS BIGINT) AS download_bytes, CAST(coalesce(sum(bytes) FILTER (family != 'pair'), 0) AS BIGINT) AS missing_bytes, CAST(sum(memory_bytes) AS BIGINT) AS memory_bytes, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM p""",
    "catalog_list": f"WITH {COSTS}, {RULES}, u AS (SELECT family, precision, string_agg(DISTINCT profile, ',' ORDER BY profile) AS profiles FROM rules GROUP BY ALL) SELECT family, precision, license, {human('bytes')} AS size, coalesce(profiles, '') AS profiles FROM costs LEFT JOIN u USING (family, precision)",
    "tag_counts": f"SELECT page_id, CAST(len(regexp_extract_all(html, {q(literals.TAG_PATTERN)})) AS BIGINT) AS n_tags FROM pages",
    "email_extract": f"SELECT doc_id, unnest(generate_series(1, len(e))) - 1 AS i, unnest(e) AS email FROM (SELECT doc_id, regexp_extract_all(text, {q(literals.EMAIL_PATTERN)}) AS e FROM documents)",
    "url_column_rule": f"SELECT {rule('url')} AS rule, count(*) AS n FROM pages GROUP BY 1",
    "span_merge": """WITH s AS (SELECT o_custkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 30 AS b FROM orders),
h AS (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS head FROM s),
i AS (SELECT *, sum(head) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM h)
SELECT o_custkey, min(a) AS start, max(b) AS "end" FROM i GROUP BY o_custkey, g""",
    "find_tags": f"SELECT page_id, CAST(len(t) AS BIGINT) AS n_tags, array_to_string(t, '') AS tags FROM (SELECT page_id, regexp_extract_all(html, {q(literals.TAG_PATTERN)}) AS t FROM pages)",
    "split_roundtrip": "SELECT page_id, sha256(html) AS sha FROM pages",
    "mask_restore_roundtrip": "SELECT conv_id, turn, true AS same FROM conversations",
    "sentence_counts": _SENT,
    "distinct_sentences": f"WITH {sentences('conversations', 'conv_id, turn')} SELECT s AS sentence, count(*) AS n FROM (SELECT unnest(string_split(replace(t, chr(2), ' '), chr(1))) AS s FROM c WHERE t != '') GROUP BY s",
    "gather_sentences": f"WITH {sentences('documents', 'doc_id')} SELECT doc_id, CAST(len(l) AS BIGINT) AS n, sha256(array_to_string(list_transform(l, lambda x: translate(x, '{_A}', '{_Z}') || '|'), '')) AS sha FROM (SELECT doc_id, string_split(replace(t, chr(2), ' '), chr(1)) AS l FROM c WHERE t != '')",
    "literal_retention": f"""WITH e AS (SELECT lower(text) AS t, regexp_extract_all(text, {q(literals.EMAIL_PATTERN)}) AS e FROM documents)
SELECT kept, count(*) AS n FROM (SELECT len(list_filter(e, lambda x: (length(t) - length(replace(t, x, ''))) / length(x) < len(list_filter(e, lambda y: y = x)))) = 0 AS kept FROM e WHERE len(e) > 0) GROUP BY kept""",
    "supported_language_sets": f"WITH {choice('SELECT a.code AS source, b.code AS target FROM langs a, langs b WHERE a.code != b.code')} SELECT DISTINCT profile, unnest(['source', 'target']) AS side, unnest([source, target]) AS code FROM chosen WHERE profile = 'quality'",
    "language_union": f"WITH {RULES}, {values([(c,) for c in _ALL], 'named', 'code')}, w AS (SELECT code FROM small UNION SELECT code FROM named WHERE code NOT IN {catalog.NOT_LARGE} UNION SELECT target FROM pairs) SELECT CASE WHEN w.code IS NOT NULL THEN true END AS written, CASE WHEN named.code IS NOT NULL THEN true END AS named, count(*) AS n FROM w FULL JOIN named ON w.code = named.code GROUP BY 1, 2",
    "model_file_names": "SELECT * FROM (VALUES " + ", ".join(f"({q(f)}, {q(p)}, {q(n)})" for f, p in sorted({m for r in catalog.RULES.values() for m in r} | set(catalog.MEASURED_MB)) for n in catalog.model_files(f, p)) + ") AS t(family, precision, file)",
    "segment_roundtrip": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "translate_toy": f"SELECT conv_id, turn, CASE WHEN {_BLANK} THEN text ELSE {_SWAP.format('text')} || ':es' END AS out, CASE WHEN {_BLANK} THEN 'unchanged' ELSE 'translated' END AS status FROM conversations",
    "translate_preserve": "SELECT page_id, 'SEE:es ' || url AS out, 'segments' AS preservation FROM pages",
    "translate_errors": f"SELECT conv_id, turn, CASE WHEN contains(text, 'the') THEN NULL ELSE {_SWAP.format('text')} || ':es' END AS out, CASE WHEN contains(text, 'the') THEN 'failed' ELSE 'translated' END AS status, CASE WHEN contains(text, 'the') THEN 'RuntimeError: cannot translate the' END AS error FROM conversations",
    "failure_count": "SELECT count(*) FILTER (contains(text, 'the')) AS failed, count(*) AS total FROM conversations",
    "translate_auto_status": f"WITH {detection(min_letters=100)} SELECT doc_id, CASE WHEN language IN ('es', 'zxx') THEN 'unchanged' WHEN language = 'und' THEN CASE WHEN {_BLANK} THEN 'unchanged' ELSE 'unknown_source' END WHEN language IN ('en', 'fr') THEN 'translated' ELSE 'unsupported_source' END AS status, CASE WHEN language IN ('en', 'fr', 'de', 'es') THEN language END AS source FROM det JOIN documents USING (doc_id)",
    "macro_accuracy": f"WITH {detection()}, a AS (SELECT lang, avg((lang = language)::INT) AS x FROM det JOIN documents USING (doc_id) GROUP BY lang) SELECT count(*) AS n_languages, round(avg(x), 6) AS macro_accuracy FROM a",
    "outcome_by_category": f"WITH {detection(min_letters=100)} SELECT source AS category, CASE WHEN language IN (lang, 'xx') THEN 'right' WHEN language = 'und' THEN 'abstained' ELSE 'wrong' END AS outcome, count(*) AS n FROM det JOIN documents USING (doc_id) GROUP BY ALL",
    "short_text_accuracy": f"""WITH {detection(text="text[1:40]", grams="g40").replace("s AS (SELECT doc_id, pri", "g40 AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, " + _GRAMS + " FROM (SELECT doc_id, " + _CHARS.replace("text", "text[1:40]") + " AS c FROM documents) WHERE len(c) > 2) GROUP BY ALL), s AS (SELECT doc_id, pri")}, a AS (SELECT lang, avg((lang = language)::INT) AS x FROM det JOIN documents USING (doc_id) GROUP BY lang) SELECT count(*) AS n_languages, round(avg(x), 6) AS macro_accuracy FROM a""",
    "first_n_per_lang": "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 25",
    "known_to_all_models": f"WITH {RULES} SELECT code FROM small WHERE code NOT IN {catalog.NOT_LARGE}",
    "unknown_candidates": f"WITH {values([(c,) for c in _ALL], 'langs', 'code')} SELECT code FROM (SELECT DISTINCT lang AS code FROM documents UNION ALL SELECT unnest(['xx', 'tlh'])) WHERE code NOT IN (SELECT code FROM langs)",
}
ORACLES["translate_dedupe"] = ORACLES["translate_toy"]
