"""DuckDB SQL for the queries of this subpackage that SQL can express.

Written from the rules alone: strings stand where the operators compare
hashes, and windows are joined as rows. The other operators draw from Spark's
hashes, count the ids of a tokenizer or train a model, which SQL can't.
"""

from __future__ import annotations

from .common import LOWER, UPPER, WORD
from .line_dedup import LONG, LONG_DOCS, MIN_DOCS
from .quality_rules import BOILERPLATE, MARKS, SEPARATORS, SYMBOLS, character_class
from .url_filters import BLOCKED_HOSTS, RULES


def _count(text: str, marks: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '{character_class(marks)}', '', 'g')))"


_PHRASE = "(?i)(" + "|".join(BOILERPLATE) + ")"
_FAILS = f"""({_count('x', MARKS)} * 100 > length(x) * 10 OR ({_count('x', SEPARATORS)} >= 3 AND length(x) < {_count('x', SEPARATORS)} * 40)
 OR (length(x) <= 200 AND regexp_matches(x, '{_PHRASE}')))"""

_QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
 w AS (SELECT *, regexp_extract_all(body, '{WORD}') AS words, [x FOR x IN string_split(body, chr(10)) IF regexp_matches(x, '{WORD}')] AS lines FROM d),
 g AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
 r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
 c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, range(5) o(k) GROUP BY rid),
 s AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, {_count('body', SYMBOLS)} AS n_symbols,
 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
 length(regexp_replace(array_to_string([x FOR x IN lines IF NOT {_FAILS}], ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS stay FROM w LEFT JOIN c USING (rid)),
 f AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
 CASE WHEN word_chars > 0 THEN 1 - stay::DOUBLE / word_chars ELSE 0::DOUBLE END AS part FROM s)
 SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
 n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND part <= 0.5 AS kept, round(part, 6) AS lost FROM f"""

_LINES = f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
 e AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM d),
 t AS (SELECT doc_id, pos, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN regexp_extract_all(line, '{WORD}')] AS tokens FROM e
 WHERE regexp_matches(line, '{WORD}')),
 l AS (SELECT doc_id, pos, tokens, array_to_string(tokens, ' ') AS line, len(tokens) || ' ' || array_to_string(tokens[1:3], ' ') AS leaf FROM t),
 p AS (SELECT leaf, line, any_value(tokens) AS tokens, count(DISTINCT doc_id) AS n, min({{'doc_id': doc_id, 'pos': pos}}) AS first FROM l GROUP BY leaf, line),
 b AS (SELECT leaf, sum(n) AS docs FROM p WHERE n < {MIN_DOCS} GROUP BY leaf HAVING sum(n) >= {MIN_DOCS} AND count(*) > 1),
 q AS (SELECT leaf, line, n, docs, first, unnest(range(len(tokens))) AS place, unnest(tokens) AS token FROM p JOIN b USING (leaf) WHERE n < {MIN_DOCS}),
 k AS (SELECT leaf, place, token FROM q GROUP BY leaf, place, token HAVING sum(n) > any_value(docs) * 0.5::DOUBLE),
 o AS (SELECT q.leaf, q.line, any_value(first) AS first, count(*) AS size, count(*) FILTER (k.token <> '<*>') AS held,
 string_agg(coalesce(k.token, '<*>'), ' ' ORDER BY q.place) AS template FROM q LEFT JOIN k ON k.leaf = q.leaf AND k.place = q.place AND k.token = q.token
 GROUP BY q.leaf, q.line),
 g AS (SELECT * FROM o WHERE held >= size * 0.7::DOUBLE),
 h AS (SELECT leaf, template, min(g.first) AS first FROM g JOIN l USING (leaf, line) GROUP BY leaf, template HAVING count(DISTINCT l.doc_id) >= {MIN_DOCS}),
 z AS (SELECT line, first FROM p WHERE len([y FOR y IN tokens IF y <> '<*>']) >= len(tokens) * 0.7::DOUBLE
 AND n >= CASE WHEN len(tokens) > {LONG} THEN {LONG_DOCS} ELSE {MIN_DOCS} END UNION ALL SELECT g.line, h.first FROM g JOIN h USING (leaf, template)),
 x AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM l JOIN z USING (line) WHERE (doc_id, pos) <> (z.first.doc_id, z.first.pos) GROUP BY doc_id)
 SELECT documents.doc_id, CASE WHEN gone IS NULL THEN text ELSE
 array_to_string([d.parts[i + 1] FOR i IN range(len(d.parts)) IF NOT list_contains(gone, i)], chr(10)) END AS text,
 coalesce(len([y FOR y IN d.parts IF regexp_matches(y, '{WORD}')]), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped
 FROM documents JOIN d USING (doc_id) LEFT JOIN x USING (doc_id)"""

_URLS = f"""WITH b AS (SELECT unnest({list(BLOCKED_HOSTS)!r}) AS blocked),
 r AS (SELECT * FROM (VALUES {', '.join(map(repr, RULES))}) v(h, p, verdict)),
 u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 s AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
 f AS (SELECT rid, h || p AS rule, verdict FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(h) + length(p) DESC, length(h) DESC) = 1),
 k AS (SELECT DISTINCT rid FROM s JOIN b ON host = blocked OR ends_with(host, '.' || blocked))
 SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN k.rid IS NULL THEN 'allow' ELSE 'block' END) AS verdict
 FROM s LEFT JOIN f USING (rid) LEFT JOIN k ON k.rid = s.rid"""

_P = "(1 + 1000000000::HUGEINT * ({n} + 1) // ({total} + v.kept))::HUGEINT"
_DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS body FROM documents),
 t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(body, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
 v AS (SELECT l.lang, count(k.term) AS kept, coalesce(sum(k.n), 0) AS total FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN k USING (lang) GROUP BY l.lang),
 c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
 g AS (SELECT o.lang, o.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN c USING (lang, source) GROUP BY o.lang, o.source),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format(n='coalesce(c.n, 0)', total='g.total')} AS p, {_P.format(n='k.n', total='v.total')} AS q
 FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
 AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
 SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r
 QUALIFY part = 'pair' OR rank <= 200"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
# crc32 a bit at a time: a code of 0 or more is the next character, -1 a shift
_BITS = "flatten([[ord(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(doc_id::VARCHAR, '')])"
_CRC = f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {_BITS}::BIGINT[]),
 lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""
_MANIFEST = f"""WITH RECURSIVE e AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS there FROM documents),
 l AS MATERIALIZED (SELECT doc_id, source, sha256({_HEAD} || {_FIELD.format('text')}) AS leaf, sha256({_HEAD} || {_FIELD.format('there')}) AS found FROM e),
 o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
 t AS (SELECT source, 0 AS level, 1::BIGINT AS wide, pos, n, leaf AS node FROM o UNION ALL SELECT source, any_value(level) + 1, any_value(wide) * 3, pos // 3,
 (any_value(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY source, pos // 3),
 s AS MATERIALIZED (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
 u AS (SELECT 1000 AS level, 1::BIGINT AS wide, pos, n, subroot AS node FROM s UNION ALL SELECT any_value(level) + 1, any_value(wide) * 3, pos // 3,
 (any_value(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY pos // 3),
 a AS MATERIALIZED (SELECT row_number() OVER () AS rid, o.*, s.subroot, s.pos AS place FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source),
 w AS MATERIALIZED (SELECT a.rid, t.level, t.pos - a.pos // t.wide AS side, t.pos, t.node FROM a JOIN t ON t.source IS NOT DISTINCT FROM a.source AND t.n > 1
 AND t.pos // 3 = a.pos // (t.wide * 3) UNION ALL SELECT a.rid, u.level, u.pos - a.place // u.wide, u.pos, u.node FROM a JOIN u ON u.n > 1 AND u.pos // 3 = a.place // (u.wide * 3)),
 x AS MATERIALIZED (SELECT rid, level, row_number() OVER (PARTITION BY rid ORDER BY level) AS step, coalesce(string_agg(node, '' ORDER BY pos) FILTER (side < 0), '') AS before,
 coalesce(string_agg(node, '' ORDER BY pos) FILTER (side > 0), '') AS after FROM w GROUP BY rid, level),
 f AS (SELECT rid, 0::BIGINT AS step, found AS node FROM a UNION ALL SELECT f.rid, x.step, sha256(x.before || f.node || x.after) FROM f JOIN x ON x.rid = f.rid AND x.step = f.step + 1)
 SELECT a.doc_id, a.leaf, a.subroot, (SELECT node FROM u WHERE n = 1) AS root, sha256(coalesce((SELECT string_agg(x.before || x.after, '' ORDER BY step) FROM x WHERE x.rid = a.rid), '')) AS proof_sha256,
 f.node AS folded_root, f.node = (SELECT node FROM u WHERE n = 1) AS verified FROM a JOIN (SELECT rid, arg_max(node, step) AS node FROM f GROUP BY rid) f USING (rid)"""

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": _LINES,
    "op4_quality_rules": _QUALITY,
    "op8_url_filters": _URLS,
    "op11_source_divergence": _DIVERGENCE,
    "op13_merkle_manifest": _MANIFEST,
}
