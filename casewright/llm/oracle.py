"""DuckDB statements for the operators that SQL can express on whole tables."""

from __future__ import annotations

from . import licenses, quality, url_filter


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op1() -> str:
    rules = ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(v)})" for h, p, v in url_filter.QUERY_RULES)
    return f"""WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
 r(rule_host, rule_path, verdict) AS (VALUES {rules}),
 c AS (SELECT page_id, host, path, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS n
  FROM b LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
 SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM c WHERE n = 1"""


def _op2() -> str:
    q = licenses
    rank = lambda name: 0 if name in q.WEAK else 2 if name in q.NARROWER else 1
    templates = ", ".join(f"({_quoted(f'{name}#{k}')}, {_quoted(name)}, {rank(name)}, {_quoted(x)})" for name, variants in q.TEMPLATES.items() for k, x in enumerate(variants))
    stop, term, space = ", ".join(map(_quoted, sorted(q.STOP))), _quoted(q.TERM), _quoted(q.SPACE + "+")
    words = lambda x: f"unnest(regexp_extract_all(lower({x}), {term}))"
    trimmed = lambda x: f"trim(regexp_replace({x}, {space}, ' ', 'g'))"
    sentences = lambda xs: f"flatten(list_transform({xs}, lambda x: string_split(regexp_replace(x, {_quoted('([.!?])' + q.SPACE + '+')}, '\\1' || chr(1), 'g'), chr(1))))"
    return f"""WITH tp(template, license, rank, body) AS (VALUES {templates}),
 tt AS (SELECT template, license, rank, term, count(*) AS n FROM (SELECT template, license, rank, {words('body')} AS term FROM tp) WHERE term NOT IN ({stop}) GROUP BY ALL),
 k AS (SELECT term, ln((1 + (SELECT count(*) FROM tp)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tt GROUP BY 1),
 w AS (SELECT template, license, rank, term, n * idf / sqrt(sum((n * idf) * (n * idf)) OVER (PARTITION BY template)) AS weight FROM tt JOIN k USING (term)),
 d AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, 'd' || doc_id // 256, CASE WHEN doc_id % 256 <> 0 THEN 'd' || doc_id // 16 END) AS dir, CASE WHEN doc_id % 16 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS name FROM documents),
 f AS (SELECT doc_id, dir, name, text, regexp_replace(text, {_quoted(q.MARK)}, '\\1', 'g') AS plain FROM d),
 g AS (SELECT *, list_transform(regexp_split_to_array(plain, '\\n[\\x20\\x09-\\x0D]*\\n'), lambda x: {trimmed('x')}) AS paragraphs FROM f),
 p AS (SELECT DISTINCT doc_id, unnest(list_transform({sentences("string_split(text, chr(10))")}, lambda x: {trimmed('x')}) || {sentences('paragraphs')} || paragraphs || CASE WHEN name = 'LICENSE' THEN [{trimmed('plain')}] ELSE [] END) AS passage FROM g),
 t AS (SELECT passage, term, count(*) AS n FROM (SELECT passage, {words('passage')} AS term FROM (SELECT DISTINCT passage FROM p)) WHERE term NOT IN ({stop}) GROUP BY 1, 2),
 x AS (SELECT passage, term, n * coalesce(idf, ln(1 + (SELECT count(*) FROM tp)) + 1) AS x FROM t LEFT JOIN k USING (term)),
 c AS (SELECT passage, license, rank, round(sum(x * weight) / any_value(norm), 6) AS score FROM x JOIN w USING (term) JOIN (SELECT passage, sqrt(sum(x * x)) AS norm FROM x GROUP BY 1) USING (passage) GROUP BY passage, template, license, rank),
 o AS (SELECT doc_id, license, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, score DESC, license DESC) AS n FROM p JOIN c USING (passage) WHERE score >= {q.THRESHOLD}) WHERE n = 1),
 given AS (SELECT dir AS above, license, score FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY rank DESC, score DESC, license DESC) AS n FROM d JOIN o USING (doc_id) WHERE name = 'LICENSE') WHERE n = 1),
 nearest AS (SELECT doc_id, arg_max(g.license, length(above)) AS license, arg_max(g.score, length(above)) AS score FROM d JOIN given g ON d.dir = above OR starts_with(d.dir, above || '/') GROUP BY 1)
 SELECT doc_id, dir || '/' || name AS path, coalesce(o.license, r.license) AS license, coalesce(o.score, r.score) AS score, CASE WHEN o.license IS NOT NULL THEN 'own' WHEN r.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin FROM d LEFT JOIN o USING (doc_id) LEFT JOIN nearest r USING (doc_id)"""


def _op4() -> str:
    word, space, symbol = _quoted(quality.WORD + "+"), _quoted(quality.SPACE + "+"), _quoted(quality.SYMBOL)
    q = quality
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, regexp_extract_all(text, {word}) AS words FROM d),
 g AS (SELECT doc_id, list_transform(range(1, len(words) - {q.WINDOW - 2}), lambda i: array_to_string(words[i:i + {q.WINDOW - 1}], ' ')) AS grams FROM w),
 p AS (SELECT doc_id, unnest(grams) AS gram, unnest(range(len(grams))) AS i FROM g),
 r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM p) WHERE n > 1),
 v AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, range({q.WINDOW}) t(o) GROUP BY 1),
 ln AS (SELECT doc_id, line, regexp_extract_all(line, {word}) AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_quoted(q.WORD)})),
 lm AS (SELECT *, len(lw) AS n, len(list_filter(lw, lambda x: x IN ('|', '»', '›', '·', '•', '>'))) AS separators, len(regexp_extract_all(line, {_quoted(q.SYMBOL + '+')})) AS symbols, len(regexp_extract_all(line, '[!?]{{2,}}')) AS shouts,
  len(list_filter(range(1, len(lw)), lambda i: lw[i] = lw[i + 1])) AS stutters, length(regexp_replace(line, {space}, '', 'g')) AS chars FROM ln),
 lf AS (SELECT *, (separators >= {q.NAV_SEPARATORS} AND separators * {q.NAV_WORDS_PER_SEPARATOR} >= n) OR (symbols >= 3 AND symbols * {q.WORDS_PER_SYMBOL_RUN} > n) OR (shouts >= {q.MIN_SHOUTS} AND shouts * 4 > n)
  OR (stutters >= {q.MIN_STUTTERS} AND stutters * {q.WORDS_PER_STUTTER} > n) OR (regexp_matches(line, {_quoted(q._BOILERPLATE)}) AND n <= 40) OR (NOT regexp_matches(line, {_quoted(q._SENTENCE)}) AND n >= {q.LONG_LINE}) AS fails FROM lm),
 l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE NOT fails), 0) AS left_chars FROM lf GROUP BY 1),
 m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, {symbol}))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(left_chars, 0) AS left_chars
  FROM w LEFT JOIN v USING (doc_id) LEFT JOIN l USING (doc_id)),
 b AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (word_chars = 0 OR 1 - left_chars / word_chars <= {q.MAX_LOSS}) AS kept FROM b"""


def _op5() -> str:
    return """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 walk(a, b) AS (SELECT a, b FROM links UNION SELECT w.a, l.b FROM walk w JOIN links l ON l.a = w.b),
 c AS (SELECT a AS vec_id, min(b) AS lowest FROM walk GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
 SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(lowest, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(lowest, vec_id)) AS kept FROM v LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""


def _op11() -> str:
    return """WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, ('0x' || substr(sha256(coalesce(conv_id::VARCHAR, '') || ':' || turn), 1, 8))::BIGINT AS h FROM conversations WHERE turn IS NOT NULL),
 f AS (SELECT conv_id, min(turn) AS first FROM o GROUP BY 1),
 every AS (SELECT conv_id, turn, role, text, h % 8 AS batch FROM o UNION ALL SELECT conv_id, turn, 'user', text, (h + 3) % 8 FROM o WHERE h % 7 < 2),
 a AS (SELECT conv_id, turn, batch, min(role || '|' || text) AS payload, arg_min(role, role || '|' || text) AS role FROM every GROUP BY 1, 2, 3),
 heard AS (SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS later FROM (SELECT DISTINCT conv_id, batch FROM a)),
 c AS (SELECT conv_id, min(CASE WHEN batch + 3 <= 7 AND coalesce(later, 99) > batch + 3 THEN batch + 3 ELSE 8 END) AS ends FROM heard GROUP BY 1),
 live AS (SELECT a.*, ends, first FROM a JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id JOIN f ON a.conv_id IS NOT DISTINCT FROM f.conv_id),
 k AS (SELECT conv_id, turn, first, ends, min(batch) AS batch, arg_min(payload, batch) AS payload, arg_min(role, batch) AS role FROM live WHERE batch <= ends GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 = turn - first AS gapless, max(batch) OVER (PARTITION BY conv_id ORDER BY turn) AS since, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) = turn - 1 AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role AS breaks FROM k)
 SELECT 'release' AS event, conv_id, turn, since AS batch, sha256(payload) AS sha256, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM r WHERE gapless
 UNION ALL SELECT 'reject', conv_id, turn, batch, sha256(payload), NULL, NULL FROM live WHERE batch > ends
 UNION ALL SELECT 'close', conv_id, -1, ends, sha256(coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE NOT gapless), '')), max(turn) - first + 1 - count(*), count(*) FILTER (WHERE breaks) FROM r GROUP BY conv_id, first, ends"""


def _op12() -> str:
    """Damage with a table-free CRC-32, faults by windows, then a forward pass that keeps for each of the four
    states its cheapest edits as one text, the cost in eight digits before the letters, so the least text wins."""
    pay = lambda x, cost, letter: f"(lpad((substr({x}, 1, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || substr({x}, 9) || '{letter}')"
    late, never = "(CASE WHEN cut THEN 5 ELSE 0 END)", "'50000000~'"
    opened = "least(s0, s1, i3)"
    entered = "least(s0, s1, s3)"
    role = "CASE WHEN e % 2 = 1 THEN 'user' ELSE 'assistant' END"
    space = _quoted(r"[^\x20\x09-\x0D]")
    return f"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS named FROM conversations),
 table_of AS (SELECT list_transform(range(256), lambda c: list_reduce(list_concat([c], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crcs),
 h AS (SELECT o.*, xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(named)), lambda k: ('0x' || substr(hex(named), 2 * k + 1, 2))::BIGINT)), lambda x, b: xor(x >> 8, crcs[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS harm FROM o, table_of),
 d AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE harm <> 0),
 f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, list_last(regexp_extract_all(text, {space})) AS tail FROM d),
 g AS (SELECT conv_id, turn, n, role, text, substr(role, 1, 1) AS initial, tail IS NULL AS blank, tail IS NOT NULL AND seen > 1 AS duplicate, tail IS NOT NULL AND seen = 1 AND tail NOT IN ('.', '!', '?') AS cut, substr(lead(role) OVER (PARTITION BY conv_id ORDER BY n), 1, 1) AS following, lead(n) OVER (PARTITION BY conv_id ORDER BY n) IS NOT NULL AS more FROM f),
 z AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE more AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM g GROUP BY 1),
 walk(conv_id, n, s0, s1, s2, s3) AS (SELECT conv_id, 0::BIGINT, '00000000', {never}, {never}, {never} FROM z UNION ALL
  SELECT w.conv_id, g.n, {pay("s0", 2, "D")},
   least({pay("s1", 2, "D")}, CASE WHEN initial = 's' AND NOT blank AND NOT duplicate THEN {pay("s0", late, "K")} ELSE {never} END),
   least({pay("i2", 2, "D")}, CASE WHEN blank OR duplicate THEN {never} ELSE least({pay(opened, "1 + " + late, "R")}, CASE WHEN initial = 'u' THEN {pay(opened, late, "K")} ELSE {never} END) END),
   least({pay("i3", 2, "D")}, CASE WHEN blank OR duplicate THEN {never} ELSE least({pay("i2", "1 + " + late, "R")}, CASE WHEN initial = 'a' THEN {pay("i2", late, "K")} ELSE {never} END) END)
  FROM (SELECT *, least(s3, {pay("i2", 5, "I")}) AS i3 FROM (SELECT *, least(s2, {pay(entered, 5, "I")}) AS i2 FROM walk)) w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.n = w.n + 1),
 b AS (SELECT z.conv_id, least(s0, s3, {pay("least(s2, " + pay("s1", 5, "I") + ")", 5, "I")}) AS best FROM walk w JOIN z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.rows = w.n),
 a AS (SELECT conv_id, substr(best, 1, 8)::BIGINT AS cost, substr(best, 9) AS audit FROM b),
 l AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM a),
 p AS (SELECT conv_id, k, substr(audit, k, 1) AS edit, length(replace(substr(audit, 1, k), 'I', '')) AS n FROM l),
 q AS (SELECT p.conv_id, k, edit, g.role, g.text, edit = 'K' AND initial = 's' AS keeps_system FROM p LEFT JOIN g ON p.edit <> 'I' AND g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.n = p.n WHERE edit <> 'D'),
 r AS (SELECT *, count(*) FILTER (WHERE NOT keeps_system) OVER (PARTITION BY conv_id ORDER BY k) AS e FROM q),
 s AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role ELSE {role} END) || ':' || (CASE WHEN edit = 'I' THEN '' ELSE text END), chr(10) ORDER BY k) AS repaired FROM r GROUP BY 1)
 SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id"""


def _op13() -> str:
    letters = _quoted("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 n AS (SELECT *, sha1(h) AS d, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS named FROM p)
 SELECT page_id, octet_length(encode(h)) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr({letters}, (((('0x' || substr(d, i // 8 * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN named END AS refers_to FROM n"""


ORACLE_SQL = {"op1_url_filter": _op1(), "op2_licenses": _op2(), "op4_quality": _op4(), "op5_embeddings": _op5(), "op11_reassembly": _op11(), "op12_repair": _op12(), "op13_warc": _op13()}
