"""DuckDB SQL for the ``opN_`` queries that SQL can express."""

from __future__ import annotations

from .host_rules import LIMIT, PRIOR_DOCUMENTS
from .license_texts import VERSIONS
from .licenses import TEMPLATES, WEAK, flat

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"'[^ \t-\r]+'"
_TERMS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: The conversations as mail: turns quote the turn before, the two before at two levels, or the one before that.
QUOTING = """
SELECT c.conv_id, c.turn, c.role, CASE
  WHEN c.turn % 4 = 1 AND p.text IS NOT NULL THEN '> ' || replace(p.text, chr(10), chr(10) || '> ') || chr(10) || c.text
  WHEN c.turn % 4 = 2 AND o.text IS NOT NULL THEN '>> ' || replace(o.text, chr(10), chr(10) || '>> ') || chr(10) || '> ' || replace(p.text, chr(10), chr(10) || '> ') || chr(10) || c.text
  WHEN c.turn % 4 = 3 AND o.text IS NOT NULL THEN '> > > ' || replace(o.text, chr(10), chr(10) || '> > > ') || chr(10) || c.text
  ELSE c.text END AS text
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 LEFT JOIN conversations o ON o.conv_id = c.conv_id AND o.turn = c.turn - 2
"""

OP2 = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, row_number() OVER () AS id FROM conversations),
l0 AS (SELECT id, conv_id, turn, unnest(string_split_regex(coalesce(text, ''), '\r\n?|\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\r\n?|\n'), 1) AS pos FROM m),
l1 AS (SELECT id, conv_id, turn, pos, len(regexp_replace(regexp_extract(line, '^[ \t]*(>[> \t]*)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*>[> \t]*', '') AS body FROM l0),
l2 AS (SELECT *, level = 0 AND coalesce(lead(level) OVER w, 0) > 0 AND regexp_matches(trim(body), '(?i)^(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\bécrit|el\b.*\bescribió)\s*:$') AS attribution,
  trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS norm, lag(level) OVER w IS DISTINCT FROM level AS starts FROM l1 WINDOW w AS (PARTITION BY id ORDER BY pos)),
l AS (SELECT *, max(CASE WHEN starts THEN pos END) OVER (PARTITION BY id ORDER BY pos) AS passage FROM l2),
own AS (SELECT DISTINCT conv_id, norm, turn FROM l WHERE level = 0 AND NOT attribution AND norm <> ''),
q AS (SELECT id, level, passage, (SELECT max(own.turn) FROM own WHERE own.conv_id = l.conv_id AND own.norm = l.norm AND own.turn < l.turn) AS found FROM l WHERE level > 0 AND norm <> ''),
votes AS (SELECT id, level, passage, found, count(*) AS n FROM q WHERE found IS NOT NULL GROUP BY ALL),
parent AS (SELECT id, arg_max(found, {'l': -level, 'n': n, 'f': found}) AS parent FROM votes GROUP BY id),
counts AS (SELECT id, count(*) AS n_quoted, count(found) AS n_found FROM q GROUP BY id),
before AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before_ FROM (SELECT DISTINCT conv_id, turn FROM m)),
heads AS (SELECT conv_id, turn, max(parent) AS parent FROM parent JOIN m USING (id) JOIN before USING (conv_id, turn) GROUP BY conv_id, turn, before_ HAVING max(parent) <> before_),
own_body AS (SELECT id, bool_or(level > 0) AS quoting, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE level = 0 AND NOT attribution), ''), '^\s+|\s+$', '', 'g') AS body FROM l GROUP BY id),
turns AS (SELECT t.conv_id, t.turn, (SELECT max(h.turn) FROM heads h WHERE h.conv_id = t.conv_id AND h.turn <= t.turn) AS run, before_ FROM before t),
path AS (SELECT h.conv_id, h.turn AS run, h.parent, t.run AS up, CAST(-h.parent AS VARCHAR) || '/' || h.turn AS thread FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.turn = h.parent
  UNION ALL SELECT p.conv_id, p.run, h.parent, t.run, -h.parent || '/' || h.turn || '/' || p.thread FROM path p JOIN heads h ON h.conv_id = p.conv_id AND h.turn = p.up JOIN turns t ON t.conv_id = h.conv_id AND t.turn = h.parent)
SELECT m.conv_id, m.turn, m.role, CASE WHEN quoting THEN b.body ELSE m.text END AS body, coalesce(parent.parent, before_) AS reply_to, parent.parent IS NOT NULL AS linked,
  coalesce(n_quoted, 0) AS n_quoted, coalesce(n_found, 0) AS n_found, coalesce(path.thread, '') AS thread
FROM m JOIN own_body b USING (id) LEFT JOIN parent USING (id) LEFT JOIN counts USING (id) JOIN turns ON turns.conv_id = m.conv_id AND turns.turn = m.turn
LEFT JOIN path ON path.conv_id = m.conv_id AND path.run = turns.run AND path.up IS NULL
"""

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
early AS (SELECT g, min({{'d': doc_id, 's': s}}) AS f FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM win JOIN early USING (g) WHERE f <> {{'d': doc_id, 's': s}}),
per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORDS}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') || CASE WHEN len(w) < 5 THEN '#' || len(w) ELSE '' END AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)
"""

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_TERMS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_TERMS}) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, n, item_id FROM dw JOIN win USING (n, g)),
cover AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS k, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c, 0) AS n_hit, coalesce(k, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(c, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_TEMPLATES = ", ".join("('{}', {}, '{}')".format(k, i, v.replace("'", "''")) for i, (k, v) in enumerate(flat(TEMPLATES)))
_TERM = r"'[a-z0-9]+(?:\.[0-9]+)*'"
_VERSIONS = ", ".join(f"('{name}', {vs})" for name, vs in VERSIONS.items())
_WEAK = f"license IN ({str(WEAK)[1:-1]})"

OP8 = f"""
WITH t(license, tid, x) AS (VALUES {_TEMPLATES}), vs(license, own) AS (VALUES {_VERSIONS}),
tb AS (SELECT license, tid, term, count(*) AS n FROM (SELECT license, tid, unnest(regexp_extract_all(lower(x), {_TERM})) AS term FROM t) GROUP BY ALL),
f AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, coalesce(source, '_') AS a, coalesce(source, '_') || '/' || coalesce(lang, '_') AS b, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || doc_id || '.txt' AS path FROM documents),
df AS (SELECT term, count(*) AS c FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), {_TERM}))) AS term FROM f) GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM f)) / (1.0 + coalesce(c, 0))) + 1 AS w FROM (SELECT term FROM tb UNION SELECT term FROM df) LEFT JOIN df USING (term)),
u AS (SELECT id, 0 AS pos, text AS unit FROM f UNION ALL
      SELECT id, pos, unit FROM (SELECT id, unnest(string_split_regex(text, '\\r\\n?|\\n')) AS unit, generate_subscripts(string_split_regex(text, '\\r\\n?|\\n'), 1) AS pos FROM f) WHERE trim(unit) <> '' UNION ALL
      SELECT id, -pos, unit FROM (SELECT id, unnest(blocks) AS unit, generate_subscripts(blocks, 1) AS pos FROM (SELECT id, string_split_regex(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n(?:[ \\t#*/;%-]*\\n)+') AS blocks FROM f)) WHERE contains(trim(unit, chr(10)), chr(10))),
ub AS (SELECT id, pos, term, count(*) AS n FROM (SELECT id, pos, unnest(regexp_extract_all(lower(unit), {_TERM})) AS term FROM u) GROUP BY ALL),
un AS (SELECT id, pos, sqrt(sum(pow(n * w, 2))) AS norm, list(term) FILTER (WHERE regexp_matches(term, '^[1-9](\\.[0-9])?$')) AS numbers FROM ub JOIN idf USING (term) GROUP BY ALL),
tn AS (SELECT tid, sqrt(sum(pow(n * w, 2))) AS norm FROM tb JOIN idf USING (term) GROUP BY tid),
dot AS (SELECT id, pos, license, tid, sum(ub.n * tb.n * w * w) AS d FROM ub JOIN tb USING (term) JOIN idf USING (term) GROUP BY ALL),
sc AS (SELECT id, pos, license, round(d / un.norm / tn.norm, 9) AS s FROM dot JOIN un USING (id, pos) JOIN tn USING (tid) LEFT JOIN vs USING (license) WHERE round(d / un.norm / tn.norm, 9) >= 0.6 AND (numbers IS NULL OR own IS NULL OR list_has_any(numbers, own))),
best AS (SELECT id, license, s FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_WEAK}, s DESC, license, pos) = 1),
decl AS (SELECT b AS dir, license, s FROM best JOIN f USING (id) WHERE id IN (SELECT id FROM sc WHERE pos = 0) QUALIFY row_number() OVER (PARTITION BY b ORDER BY {_WEAK}, s DESC, path) = 1)
SELECT doc_id, path, coalesce(best.license, decl.license) AS license, round(coalesce(best.s, decl.s), 6) AS score,
  CASE WHEN best.license IS NOT NULL THEN 'own' WHEN decl.license IS NOT NULL THEN 'inherited' END AS origin
FROM f LEFT JOIN best USING (id) LEFT JOIN decl ON decl.dir = f.b
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h) AS n, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS f FROM p),
v AS (SELECT *, [CAST('0x' || hex[5 * i + 1:5 * i + 5] AS BIGINT) for i in range(0, 8)] AS q FROM x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((q[1 + j // 4] >> (15 - 5 * (j % 4))) & 31) AS BIGINT), 1) for j in range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM v
"""

def _elkan_sql(k: int = 16, rounds: int = 3) -> str:
    """Plain assignment to the nearest centroid, round after round, without bounds."""
    nearest = "SELECT id, vec_id, v, arg_min({{'j': j, 'd': d}}, {{'d': d, 'j': j}}) AS b FROM (SELECT id, vec_id, v, j, CAST(list_sum([power(v[p] - c[p], 2) for p in range(1, 65)]) AS BIGINT) AS d FROM kept, c{i}) GROUP BY ALL"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS ({nearest.format(i=i)})")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT j, list(q ORDER BY p) AS c FROM (SELECT b.j AS j, p, CAST(floor(sum(x) / count(*)) AS BIGINT) AS q FROM (SELECT b, unnest(v) AS x, unnest(range(1, 65)) AS p FROM a{i}) GROUP BY ALL) GROUP BY j)")
            steps.append(f"c{i + 1} AS (SELECT c{i}.j, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (j))")
    return f"""
WITH kept AS (SELECT row_number() OVER () AS id, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM kept ORDER BY j LIMIT {k}),
{",\n".join(steps)}
SELECT vec_id, CAST(b.j AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.j) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.j = b.j
"""


OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
x AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM x LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(a) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.a || q.a || r.a || s.a || t.a AS filter_order FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.a, q.a, r.a, s.a, t.a])) = 5),
e AS (SELECT part, filter_order, step, filter_order[step] AS a, n, good, toxic, fails, contains(fails, filter_order[step]) AS failed,
  len([i for i in range(1, step) if contains(fails, filter_order[i])]) > 0 AS gone FROM m, o, range(1, 6) AS s(step)),
g AS (SELECT part, filter_order, step, a, sum(n) FILTER (WHERE NOT failed AND NOT gone) AS kept, sum(n) FILTER (WHERE failed AND NOT gone) AS removed, sum(n) FILTER (WHERE failed AND gone) AS redundant,
  sum(n) FILTER (WHERE fails = a) AS unique_fails, sum(good) FILTER (WHERE failed AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE failed AND NOT gone) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, a), 0) AS BIGINT) AS shapley FROM g
"""

_RULES = ("base", "symbols", "lines", "word_length")

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
win AS (SELECT id, s, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS s FROM d)),
rep AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(s, s + 3)) AS p FROM (SELECT id, s FROM win QUALIFY count(*) OVER (PARTITION BY id, g) > 1)) GROUP BY id),
l AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ \\t-\\r]') GROUP BY id),
m AS (SELECT id, doc_id, host, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN rep USING (id) LEFT JOIN l USING (id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS lines, word_chars < 2 * n_words OR word_chars > 12 * n_words AS word_length FROM m),
c AS (SELECT host, rule, count(*) AS n, sum(CAST(failed AS BIGINT)) AS f FROM (SELECT host, unnest(['{"', '".join(_RULES)}']) AS rule, unnest([{", ".join(_RULES)}]) AS failed FROM r WHERE host IS NOT NULL) GROUP BY ALL),
s AS (SELECT rule, sum(f) / sum(n) AS mean, sum(n) AS n, sum(n) - sum(n * n) / sum(n) AS between_, sum(f * f / n) AS s, count(*) AS hosts FROM c GROUP BY rule),
e AS (SELECT rule, mean, mean * (1 - mean) AS drawn, between_, s - n * mean * mean - (hosts - 1) * mean * (1 - mean) AS excess FROM s),
p AS (SELECT rule, mean, least(greatest(CASE WHEN between_ > 0 AND excess > 0 THEN drawn * between_ / excess - 1 ELSE {PRIOR_DOCUMENTS[1]} END, {PRIOR_DOCUMENTS[0]}), {PRIOR_DOCUMENTS[1]}) AS weight FROM e),
v AS (SELECT host, bool_or(round((f + mean * weight) / (n + weight), 9) > {LIMIT}) AS bad FROM c JOIN p USING (rule) GROUP BY host)
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}, base AS base_failed, NOT base AND NOT coalesce(bad, false) AS kept
FROM r LEFT JOIN v USING (host)
"""

#: ``QUOTING`` instead of the table.
QUOTED = OP2.replace("WITH RECURSIVE m AS", f"WITH RECURSIVE talk AS ({QUOTING}),\nm AS").replace("AS id FROM conversations)", "AS id FROM talk)")

ORACLES: dict[str, str] = {"op2_quotation_linking": OP2, "quoted_conversations": QUOTED, "op5_substring_dedup": OP5, "op6_ngram_join": OP6, "op7_decontamination": OP7, "op8_license_scan": OP8, "op10_warc": OP10, "op11_elkan": _elkan_sql(), "op12_filter_audit": OP12, "op13_host_rules": OP13}
