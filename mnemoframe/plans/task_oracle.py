"""DuckDB SQL for the memories of a task, from the same rows as the query and by its own words.

The task's literals and rare tokens are written out: its one literal, and the
tokens that are not single digits, of which there are fewer than the query keeps.
"""

from __future__ import annotations

from .demo import ctes

TASK = "what did user number 2 click in lot 7, see LOT_7"
PATTERN = "## Clicks\nuser 2 clicks often\n## Other\nnothing"
_TERMS = "lot_7|what|did|user|number|click|in|lot|see"
_EVENT = "concat_ws(' ', nullif({e}.summary, ''), nullif({e}.action, ''), nullif({e}.causality, ''), CASE WHEN {e}.payload NOT IN ('', '{{}}') THEN {e}.payload END)"
_CARD = "concat_ws('；', {e}.summary, {e}.action, {e}.causality)"
_CONTEXT = "concat_ws(' ', nullif(trim(c.subject), ''), nullif(trim(c.condition), ''), nullif(trim(c.applies_when), ''), nullif(trim(c.summary), ''), nullif(trim(c.description), ''))"
#: The literal is met by itself or by a pair of its letters.
_LITERAL = "CAST(regexp_matches(regexp_replace(lower({x}), '\\s+', '', 'g'), 'lo|ot|t_|_7') AS INTEGER)"
_TYPE = "CASE relation_type WHEN 'merge' THEN '同一主题' WHEN '补充' THEN '共同背景' WHEN '意义更新' THEN '意义更新' ELSE '' END"


def _path(stage: int, at: str, first: str, second: str, kind: str, primary: str, length: int, literal: str, hits: str, support: str, last: str, folded: str, reason: str, warning: str = "false", gone: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"SELECT {{'s': {stage}, 'a': CAST({at} AS BIGINT), 'f': {first}, 'g': {second}}} AS seq, '{kind}' AS kind, {primary} AS primary_id, {length} AS length, {literal} AS lit, CAST({hits} AS BIGINT) AS hits, CAST({support} AS BIGINT) AS support, CAST({last} AS BIGINT) AS last, {folded} AS folded, {reason} AS reason, {warning} AS warning, {gone} AS gone"


def _event(stage: int, at: str, length: int, hits: str) -> str:
    return _path(stage, at, "e.id", "''", "event", "e.id", length, _LITERAL.format(x=_EVENT.format(e="e")), hits, "coalesce(e.support_count, 1)", "coalesce(nullif(e.last_active, 0), e.timestamp, 0)", _CARD.format(e="e"), "'event'")


_NEWER = "t IN ('同一主题', '意义更新')"
_RELATION = _path(
    5, "-x.updated_at", "x.from_id", "x.to_id", "event", f"CASE WHEN {_NEWER} THEN to_id ELSE from_id END", 2, _LITERAL.format(x=f"{_EVENT.format(e='a')} || ' ' || {_EVENT.format(e='b')}"), "0", "greatest(coalesce(a.support_count, 1), coalesce(b.support_count, 1))",
    "greatest(coalesce(nullif(a.last_active, 0), a.timestamp, 0), coalesce(nullif(b.last_active, 0), b.timestamp, 0))", f"CASE WHEN {_NEWER} THEN {_CARD.format(e='b')} WHEN {_CARD.format(e='a')} = {_CARD.format(e='b')} THEN {_CARD.format(e='a')} ELSE {_CARD.format(e='a')} || '；' || {_CARD.format(e='b')} END", "t", "t = '意义更新'", f"CASE WHEN {_NEWER} AND from_id <> to_id THEN from_id END",
)

TASK_BULLETS = f"""{ctes("events", "contexts", "entities", "involves", "in_rel", "event_relation")},
  ent AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM g_entities WHERE registered AND coalesce(status = 'active', true) AND regexp_matches(lower(concat_ws(' ', id, type, description)), '{_TERMS}')),
  ctx AS (SELECT c.*, row_number() OVER (ORDER BY last_seen_at DESC, id) - 1 AS pos FROM (SELECT * FROM g_contexts WHERE status = 'active' ORDER BY last_seen_at DESC, id LIMIT 240) c WHERE regexp_matches(lower({_CONTEXT}), '{_TERMS}')),
  evt AS (SELECT e.*, row_number() OVER (ORDER BY last_active DESC, id) - 1 AS pos FROM (SELECT * FROM g_events WHERE status = 'active' ORDER BY last_active DESC, id LIMIT 240) e WHERE regexp_matches(lower({_EVENT.format(e="e")}), '{_TERMS}')),
  linked AS (SELECT event_id AS id, count(DISTINCT entity_id) AS hits, bool_or(r <= 20) AS near FROM g_involves JOIN ent ON ent.id = entity_id GROUP BY event_id),
  near AS (SELECT * FROM g_events WHERE id IN (SELECT event_id FROM g_in_rel JOIN ctx ON ctx.id = context_id WHERE ctx.pos < 20) ORDER BY last_active DESC, id LIMIT 40),
  edge AS (SELECT DISTINCT r.*, {_TYPE} AS t FROM g_event_relation r JOIN evt ON evt.pos < 40 AND evt.id IN (from_id, to_id) WHERE {_TYPE} <> ''),
  hop AS (SELECT x.* FROM edge x JOIN g_events a ON a.id = from_id AND a.status = 'active' JOIN g_events b ON b.id = to_id AND b.status = 'active' ORDER BY x.updated_at DESC, from_id, to_id LIMIT 320),
  p AS ({_path(0, "r", "'user_2'", "''", "rule", "CAST(NULL AS VARCHAR)", 2, "0", "1", "1", "2", "'Clicks；user 2 clicks often'", "'rule'")} FROM ent WHERE id = 'user_2' AND r <= 20
    UNION ALL {_path(1, "c.pos", "c.id", "''", "context", "c.id", 1, _LITERAL.format(x=_CONTEXT), "0", "coalesce(c.support_count, 1)", "c.last_seen_at", "c.condition", "'context'")} FROM ctx c WHERE pos < 20
    UNION ALL {_event(2, "-e.last_active", 2, "l.hits")} FROM g_events e JOIN linked l ON l.id = e.id AND l.near WHERE e.status = 'active'
    UNION ALL {_event(3, "e.pos", 1, "0")} FROM evt e WHERE pos < 20
    UNION ALL {_event(4, "-e.last_active", 2, "0")} FROM near e WHERE status = 'active'
    UNION ALL {_RELATION} FROM hop x JOIN g_events a ON a.id = from_id JOIN g_events b ON b.id = to_id),
  k AS (SELECT * EXCLUDE (seq), concat(kind, ':', coalesce(primary_id, folded)) AS key, min(seq) OVER (PARTITION BY kind, coalesce(primary_id, folded)) AS first, seq FROM p WHERE folded <> '' AND NOT (kind = 'event' AND reason NOT IN ('同一主题', '意义更新') AND coalesce(primary_id IN (SELECT gone FROM p WHERE gone IS NOT NULL), false))),
  f AS (SELECT *, CASE WHEN warning OR kind = 'rule' THEN 1 WHEN kind = 'context' THEN 2 ELSE 3 END AS tier FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY lit DESC, hits DESC, support DESC, last DESC, seq) = 1),
  s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY regexp_replace(lower(folded), '\\s+', '', 'g') ORDER BY tier, lit DESC, hits DESC, length, support DESC, last DESC, first) = 1)
  SELECT CAST(row_number() OVER (ORDER BY tier, lit DESC, hits DESC, length, support DESC, last DESC, first) AS INTEGER) AS rank, CASE WHEN warning THEN 'Warning' WHEN kind = 'rule' THEN 'Rule' WHEN kind = 'context' THEN 'Context' ELSE 'Event' END AS kind,
    '- [' || CASE WHEN warning THEN 'Warning' WHEN kind = 'rule' THEN 'Rule' WHEN kind = 'context' THEN 'Context' ELSE 'Event' END || '] ' || folded AS text FROM s QUALIFY rank <= 5"""
