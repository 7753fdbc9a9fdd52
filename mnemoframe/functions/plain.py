"""The text comparisons of ``text`` and ``contexts`` on plain strings, for ordered folds.

A fold's next comparison depends on what it has changed before, so it cannot be
a column expression; these give the same values, which the tests compare.
"""

from __future__ import annotations

import math
import re

from .text import NEGATION, SENTENCE_MARKS

_PUNCTUATION = re.compile(r"[ \t\n\x0b\f\r，,。；;：:、/\\-]+")
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_SHORT = re.compile("[一-鿿]{1,4}|[a-z0-9_]+")
_NEGATION = re.compile(NEGATION)


def normalized(x: str | None) -> str:
    return _PUNCTUATION.sub("", (x or "").strip(" ").lower())


def short_tokens(x: str | None) -> set[str]:
    return set(_SHORT.findall((x or "").lower()))


def overlap(a: str | None, b: str | None) -> float:
    x, y = normalized(a), normalized(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    short, long_ = sorted((x, y), key=len)
    if short in long_:
        return len(short) / len(long_)
    p, q = short_tokens(a), short_tokens(b)
    return len(p & q) / len(p | q) if p and q else 0.0


def negated(x: str) -> bool:
    return _NEGATION.search(x.lower()) is not None


def _listed(facts: dict | None) -> str:
    return "；".join(f"{k}：{'' if v is None else v}" for k, v in (facts or {}).items())


def card(c: dict) -> str:
    """Of a context or a draft, with labels."""
    label = lambda name, x: f"{name}{(x or '').strip(' ')}" if (x or "").strip(" ") else None
    facts = _listed(c.get("facts"))
    parts = [label("主体：", c.get("subject")), label("背景条件：", c.get("condition") or c.get("summary")), f"实况：{facts}" if facts else None, label("适用：", c.get("applies_when")), label("", c.get("description"))]
    return " ".join(p for p in parts if p is not None)


def _clipped(x: str | None, limit: int) -> str:
    return _SPACE.sub(" ", x or "").strip(SENTENCE_MARKS)[:limit]


def description(condition: str | None, facts: dict | None, applies_when: str | None, fallback: str | None) -> str:
    """Labelled parts joined by full stops, the fallback unless it is in them."""
    a, c, f = _clipped(condition, 192), _clipped(applies_when, 192), _listed(facts)
    parts = [name + x for name, x in (("背景条件：", a), ("实况：", f), ("适用：", c)) if x]
    rest = _clipped(fallback, 512)
    return _clipped("。".join([*parts, rest] if rest and rest not in " ".join(parts) else parts), 512)


def evidence_overlap(evidence: str | None, said: str) -> float:
    if not (evidence or "").strip(" "):
        return 0.0
    e = normalized(evidence)
    return 1.0 if e and e in normalized(said) else overlap(said, evidence)


def temporal_compatibility(a_from: int | None, a_to: int | None, b_from: int | None, b_to: int | None, window: float = 2592000.0) -> float:
    x, y = a_from or 0, b_from or 0
    if (a_to and y and a_to < y) or (b_to and x and b_to < x):
        return 0.35
    return 0.7 if not x or not y else max(0.3, math.exp(-abs(x - y) / window))
