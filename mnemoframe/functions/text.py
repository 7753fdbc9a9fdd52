"""Text expressions. All are built-in functions: no Python runs in a query.

Segmentation is pluggable where it matters (``tokens`` takes any expression of
an array); the default cuts Latin words and CJK bigrams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters stripped from the ends of clauses, fragments, sentences and names.
CLAUSE_MARKS = " ，,。；;"
FRAGMENT_MARKS = " ，,。；;:：|"
SENTENCE_MARKS = " ，,。；;：:"
NAME_MARKS = " ，,。；;：:\"'()[]{}"

#: What tells a passing intent, and what tells a lasting trait.
INTENT_MARKERS = ["想", "希望", "打算", "计划", "准备", "请求", "要求", "需要", "我要", "我想", "帮我", "请", "为了", "目标", "意图", "want", "wants", "hope", "hopes", "plan", "plans", "intend", "intends", "request", "requests", "need", "needs", "goal"]
STABLE_MARKERS = ["长期", "稳定", "习惯", "偏好", "经常", "通常", "常常", "画像", "身份", "角色", "能力", "关系", "long-term", "stable", "habit", "usually"]
#: Fixed value. Unanchored on purpose: "no" also counts inside words.
NEGATION = "不|没|无|非|否|停止|取消|避免|without|not|no|never"

_CJK = r"一-鿿"
_NO_STRINGS = "cast(array() as array<string>)"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    """A string, never null."""
    return F.coalesce(col(x).cast("string"), F.lit(""))


def matches(x: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text(x), F.lit(pattern), F.lit(group))


def strip(x: Column, marks: str = CLAUSE_MARKS) -> Column:
    return F.btrim(x, F.lit(marks))


def one_space(x: Column | str) -> Column:
    return F.regexp_replace(text(x), r"\s+", " ")


def bigrams(x: Column) -> Column:
    """All runs of two characters; none if there is at most one."""
    n = F.length(x)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: x.substr(i, F.lit(2)))
    # one pass over long texts; the expression steps by UTF-16 units, so characters beyond the first plane take the other way
    linear = F.regexp_extract_all(x, F.lit(r"(?s)(?=(..))"), 1)
    return F.when(n < 2, F.expr(_NO_STRINGS)).when(x.rlike(r"[\x{10000}-\x{10FFFF}]"), each).otherwise(linear)


def tokens(x: Column | str) -> Column:
    """Lower-case Latin words and, for runs of CJK characters, their bigrams (a single one stands alone)."""
    low = F.lower(text(x))
    runs = matches(low, f"[a-z0-9_]+|[{_CJK}]+")
    cut = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{_CJK}]{{2,}}$"), bigrams(r)).otherwise(F.array(r))))
    return F.when(low.rlike(f"[{_CJK}]"), cut).otherwise(matches(low, "[a-z0-9_]+"))


def informative(token: Column) -> Column:
    return (token != "") & ~token.rlike("^[0-9]$") & ~token.rlike(f"^[{_CJK}]$")


def informative_tokens(x: Column | str) -> Column:
    return F.filter(tokens(x), informative)


def gram_tokens(x: Column | str) -> Column:
    """Distinct: CJK runs of two and more, Latin words, and the bigrams of the text without white space."""
    low = F.lower(text(x))
    packed = F.regexp_replace(low, r"\s+", "")
    grams = F.when(F.length(packed) == 1, F.array(packed)).otherwise(bigrams(packed))
    return F.array_distinct(F.concat(matches(low, f"[{_CJK}]{{2,}}|[a-z0-9_]+"), grams))


def short_tokens(x: Column | str, grams: bool = False) -> Column:
    """Distinct: CJK runs cut at four characters, Latin words; optionally bigrams of the normalised text."""
    low = F.lower(text(x))
    found = matches(low, f"[{_CJK}]{{1,4}}|[a-z0-9_]+")
    if grams:
        packed = normalized(low)
        found = F.concat(found, F.when(F.length(packed) == 1, F.array(packed)).otherwise(bigrams(packed)))
    return F.array_distinct(found)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def lexical_score(x: Column | str, query: Column | str, entities: Column | None = None) -> Column:
    """Jaccard of the gram tokens, plus a quarter for each entity token in the text."""
    own = gram_tokens(x)
    score = jaccard(own, gram_tokens(query))
    if entities is not None:
        names = F.array_distinct(F.flatten(F.transform(entities, gram_tokens)))
        score = score + 0.25 * F.size(F.array_intersect(own, names))
    return score


def normalized(x: Column | str) -> Column:
    """Lower case without white space and common punctuation (a fixed value)."""
    return F.regexp_replace(F.lower(F.trim(text(x))), r"[\s，,。；;：:、/\\-]+", "")


def overlap(a: Column | str, b: Column | str) -> Column:
    """1 if normalised texts are equal, the length ratio if one holds the other, else the Jaccard of short tokens."""
    x, y = normalized(a), normalized(b)
    short, long_ = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    within = F.when(F.length(x) <= F.length(y), F.contains(y, x)).otherwise(F.contains(x, y))
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).when(within, short / long_).otherwise(jaccard(short_tokens(a), short_tokens(b)))


def matched_terms(x: Column | str, terms: Column, loose: bool = False) -> Column:
    """The terms that stand in the text or share a token with it, first spelling of each.

    ``loose`` compares gram tokens, else informative tokens.
    """
    cut = gram_tokens if loose else informative_tokens
    low = F.lower(text(x))
    asked = F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != "")
    found = once(F.struct(low.alias("low"), cut(low).alias("own")), lambda d: F.filter(asked, lambda t: F.contains(d["low"], F.lower(t)) | F.arrays_overlap(d["own"], cut(t))))
    return F.array_distinct(found) if loose else first_spellings(found)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it: what a lambda names is else computed for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def first_spellings(values: Column) -> Column:
    """Distinct regardless of case; the first spelling stays."""
    return once(values, lambda vs: once(F.transform(vs, F.lower), lambda low: F.filter(vs, lambda v, i: (v != "") & (F.array_position(low, F.lower(v)) == i + 1))))


def literal_hits(matched: Column, literals: Column) -> Column:
    """How many literals are among the matched terms, regardless of case."""
    return once(F.transform(matched, F.lower), lambda held: F.size(F.filter(literals, lambda x: F.array_contains(held, F.lower(x)))))


#: Shapes of literals in order: URL, path, ENV_NAME, version, number with unit, dotted name.
LITERALS = [
    r"https?://[^\s，。；;]+",
    r"(?:~|\.{1,2}|/)[\w./:@%+\-=]+",
    r"\b[A-Z][A-Z0-9_]{2,}\b",
    r"\bv?\d+(?:\.\d+){1,3}(?:[-_][A-Za-z0-9.]+)?\b",
    r"\d+(?:\.\d+)?\s?(?:度|℃|%|ms|s|秒|分钟|小时|天|MB|GB|kb|KB|元|次)",
    r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\b",
]
QUOTED = "[`\"'“”‘’]([^`\"'“”‘’]{2,120})[`\"'“”‘’]"
#: Fixed value: a number of two to five digits that is no part of a word or a longer number.
BARE_NUMBER = r"(?<![\w.])\d{2,5}(?![\w.])"


def literal_anchors(x: Column | str) -> Column:
    """Literals of a text in order of kind, then place; a bare number only if no richer literal holds it."""
    own = F.concat(*[matches(x, p) for p in LITERALS], matches(x, QUOTED, 1))
    rich = F.array_distinct(F.filter(F.transform(own, strip), lambda v: v != ""))
    bare = F.filter(matches(x, BARE_NUMBER), lambda n: ~F.exists(rich, lambda v: F.contains(v, n) & (v != n)))
    return F.array_distinct(F.concat(rich, bare))


def trim_line(x: Column | str, limit: int = 160) -> Column:
    """One line of at most ``limit`` characters, cut with an ellipsis."""
    line = strip(one_space(x))
    cut = F.rtrim(F.regexp_replace(line.substr(F.lit(1), F.lit(max(1, limit - 1))), f"[{CLAUSE_MARKS}]+$", ""))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(cut, F.lit("…")))


def join_clause(*parts: Column | str, array: Column | None = None, limit: int = 160) -> Column:
    """Cleaned distinct parts joined by a full-width semicolon, as one line."""
    given = array if array is not None else F.array(*[text(p) for p in parts])
    clean = F.array_distinct(F.filter(F.transform(given, lambda p: strip(one_space(p))), lambda p: p != ""))
    return trim_line(F.array_join(clean, "；"), limit)


def plain_markdown(x: Column | str) -> Column:
    """Lines without heading and bullet marks, as one clause."""
    lines = F.transform(F.split(text(x), r"\r\n?|\n"), lambda s: F.regexp_replace(F.regexp_replace(F.trim(s), r"^#{1,6}\s*", ""), r"^[-*]\s*", ""))
    return join_clause(array=lines)


def joined(*parts: Column | str) -> Column:
    """The parts that are not blank, with spaces between."""
    return F.concat_ws(" ", *[F.when(F.trim(text(p)) != "", text(p)) for p in parts])


def event_text(summary="summary", action="action", causality="causality", payload: Column | str | None = None) -> Column:
    """What an event is searched by; with its payload's JSON if given (an empty object counts as none)."""
    more = [] if payload is None else [F.when(~text(payload).isin("", "{}"), text(payload))]
    return joined(summary, action, causality, *more)


def pairs_of(facts: Column | str, between: str, separator: str, limit: int | None = None) -> Column:
    entries = F.map_entries(col(facts))
    if limit is not None:
        entries = F.slice(entries, 1, limit)
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(between), text(e["value"]))), separator), F.lit(""))


def context_text(subject="subject", condition="condition", facts="facts", applies_when="applies_when", summary="summary", description="description") -> Column:
    return joined(subject, condition, pairs_of(facts, " ", " "), applies_when, summary, description)


def entity_text(id="id", aliases="aliases", type="type", description="description") -> Column:
    return joined(id, F.array_join(F.coalesce(col(aliases), F.expr(_NO_STRINGS)), " "), type, description)


def event_card(summary="summary", action="action", causality="causality") -> Column:
    return join_clause(summary, action, causality)


def _first_text(*xs: Column | str) -> Column:
    return F.coalesce(*[F.when(text(x) != "", text(x)) for x in xs], F.lit(""))


def context_card(condition="condition", facts="facts", applies_when="applies_when", summary="summary", description="description") -> Column:
    """Condition (else summary, else description), the first four facts, and where it applies."""
    scope = F.when(text(applies_when) != "", F.concat(F.lit("适用于"), text(applies_when)))
    return join_clause(_first_text(condition, summary, description), pairs_of(facts, "", "，", 4), F.coalesce(scope, F.lit("")))


def labelled_card(subject="subject", condition="condition", facts="facts", applies_when="applies_when", summary="summary", description="description") -> Column:
    """The card with its labels, as embedded and compared."""
    label = lambda name, x: F.when(F.trim(text(x)) != "", F.concat(F.lit(name), F.trim(text(x))))
    listed = pairs_of(facts, "：", "；")
    return F.concat_ws(" ", label("主体：", subject), label("背景条件：", _first_text(condition, summary)), F.when(listed != "", F.concat(F.lit("实况："), listed)), label("适用：", applies_when), F.when(F.trim(text(description)) != "", F.trim(text(description))))


def clipped(x: Column | str, limit: int) -> Column:
    return strip(one_space(x), SENTENCE_MARKS).substr(F.lit(1), F.lit(limit))


def context_description(condition="condition", facts="facts", applies_when="applies_when", fallback="description") -> Column:
    """Labelled parts joined by full stops, the fallback unless it is in them; at most 512 characters."""
    a, c, f = clipped(condition, 192), clipped(applies_when, 192), pairs_of(facts, "：", "；")
    parts = F.filter(F.array(F.when(a != "", F.concat(F.lit("背景条件："), a)), F.when(f != "", F.concat(F.lit("实况："), f)), F.when(c != "", F.concat(F.lit("适用："), c))), lambda p: p.isNotNull())
    rest = clipped(fallback, 512)
    more = F.when((rest != "") & ~F.contains(F.array_join(parts, " "), rest), F.array(rest)).otherwise(F.expr(_NO_STRINGS))
    return clipped(F.array_join(F.concat(parts, more), "。"), 512)


def normalize_key(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(text(x)), r"\s+", "")


#: A day of this century by numbers, and a time of day with or without seconds.
DAY = r"20[0-9]{2}(?:[-/][0-9]{1,2}){2}"
CLOCK = r"[0-9]{1,2}(?::[0-9]{2}){1,2}"
_DATETIME = rf"\b{DAY}\s+{CLOCK}\b"


def clean_fragment(x: Column | str, limit: int = 80) -> Column:
    """One line without dates and edge punctuation; cut with three dots."""
    line = strip(F.regexp_replace(one_space(F.trim(text(x))), _DATETIME, ""), FRAGMENT_MARKS)
    return F.when(F.length(line) > limit, F.concat(F.rtrim(line.substr(F.lit(1), F.lit(limit))), F.lit("..."))).otherwise(line)


def contains_negation(x: Column | str) -> Column:
    return F.lower(text(x)).rlike(NEGATION)


def negation_conflict(a: Column, b: Column, least: float) -> Column:
    """One side is negated, the other not, and they overlap."""
    return (contains_negation(a) != contains_negation(b)) & (overlap(a, b) >= least)


def current_intent(summary="summary", condition="condition", applies_when="applies_when") -> Column:
    """Says what someone wants now rather than what lasts."""
    said = F.lower(F.concat_ws(" ", text(summary), text(condition), text(applies_when)))
    some = lambda words: said.rlike("|".join(words))
    return some(INTENT_MARKERS) & ~some(STABLE_MARKERS)


def evidence_matches(evidence: Column | str, record: Column | str) -> Column:
    e = normalized(evidence)
    return F.when(text(evidence) == "", F.lit(False)).when(text(record) == "", F.lit(True)).otherwise((e != "") & F.contains(normalized(record), e))


def valid_draft(summary="summary", description="description", raw_length: Column | None = None) -> Column:
    """A summary of 1 to 128 characters without braces or quotes, a description of at most 512."""
    s = F.trim(text(summary))
    n = F.length(s) if raw_length is None else F.greatest(F.length(s), F.coalesce(raw_length, F.lit(0)))
    return (s != "") & (n <= 128) & ~s.rlike(r'[{}"]') & (F.length(F.trim(text(description))) <= 512)


def entity_name(x: Column | str) -> Column:
    """A cleaned name; names of one character count as none."""
    name = strip(one_space(x), NAME_MARKS)
    return F.when(F.length(name) > 1, name).otherwise(F.lit(""))


def entity_names(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, entity_name), lambda n: n != ""))


def slug(x: Column | str, limit: int = 30) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text(x)), "[^a-z0-9]+", "-"), F.lit("-")).substr(F.lit(1), F.lit(limit))


def character_overlap(a: Column | str, b: Column | str) -> Column:
    """Share of b's distinct characters (white space aside) that a has too."""
    chars = lambda x: F.array_distinct(F.filter(F.split(F.regexp_replace(text(x), r"\s+", ""), ""), lambda c: c != ""))
    x, y = chars(a), chars(b)
    return F.when(F.size(y) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(y), F.lit(1)))


def sections(x: Column | str) -> Column:
    """Markdown cut at second-level headings: array of (heading, body, char_offset).

    Text before the first heading is a section without one; deeper headings
    stay in the body; without headings the whole text is one section.
    """
    body = text(x)
    # each piece begins at a heading, but for the first
    pieces = F.split(body, r"(?m)(?=^##[^\S\n]+\S)")
    placed = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), (F.coalesce(F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, q: a + F.length(q)), F.lit(0))).alias("at")))
    trimmed = lambda s: F.regexp_replace(s, r"^\n+|\n+$", "")
    headed = lambda p: p.rlike(r"^##[^\S\n]+\S")
    cut = F.transform(
        placed,
        lambda e: F.struct(
            F.when(headed(e["p"]), F.trim(F.regexp_extract(e["p"], r"^[^\n]*", 0))).otherwise(F.lit("")).alias("heading"),
            F.when(headed(e["p"]), trimmed(F.regexp_replace(e["p"], r"^[^\n]*", ""))).otherwise(F.when(F.size(pieces) > 1, F.regexp_replace(e["p"], r"\n+$", "")).otherwise(e["p"])).alias("body"),
            e["at"].alias("char_offset"),
        ),
    )
    return F.when(F.size(pieces) <= 1, cut).otherwise(F.filter(cut, lambda s: (s["heading"] != "") | (s["body"] != "")))


def section_score(heading: Column, body: Column, query_tokens: Column, clip: int = 5) -> Column:
    """Two for each hit in the heading, one in the body, at most ``clip`` hits of a token each."""
    h, b = tokens(heading), tokens(body)
    count = lambda words, t: F.least(F.size(F.filter(words, lambda w: w == t)), F.lit(clip))
    return F.aggregate(query_tokens, F.lit(0), lambda acc, t: acc + 2 * count(h, t) + count(b, t))
