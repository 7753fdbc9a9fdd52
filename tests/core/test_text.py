from pyspark.sql import functions as F

from mnemoframe.functions import measures as M
from mnemoframe.functions import text as T


def one(spark, **columns):
    r = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return r.asDict() if len(columns) > 1 else r[0]


def test_tokens(spark):
    assert one(spark, a=T.tokens(F.lit("Hello_1 World 北京大学 中"))) == ["hello_1", "world", "北京", "京大", "大学", "中"]
    assert one(spark, a=T.informative_tokens(F.lit("a 7 12 中 北京"))) == ["a", "12", "北京"]
    assert one(spark, a=T.gram_tokens(F.lit("Ab c"))) == ["ab", "c", "bc"]
    assert one(spark, a=T.gram_tokens(F.lit("x")), b=T.gram_tokens(F.lit(None).cast("string"))) == {"a": ["x"], "b": []}
    assert one(spark, a=T.short_tokens(F.lit("一二三四五 ab"))) == ["一二三四", "五", "ab"]


def test_literals(spark):
    task = "check https://a.b/c?d=1 and ~/x/y.py with API_KEY at host:8080, v1.2.3 takes 30ms, see `some thing` in mod.sub.fn 2024"
    found = one(spark, a=T.literal_anchors(F.lit(task)))
    assert {"https://a.b/c?d=1", "~/x/y.py", "API_KEY", "v1.2.3", "30ms", "some thing", "8080", "2024"} <= set(found)
    assert found.index("https://a.b/c?d=1") < found.index("API_KEY") and len(found) == len(set(found))


def test_matching(spark):
    terms = F.array(F.lit("Foo"), F.lit("bar"), F.lit("FOO"), F.lit("zzz"), F.lit(" "))
    assert one(spark, a=T.matched_terms(F.lit("a foo here"), terms)) == ["Foo"]
    # digits at the ends stay, wherever the term stands in the list
    assert one(spark, a=T.matched_terms(F.lit("at 0808 and 110"), F.array(F.lit(" 0808"), F.lit("110")), loose=True)) == ["0808", "110"]
    assert one(spark, a=T.literal_hits(F.array(F.lit("A")), F.array(F.lit("a"), F.lit("b")))) == 1


def test_overlap(spark):
    got = one(spark, same=T.overlap(F.lit("A, b"), F.lit("a b")), within=T.overlap(F.lit("abcd"), F.lit("ab")), part=T.overlap(F.lit("a b c"), F.lit("b c d")), none=T.overlap(F.lit(""), F.lit("x")))
    assert got == {"same": 1.0, "within": 0.5, "part": 0.5, "none": 0.0}


def test_lines(spark):
    assert one(spark, a=T.trim_line(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, a=T.join_clause(F.lit(" a，"), F.lit("b"), F.lit("a"))) == "a；b"
    assert one(spark, a=T.plain_markdown(F.lit("## T\n- x\n\n* y"))) == "T；x；y"
    assert one(spark, a=T.clean_fragment(F.lit(" 2024-01-02 10:11 hi |  there；"), 80)) == "hi | there"
    assert one(spark, a=T.clean_fragment(F.lit("abcdef"), 3)) == "abc..."
    assert one(spark, a=T.slug(F.lit("My  DB!"))) == "my-db"
    assert one(spark, a=T.entity_names(F.array(F.lit(" Ab "), F.lit("x"), F.lit("Ab"), F.lit("")))) == ["Ab"]


def test_contexts(spark):
    facts = F.create_map(F.lit("k"), F.lit("v"))
    assert one(spark, a=T.context_description(F.lit("c"), facts, F.lit("w"), F.lit("more"))) == "背景条件：c。实况：k：v。适用：w。more"
    assert one(spark, a=T.current_intent(F.lit("wants to go"), F.lit(""), F.lit(""))) is True
    assert one(spark, a=T.current_intent(F.lit("usually wants tea"), F.lit(""), F.lit(""))) is False
    got = one(spark, a=T.valid_draft(F.lit("ok"), F.lit("")), b=T.valid_draft(F.lit('{"x"}'), F.lit("")), c=T.valid_draft(F.lit("x" * 129), F.lit("")), d=T.evidence_matches(F.lit("A b"), F.lit("xa-bx")))
    assert got == {"a": True, "b": False, "c": False, "d": True}


def test_sections(spark):
    cut = lambda s: [(x.heading, x.body, x.char_offset) for x in one(spark, a=T.sections(F.lit(s)))]
    assert cut("no heading\nhere") == [("", "no heading\nhere", 0)]
    assert cut("pre\n\n## A\nx\n### deep\ny\n## B\n\nz\n") == [("", "pre", 0), ("## A", "x\n### deep\ny", 5), ("## B", "z", 23)]
    assert cut("## A\nx") == [("## A", "x", 0)]
    assert cut("") == [("", "", 0)]
    body = F.lit("cat " * 9)
    assert one(spark, a=T.section_score(F.lit("## cat"), body, F.array(F.lit("cat")))) == 7


def test_measures(spark):
    vec = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    got = one(spark, a=M.cosine(vec(1, 0), vec(1, 0, 5)), b=M.cosine(vec(1), vec(-1)), c=M.cosine(vec(0, 0), vec(1, 1)), d=M.cosine(F.lit(None).cast("array<double>"), vec(1)))
    assert got["a"] == 1.0 / 26**0.5 or abs(got["a"] - 1 / 26**0.5) < 1e-12
    assert got["b"] == got["c"] == got["d"] == 0.0
    times = one(spark, a=M.parse_time(F.lit("1970-01-02 00:00:00")), b=M.parse_time(F.lit("86400")), c=M.parse_time(F.lit("nope")), d=M.parse_time(F.lit("1970-01-02T00:00:00Z")), e=M.time_bucket(F.lit(86400 + 13 * 3600)))
    assert times == {"a": 86400, "b": 86400, "c": 0, "d": 86400, "e": "afternoon"}
    assert one(spark, a=M.guessed_bucket(F.lit("at 9 am"))) == "morning"
    assert one(spark, a=M.temporal_compatibility(*[F.lit(x) for x in (10, 20, 30, 40)])) == 0.35
    assert one(spark, a=M.time_range(F.lit("100"), None, F.lit("in the evening"))).asDict() == {"start": 100, "end": 100, "display_time_bucket": "evening"}
    assert one(spark, a=M.coerce_confidence(F.lit("1.7")), b=M.coerce_confidence(F.lit("x"))) == {"a": 1.0, "b": 0.0}
