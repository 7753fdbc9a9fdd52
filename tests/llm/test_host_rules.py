import random
import re

import pytest

from mnemoframe.llm import host_rules

KIND = "doc_id long, text string, source string, host string, doc int, key string"


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [l for l in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]  # noqa: E741
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(lines)


def rules(m):
    words, chars, symbols, dup, repeated, lines = m
    return {"base": words < 50 or 100 * repeated > 50 * words, "symbols": 10 * symbols > words, "lines": 10 * dup > 3 * lines, "word_length": chars < 2 * words or chars > 12 * words}


def bad_hosts(rows):
    hosts = {}
    for _, text, source in rows:
        if source is not None:
            hosts.setdefault(source, []).append(rules(measured(text)))
    bad, total = set(), sum(map(len, hosts.values()))
    for rule in host_rules.RULES:
        counts = {h: (sum(f[rule] for f in fs), len(fs)) for h, fs in hosts.items()}
        if not total:
            continue
        mean = sum(f for f, _ in counts.values()) / total
        spread = sum(n * (f / n - mean) ** 2 for f, n in counts.values())
        between = total - sum(n * n for _, n in counts.values()) / total
        excess = spread - (len(counts) - 1) * mean * (1 - mean)
        weight = mean * (1 - mean) * between / excess - 1 if between > 1e-9 and excess > 1e-9 else 1e6
        weight = min(max(weight, 2.0), 1e6)
        bad |= {h for h, (f, n) in counts.items() if round((f + mean * weight) / (n + weight), 9) > 0.5}
    return bad


def result(spark, rows, **more):
    df = spark.createDataFrame([(*r, "h", 1, "k") for r in rows], KIND)
    return sorted(((r.doc.doc_id, r.doc.source, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines, r.base_failed, r.kept) for r in host_rules.judge(df, **more).collect()), key=repr)


def brute(rows):
    bad = bad_hosts(rows)
    out = []
    for i, text, source in rows:
        m = measured(text)
        out.append((i, source, *m, rules(m)["base"], not rules(m)["base"] and source not in bad))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, prose(rng.randint(40, 90)), "good.example") for i in range(60)]
    rows += [(100 + i, prose(60) + " # $" * 40 if i % 10 else prose(60), "junk.example") for i in range(40)]
    rows += [(200, "x # " * 60, "small.example"), (201, prose(70), "small.example")]
    rows += [(300 + i, prose(80), f"host{i % 15}") for i in range(90)]
    line = prose(5)
    rows += [(500, "\n".join([line] * 9 + [prose(40)] * 2), "lines"), (501, None, "lines"), (502, "", None), (503, " \n\t\n", None), (504, "a b", "lines"), (505, "a b c", "lines"), (506, "a a a a a", "lines")]
    rows += [(600, "é ü # x " * 30, None), (601, prose(30) + "\n \n" + prose(30) + "\r\n\x0b", "lines"), (602, ("one two three four " * 20).strip(), "lines"), (602, ("one two three four " * 20).strip(), "lines"), (None, prose(55), "lines"), (603, "😀 a b " * 40, "lines")]
    long_ = prose(3000)
    rows += [(700, long_ + " " + prose(10) + " " + long_[:9000], "long"), (701, "w " * 5000, "long")]
    return rows


@pytest.mark.parametrize("keep_text", [True, False])
def test_same_as_one_by_one(spark, keep_text):
    rows = corpus()
    got = result(spark, rows, keep_text=keep_text)
    assert got == brute(rows)
    kept = {r[0] for r in got if r[-1]}
    # clean documents stay with all but the host whose documents mostly fail
    assert not kept & {100 + i for i in range(40)} and kept >= {300 + i for i in range(90)} and 201 in kept


def test_many_hosts_take_the_other_join(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", 3)
    monkeypatch.setattr(host_rules, "HOT_SHARE", 8)
    assert result(spark, rows) == brute(rows)


def test_empty_and_hostless(spark):
    assert result(spark, []) == []
    rows = [(1, "a b c", None), (2, None, None)]
    assert result(spark, rows) == brute(rows)


def test_windows_whose_hashes_clash_are_told_apart(spark, monkeypatch):
    # all windows hash alike: the words decide
    text = "one two three four one two three five six seven"
    expr = host_rules.measures("text")
    plain = spark.createDataFrame([(text,)], "text string").select(expr.alias("m")).first().m
    real = host_rules.F.expr
    monkeypatch.setattr(host_rules.F, "expr", lambda s: real(s.replace("xxhash64(element_at(w, i), element_at(w, i + 1), element_at(w, i + 2))", "7L")))
    clash = spark.createDataFrame([(text,)], "text string").select(host_rules.measures("text").alias("m")).first().m
    assert plain == clash and plain.w.n_repeat_words == 6


def test_kept_documents_have_their_columns(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "h", 1, "k") for r in rows], KIND)
    kept = host_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(r[-1] for r in brute(rows))
