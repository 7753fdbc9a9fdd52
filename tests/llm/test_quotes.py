import random
import re

from mnemoframe.llm import quotes

LOW = -(1 << 62)
ATTRIBUTION = re.compile(r"^(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\bécrit|el\b.*\bescribió)\s*:$", re.I)


def parse(text):
    lines = []
    for raw in re.split(r"\r\n?|\n", text):
        m = re.match(r"[ \t]*(>[> \t]*)", raw)
        lines.append([m[1].count(">") if m else 0, raw[m.end() :] if m else raw, False])
    for a, b in zip(lines, lines[1:]):
        a[2] = a[0] == 0 and b[0] > 0 and bool(ATTRIBUTION.match(a[1].strip(" ")))
    return lines


def norm(s):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", s.lower()).strip(" ")


def brute(rows):
    talks = {}
    for c, t, x in rows:
        talks.setdefault(c, []).append((LOW if t is None else t, x))
    out = []
    for c, said in talks.items():
        own = {}
        for t, x in said:
            for level, body, attribution in parse(x or ""):
                if level == 0 and not attribution and norm(body):
                    own.setdefault(norm(body), set()).add(t)
        parent_of, rows_of = {}, []
        for t, x in said:
            lines, passages, last = parse(x or ""), [], None
            for level, body, _ in lines:
                if level != last:
                    passages.append((level, []))
                last = level
                passages[-1][1].append(norm(body))
            n_quoted = n_found = 0
            best = None
            for level, body in passages:
                votes = {}
                for b in body if level else ():
                    if b:
                        n_quoted += 1
                        earlier = [o for o in own.get(b, ()) if o < t]
                        if earlier:
                            n_found += 1
                            votes[max(earlier)] = votes.get(max(earlier), 0) + 1
                if votes:
                    top = max((n, o) for o, n in votes.items())
                    best = max(best or (-99,), (-level, *top))
            parent = best[2] if best else None
            if parent is not None:
                parent_of[t] = max(parent_of.get(t, LOW), parent)
            has = any(level for level, _, _ in lines)
            body = "\n".join(b for level, b, a in lines if not level and not a).strip() if has else x
            rows_of.append((t, x, body, parent, n_quoted, n_found))
        turns = sorted({t for t, _ in said})
        parent_of = {t: p for t, p in parent_of.items() if p != max(u for u in turns if u < t)}

        def run_of(t):
            starts = [s for s in parent_of if s <= t]
            return max(starts) if starts else None

        def path(run):
            return () if run is None else path(run_of(parent_of[run])) + (-parent_of[run], run)

        for t, x, body, parent, nq, nf in rows_of:
            before = [u for u in turns if u < t]
            reply = parent if parent is not None else (max(before) if before else None)
            out.append((c, None if t == LOW else t, body, None if reply in (None, LOW) else reply, parent is not None, nq, nf, path(run_of(t))))
    return sorted(out, key=repr)


def result(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "1 as key", "2 as at", "3 as hash", "4 as body")
    return sorted(((r.doc.conv_id, r.doc.turn, r.body, r.reply_to, r.linked, r.n_quoted, r.n_found, tuple(r.thread)) for r in quotes.link_quotes(df).collect()), key=repr)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 4)
    rng = random.Random(3)
    rows = []
    for c in [*range(12), None]:
        said = []
        for t in range(rng.randint(1, 22)):
            lines = []
            if said and rng.random() < 0.5:
                if rng.random() < 0.5:
                    lines.append("On Monday, A wrote:")
                for line in rng.choice(said).split("\n"):
                    if rng.random() < 0.8:
                        lines.append(rng.choice(["> ", ">", " > "]) + line.upper())
            lines += [rng.choice(["yes", "no", f"line {t}", "  ", "same for all", f"own {rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 3))]
            said.append("\n".join(lines))
            rows.append((c, t * rng.choice([1, 1, 1, 2]), said[-1]))
    rows += [(3, 2, "> yes\nagain"), (3, 2, "> yes\nagain"), (40, 1, None), (40, None, ""), (41, 0, ">\n> "), (42, 5, "> never said\r\n\r\nhello\r\n")]
    assert result(spark, rows) == brute(rows)


def test_reply_order(spark):
    rows = [(1, 0, "root"), (1, 1, "next to root"), (1, 2, "> root\nto the root"), (1, 3, "more of it"), (1, 4, "> next to root\nlate"), (1, 5, "> > root\n> to the root\nnested")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    found = quotes.link_quotes(df)
    assert {r.doc.turn: (r.body, r.reply_to) for r in found.collect()} == {0: ("root", None), 1: ("next to root", 0), 2: ("to the root", 0), 3: ("more of it", 2), 4: ("late", 1), 5: ("nested", 2)}
    assert [r.turn for r in found.orderBy("thread", "doc.turn").select("doc.turn").collect()] == [0, 1, 4, 2, 3, 5]


def test_chain_of_quotes_needs_no_paths(spark):
    rows = [(1, t, f"> said at {t - 1}\nsaid at {t}" if t else "said at 0") for t in range(300)]
    found = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert all(r.thread == [] and r.linked == (r.doc.turn > 0) and r.reply_to == (r.doc.turn - 1 if r.doc.turn else None) for r in found)


def test_whole_table_and_native_plan(spark):
    talks = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    found = quotes.link_quotes(talks)
    assert [n for n in ("Python", "Arrow", "Cartesian") if n in found._jdf.queryExecution().executedPlan().toString()] == []
    rows = found.collect()
    assert len(rows) == talks.count() and all(r.body == r.doc.text and not r.linked for r in rows)
    assert quotes.link_quotes(talks.limit(0)).count() == 0
