import random
import textwrap

from mnemoframe.llm import quotes


def linked(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    return {(r.doc.conv_id, r.doc.turn): (r.reply_to, r.linked, r.n_quoted, r.n_found) for r in quotes.link_quotes(df).collect()}


def quoted(text, width):
    return "\n".join("> " + line for line in textwrap.wrap(text, width))


def test_wrapped_anew_and_partial(spark):
    long = "The gateway listens on port 8080, and whoever wants to reach the inner service must pass through it; nobody has changed this since the spring, as far as we know."
    rows = [
        (1, 0, long),
        (1, 1, "A second message.\nIt has nothing to do with it."),
        (1, 2, quoted(long, 40) + "\nThanks."),
        (1, 3, "> whoever wants to reach\n> the inner service must pass through it\nWhy?"),
        (1, 4, "> a second\nFirst?"),
        (1, 5, "> whoever wants to reach the moon\nNobody said so."),
        (1, 6, "> 今日は良い\nはい"),
        (2, 0, "今日は良い天気です"),
        (2, 1, "…"),
        (2, 2, "> 今日は良い\n> 天気\nはい"),
    ]
    found = linked(spark, rows)
    assert found[1, 2] == (0, True, len(textwrap.wrap(long, 40)), len(textwrap.wrap(long, 40)))
    assert found[1, 3] == (0, True, 2, 2)
    assert found[1, 4] == (1, True, 1, 1)
    assert found[1, 5] == (4, False, 1, 0)
    assert found[1, 6] == (5, False, 1, 0)
    assert found[2, 2] == (0, True, 2, 2)


def test_spans_of_random_texts(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 4)
    rng = random.Random(8)
    rows, expected = [], {}
    for c in range(8):
        said = []
        for t in range(12):
            own = [f"w{c}x{t}y{i}" for i in range(rng.randint(6, 60))]
            lines = [textwrap.fill(" ".join(own), rng.choice([30, 72, 1000]))]
            if said and rng.random() < 0.6:
                k = rng.randrange(len(said))
                a = rng.randrange(len(said[k]))
                lines.insert(0, quoted(" ".join(said[k][a : a + rng.randint(1, 30)]).upper(), rng.choice([20, 40, 72])))
                n = lines[0].count("\n") + 1
                expected[c, t] = (k, True, n, n)
            else:
                expected[c, t] = (t - 1 if t else None, False, 0, 0)
            said.append(own)
            rows.append((c, t, "\n".join(lines)))
    assert linked(spark, rows) == expected
