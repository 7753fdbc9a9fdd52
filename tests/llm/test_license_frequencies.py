import math
import re
from collections import Counter

from mnemoframe.llm import licenses as lic

NOTICE = "This file is released under the MIT License."
LONG = "This project is licensed under the MIT License - see the LICENSE file for details."


def terms(text):
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())


def cosine(unit, template, files):
    """With the frequencies of every term, counted over all files."""
    df = Counter(t for _, x in files for t in set(terms(x or "")))
    vector = lambda x: {t: n * (math.log((1 + len(files)) / (1 + df[t])) + 1) for t, n in Counter(terms(x)).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    a, b = vector(unit), vector(template)
    return round(sum(w * b.get(t, 0) for t, w in a.items()) / norm(a) / norm(b), 9)


def corpus(n):
    # words in and outside the templates that every file has
    files = [(f"src/{i}.py", f"see this file, the project is released under license x{i}\nfor details") for i in range(n)]
    return [*files, ("a/1.py", NOTICE + "\ncode"), ("b/2.py", LONG), (None, None), ("c/3.py", "")]


def test_frequencies_of_all_terms(spark, monkeypatch):
    for n, frequent in ((300, 5000), (300, 0), (3000, 20)):  # all weights broadcast, none, some
        monkeypatch.setattr(lic, "FREQUENT", frequent, raising=False)
        files = corpus(n)
        found = {r.doc.path: (r.license, r.score, r.origin) for r in lic.scan(spark.createDataFrame(files, "path string, text string"), threshold=0.3).collect()}
        assert len(found) == len(files)
        for path, unit in (("a/1.py", NOTICE), ("b/2.py", LONG)):
            best = max((cosine(unit, x, files), name) for name, x in lic.flat(lic.TEMPLATES) if name not in lic.WEAK)
            assert found[path] == (best[1], best[0], "own") and best[1] == "MIT"


def test_a_notice_among_common_words_is_found_at_any_size(spark):
    for n in (300, 3000):
        found = {r.doc.path: r.license for r in lic.scan(spark.createDataFrame(corpus(n), "path string, text string")).collect()}
        assert (found["a/1.py"], found["b/2.py"]) == ("MIT", "MIT")
