import math
import random
import re
import textwrap
from collections import Counter
from pathlib import Path

import pytest

from mnemoframe.llm import licenses as lic


def terms(t):
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower())


def brute(files, threshold=0.6):
    df = Counter(t for _, x in files for t in set(terms(x or "")))
    idf = lambda t: math.log((1 + len(files)) / (1 + df[t])) + 1
    vector = lambda x: {t: n * idf(t) for t, n in Counter(terms(x)).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    templates = [(n, t, norm(t)) for n, t in ((n, vector(x)) for n, x in lic.flat(lic.TEMPLATES))]

    def scores(x):
        v = vector(x)
        length, numbers = norm(v), {t for t in v if re.fullmatch(r"[1-9](\.[0-9])?", t)}
        for n, t, size in templates:
            if v and (not numbers or n not in lic.VERSIONS or numbers & set(lic.VERSIONS[n])):
                yield n in lic.WEAK, -round(sum(w * t.get(k, 0) for k, w in v.items()) / length / size, 9), n

    own, declared = [], {}
    for p, x in files:
        x = x or ""
        blocks = [u for u in re.split(r"\n(?:[ \t#*/;%-]*\n)+", re.sub(r"\r\n?", "\n", x)) if "\n" in u.strip("\n")]
        units = [x, *[u for u in re.split(r"\r\n?|\n", x) if u.strip(" ")], *blocks]
        best = min((s for u in units for s in scores(u) if -s[1] >= threshold), default=None)
        whole = any(-s >= threshold for _, s, _ in scores(x))
        own.append(best)
        name = (p or "").rsplit("/", 1)[-1]
        if best and p is not None and (whole or re.sub(r"\.[^.]*$", "", name).lower() in lic.LICENSE_FILES):
            d = p.rsplit("/", 1)[0] if "/" in p else ""
            declared[d] = min(declared.get(d, (9,)), (best[0], best[1], p, best[2]))
    out = []
    for (p, x), best in zip(files, own):
        if best:
            out.append((p, best[2], -best[1], "own"))
            continue
        d, found = (p.rsplit("/", 1)[0] if "/" in p else "") if p is not None else None, None
        while d is not None and not (found := declared.get(d)):
            d = d.rsplit("/", 1)[0] if "/" in d else ("" if d else None)
        out.append((p, found[3], -found[1], "inherited") if found else (p, None, None, None))
    return sorted(out, key=repr)


def rows_of(df, path="path"):
    return sorted(((r.doc[path], r.license, None if r.score is None else round(r.score, 9), r.origin) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(6)
    notices = [x.strip().split("\n")[0] for _, x in lic.flat(lic.TEMPLATES)] + [x for _, x in lic.flat(lic.TEMPLATES)]
    words = "the of and version public work under mit license licensed alpha beta gamma delta 2.0 rights".split()
    files = []
    for i in range(150):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), "".join(rng.choice(["", "// ", "# "]) + x + "\n" for x in rng.choice(notices).upper().split("\n")) + rng.choice(["", ".", " by us"]))
        folder = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
        name = rng.choice(["LICENSE", "COPYING.txt"]) if rng.random() < 0.15 else f"f{i}.py"
        files.append((f"{folder}/{name}" if folder else name, rng.choice(["\n", "\r\n"]).join(lines)))
    files += [(None, notices[0]), (None, None), ("a/empty", ""), files[0], ("x/y/z", "nothing here"), ("x/LICENSE", "Released under the MIT License"), ("a/b/long.txt", "word " * 50_000 + "\nAll rights reserved.")]
    df = spark.createDataFrame(files, "path string, text string").selectExpr("*", "1 as doc", "2 as hash", "3 as license", "4 as score")
    got = rows_of(lic.scan(df))
    assert got == brute(files)
    assert {o for *_, o in got} == {"own", "inherited", None}
    assert lic.scan(df.limit(0)).count() == 0


def test_documents(spark):
    docs = lic.paths_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = lic.scan(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in ("Python", "ArrowEval", "Cartesian", "NestedLoop") if n in plan]
    rows = [(r.path, r.text) for r in docs.collect()]
    assert rows_of(found) == brute(rows)
    planted = {p for p, t in rows if re.search(r"(?m)^(Released under the MIT License|Licensed under|This work is licensed|All rights reserved)", t)}
    assert planted and planted <= {p for p, _, _, o in rows_of(found) if o == "own"}


#: The licences' own files on Debian systems.
FOLDER = Path("/usr/share/common-licenses")
HEADER = """/*
 * Copyright 2020 A. Writer
 *
 * {}
 */
#include <stdio.h>
int main(void) {{ return 0; }}
"""


def commented(text, width=70):
    return HEADER.format("\n * ".join(y for x in text.strip().split("\n\n") for y in [*textwrap.wrap(" ".join(x.split()), width), ""]))


def test_real_licences_and_headers(spark):
    """Whole licence files, and headers wrapped anew in comments, among prose that uses their common words."""
    files, want = [], {}
    for spdx, name in (("Apache-2.0", "Apache-2.0"), ("BSD-3-Clause", "BSD"), ("CC0-1.0", "CC0-1.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0")):
        if (FOLDER / name).exists():
            files.append((f"{spdx}/LICENSE", (FOLDER / name).read_text()))
            want |= {f"{spdx}/LICENSE": (spdx, "own"), f"{spdx}/src/main.c": (spdx, "inherited")}
            files.append((f"{spdx}/src/main.c", "int main(void) { return 0; }"))
    whole = {"MIT": 1, "BSD-2-Clause": 1, "BSD-3-Clause": 1, "ISC": 1, "Unlicense": 1}
    for spdx, i in whole.items():
        files.append((f"own/{spdx}/COPYING", f"Copyright (c) 1999, 2021 Some People\nAll rights reserved.\n\n{lic.TEMPLATES[spdx][i]}"))
        want[f"own/{spdx}/COPYING"] = (spdx, "own")
    headers = {"Apache-2.0": 2, "GPL-2.0": 2, "GPL-3.0": 3, "LGPL-3.0": 2, "MPL-2.0": 2, "MIT": 1, "BSD-2-Clause": 1}
    for spdx, i in headers.items():
        files.append((f"headers/{spdx}.c", commented(lic.TEMPLATES[spdx][i])))
        want[f"headers/{spdx}.c"] = (spdx, "own")
    for spdx in ("MIT", "Apache-2.0", "BSD-3-Clause", "GPL-3.0"):
        files.append((f"spdx/{spdx}.py", f"# SPDX-License-Identifier: {spdx}\nimport os\n"))
        want[f"spdx/{spdx}.py"] = (spdx, "own")
    rng = random.Random(3)
    words = "the of and or to a in software public work under version any this copy use free program file terms may not is with for".split()
    prose = [(f"prose/{i}.txt", "\n".join(" ".join(rng.choice(words + [f"w{rng.randrange(400)}"] * 9) for _ in range(12)) for _ in range(6))) for i in range(200)]
    want |= {p: (None, None) for p, _ in prose}
    got = {r.doc.path: (r.license, r.origin) for r in lic.scan(spark.createDataFrame(files + prose, "path string, text string")).collect()}
    assert {p: got[p] for p in want if got[p] != want[p]} == {}


def test_versions_decide(spark):
    said = {
        "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."],
        "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"], "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"], "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"],
        "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"], "EPL-2.0": ["Eclipse Public License - v 2.0"], "Zlib": ["Released under the zlib License"], "Artistic-2.0": ["The Artistic License 2.0"],
        None: ["GNU GENERAL PUBLIC LICENSE\nVersion 1, February 1989", "Mozilla Public License Version 1.1", "Licensed under the Apache License, Version 1.1", "Eclipse Public License - v 1.0", "plain words"],
    }
    rows = [(f"{name}/{i}", x) for name, xs in said.items() for i, x in enumerate(xs)] + [(f"other/{i}", f"some common words {i} of the version of the public license software general") for i in range(6)]
    got = {r.doc.path: r.license for r in lic.scan(spark.createDataFrame(rows, "path string, text string")).collect() if not r.doc.path.startswith("other")}
    # a directory with a licence text hands it down; here each stands alone
    assert {p: n for p, n in got.items() if not p.startswith("None")} == {f"{name}/{i}": name for name, xs in said.items() if name for i in range(len(xs))}
    assert {n for p, n in got.items() if p.startswith("None")} == {None}


def test_paths_keep_a_column_of_that_name(spark):
    docs = spark.createDataFrame([(1, "x", "en", "s", "mine")], "doc_id long, text string, lang string, source string, path string")
    assert lic.paths_of(docs, "file").first().asDict() == {"doc_id": 1, "text": "x", "lang": "en", "source": "s", "path": "mine", "file": "s/en/1.txt"}
    with pytest.raises(ValueError):
        lic.paths_of(docs)
