"""License scans: sparse TF-IDF cosine to templates, and inheritance along paths.

DataFrame functions only. A unit is a line of a file, a block of lines between
blank ones (comment marks alone count as blank), or the whole text. Templates
are whole licences, titles, the usual headers and notices. Units and templates
are bags of terms; a term weighs its count times ln((1 + N) / (1 + df)) + 1, df
counted over all files. A unit that lacks every one of a template's heaviest
terms cannot reach the threshold (the rest of the template's mass bounds the
cosine), so one regular expression over the text decides which files are looked
at closely, without changing any result. The vectors stay sparse: terms join the
templates' terms.

A file without a licence of its own takes that of the nearest directory above
it that has a licence file. Directories, not files, look for their ancestors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS, VERSIONS
from .storage import written

TEMPLATES = TEXTS
#: A claim of all rights stands in many licences; it counts where nothing else is found.
WEAK = ["Proprietary"]
#: Base names (without extension, lower case) of licence files.
LICENSE_FILES = ["license", "licence", "copying", "copyright", "notice", "unlicense"]

_TERM = r"[a-z0-9]+(?:\\.[0-9]+)*"
#: Blocks of two lines or more.
BLOCKS = r"filter(split(regexp_replace(text, '\\r\\n?', '\n'), '\n(?:[ \\t#*/;%-]*\n)+'), b -> contains(trim('\n' from b), '\n'))"
#: Terms that may name a version.
NUMBER = r"^[1-9](\.[0-9])?$"
SALTS = 16
#: A term with more than this part (1 in FREQUENT) of the units' rows counts as frequent.
FREQUENT = 5000


def terms_of(text: str) -> Column:
    return F.expr(f"regexp_extract_all(lower({text}), '{_TERM}', 0)")


def _terms(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())


def flat(templates: dict[str, str | Sequence[str]]) -> list[tuple[str, str]]:
    """(licence, text) of each template, in order."""
    return [(name, x) for name, texts in sorted(templates.items()) for x in ([texts] if isinstance(texts, str) else texts)]


def signals(texts: list[str], idf: dict[str, float], threshold: float) -> list[str]:
    """Terms of which any unit that reaches the threshold has one at least."""
    out: set[str] = set()
    for text in texts:
        bag: dict[str, int] = {}
        for t in _terms(text):
            bag[t] = bag.get(t, 0) + 1
        mass = {t: (n * idf[t]) ** 2 for t, n in bag.items()}
        left, total = sum(mass.values()), sum(mass.values())
        for t in sorted(mass, key=lambda t: (-idf[t], t)):
            if left < threshold**2 * total * (1 - 1e-9):
                break
            out.add(t)
            left -= mass[t]
    return sorted(out)


def one_of(words: list[str]) -> str:
    """A regular expression for any of the words, branching by their letters: trying hundreds of words at each place is slow."""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[:1], []).append(w[1:])
    end = tails.pop("", None)
    branches = [re.escape(c) + (one_of(rest) if any(rest) else "") for c, rest in sorted(tails.items())]
    return f"(?:{'|'.join(branches)}){'?' if end else ''}"


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = 0.6, templates: dict[str, str | Sequence[str]] | None = None) -> DataFrame:
    """One row per file: doc (struct of all input columns, whatever their
    names), license, score, origin.

    ``origin`` is "own", "inherited" or null; ``license`` and ``score`` are the
    best unit's (ties to the identifier first in order; those in ``WEAK`` only if
    nothing else reaches the threshold) or the inherited ones. A unit that names
    versions, but not the licence's own, is not that licence, however similar.
    Licence files are told by name, or by a whole text that reaches the
    threshold; a directory with several takes the best (ties: smaller
    path). A null path is a file in no directory; null and empty texts have no
    licence of their own. Rows of equal path are separate files. An empty table
    gives no rows.
    """
    spark = files.sparkSession
    texts = flat(TEMPLATES if templates is None else templates)
    path, text = F.col(path_col).cast("string"), F.col(text_col).cast("string")
    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in files.columns if c != text_col]).alias("doc"), path.alias("path"), text.alias("text"))

    # document frequencies of every term, over all files; the empty term counts the files
    bag = F.coalesce(F.array_distinct(terms_of("text")), F.expr("cast(array() as array<string>)"))
    counted = written(rows.select(F.explode(F.concat(F.array(F.lit("")), bag)).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "term-files")
    vocabulary = sorted({t for _, x in texts for t in _terms(x)})
    df = {r["term"]: r["df"] for r in counted.filter(F.col("term").isin(["", *vocabulary])).collect()}
    n_files = df.pop("", 0)
    idf = {t: math.log((1 + n_files) / (1 + df.get(t, 0))) + 1 for t in vocabulary}

    weights = []
    for i, (name, x) in enumerate(texts):
        own = _terms(x)
        norm = math.sqrt(sum((own.count(t) * idf[t]) ** 2 for t in set(own)))
        weights += [(t, idf[t], name, i, own.count(t) * idf[t] / norm) for t in sorted(set(own))]
    held = F.broadcast(spark.createDataFrame(weights, "term string, idf double, license string, template int, weight double"))  # fixed size
    versions = F.create_map(*[x for name, vs in VERSIONS.items() for x in (F.lit(name), F.array(*map(F.lit, vs)))])

    # units of the files that have a signal; identical rows add up, which no cosine sees
    regex = f"(?<![a-z0-9]){one_of(signals([x for _, x in texts], idf, threshold))}(?![a-z0-9])"
    hot = rows.filter(F.coalesce(text_matches("text", regex), F.lit(False))).select("path", F.xxhash64("text").alias("hash"), "text")
    base = F.expr("lower(regexp_replace(regexp_extract(path, '[^/]*$', 0), '\\\\.[^.]*$', ''))")
    named = F.coalesce(base.isin(LICENSE_FILES), F.lit(False))
    lines = F.expr("filter(split(text, '\\\\r\\\\n?|\\\\n'), l -> trim(l) <> '')")
    units = hot.select("path", "hash", F.posexplode(F.concat(F.array("text"), lines, F.expr(BLOCKS))).alias("pos", "unit")).filter(text_matches("unit", regex))
    units = units.select("path", "hash", "pos", F.explode(terms_of("unit")).alias("term")).groupBy("path", "hash", "pos", "term").agg(F.count("*").alias("n"))
    units = written(units, "license-units")
    # each term's weight: those with many rows are fewer than FREQUENT and are broadcast, the others meet by a shuffle
    used = units.groupBy("term").agg(F.count("*").alias("rows")).join(counted, "term")
    used = written(used.select("term", "rows", (F.log((1.0 + n_files) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "term-weights")
    many = F.col("rows") * FREQUENT > (used.agg(F.sum("rows")).first()[0] or 0)
    weighed = units.join(F.broadcast(used.filter(many).select("term", "idf")), "term", "left")
    rest = weighed.filter("idf is null").drop("idf").join(used.filter(~many).select("term", "idf"), "term")
    weighed = weighed.filter("idf is not null").unionByName(rest)
    norms = weighed.groupBy("path", "hash", "pos").agg(F.sqrt(F.sum(F.pow(F.col("n") * F.col("idf"), F.lit(2.0)))).alias("norm"), F.collect_set(F.when(F.col("term").rlike(NUMBER), F.col("term"))).alias("numbers"))  # at most 99 of a unit
    dots = units.join(held, "term").groupBy("path", "hash", "pos", "license", "template").agg(F.sum(F.col("n") * F.col("idf") * F.col("weight")).alias("dot"))
    same = lambda a, b: (F.col(f"{a}.hash") == F.col(f"{b}.hash")) & F.col(f"{a}.path").eqNullSafe(F.col(f"{b}.path"))
    scored = dots.alias("d").join(norms.alias("n"), same("d", "n") & (F.col("d.pos") == F.col("n.pos"))).select("d.path", "d.hash", "d.pos", "license", "numbers", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).filter(F.col("score") >= threshold)
    scored = scored.filter((F.size("numbers") == 0) | F.coalesce(F.arrays_overlap("numbers", F.try_element_at(versions, F.col("license"))), F.lit(True))).drop("numbers")
    # the whole text stands at 0: it tells licence files, and counts for these
    best = scored.groupBy("path", "hash").agg(F.min(F.struct(F.col("license").isin(WEAK).alias("w"), (-F.col("score")).alias("s"), "license")).alias("b"), F.max(F.col("pos") == 0).alias("is_text"))
    best = best.select("path", "hash", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "is_text")
    best = written(best, "own-licenses")

    directory = F.expr("regexp_extract(path, '^(.*)/[^/]*$', 1)")
    declared = best.filter(F.col("path").isNotNull() & (named | F.col("is_text"))).withColumn("dir", directory)
    declared = declared.groupBy("dir").agg(F.min(F.struct(F.col("license").isin(WEAK).alias("w"), (-F.col("score")).alias("s"), "path", "license")).alias("b")).select("dir", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))
    dirs = rows.filter("path is not null").select(directory.alias("home")).distinct()
    above = F.expr("transform(sequence(0, size(split(home, '/'))), k -> array_join(slice(split(home, '/'), 1, k), '/'))")
    nearest = dirs.select("home", F.explode(F.array_distinct(above)).alias("dir")).join(declared, "dir").groupBy("home").agg(F.max(F.struct(F.length("dir").alias("depth"), "license", "score")).alias("b"))
    nearest = nearest.select("home", F.col("b.license").alias("dir_license"), F.col("b.score").alias("dir_score"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    keyed = rows.select("doc", "path", F.xxhash64("text").alias("hash"))
    out = keyed.alias("k").join(best.alias("b"), same("k", "b"), "left").select("doc", "k.path", "license", "score", F.pmod(F.col("k.hash"), F.lit(SALTS)).cast("int").alias("salt"))
    # a directory may hold a third of all files: salted
    out = out.withColumn("home", directory).join(nearest, ["home", "salt"], "left")
    return out.select("doc", F.coalesce("license", "dir_license").alias("license"), F.coalesce("score", "dir_score").alias("score"), F.when(F.col("license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").alias("origin"))


def text_matches(column: str, regex: str) -> Column:
    return F.lower(F.col(column)).rlike(regex)


def paths_of(docs: DataFrame, path_col: str = "path") -> DataFrame:
    """Documents as files: a source is a repository, a language a directory of it. A column called ``path_col`` would be lost, so it is an error."""
    if path_col in docs.columns:
        raise ValueError(f"{path_col} is a column already; name another")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return docs.withColumn(path_col, F.concat_ws("/", part("source"), part("lang"), F.concat(part("doc_id"), F.lit(".txt"))))
