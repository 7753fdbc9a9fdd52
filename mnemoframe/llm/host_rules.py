"""Quality rules judged by host, DataFrame functions only.

Documents are measured by themselves. How often the documents of a host fail a
rule is then shrunk towards what hosts do on the whole: a beta prior fitted to
the hosts' own rates. A host whose shrunk rate of some rule is over the limit
loses all its documents; one of few documents needs more than bad luck for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

_GAP = r"[\\x20\\x09-\\x0D]"
#: What a document can fail, over its measures; all in integers.
RULES = {
    "base": "n_words < 50 or 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
}
#: Hosts lose their documents over this shrunk rate.
LIMIT = 0.5
#: Shortest and longest memory of the prior, in documents.
PRIOR_DOCUMENTS = (2.0, 1_000_000.0)
#: Verdicts that are broadcast (some 60 bytes each); with more hosts, only those with a 10,000th of all documents are.
BROADCAST_HOSTS, HOT_SHARE = 100_000, 10_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measures(text: str) -> Column:
    """Struct of MEASURES of a text without nulls.

    Repeated windows: each window's hash and place are one long; sorted, equal
    hashes are neighbours. Only windows with such a neighbour are sorted again
    by their words, which decides, so the cost is that of sorting.
    """
    words = f"filter(split({text}, '{_GAP}+'), w -> w <> '')"
    hashed = "if(size(w) < 3, cast(array() as array<bigint>), sort_array(transform(sequence(1, size(w) - 2), i -> shiftleft(xxhash64(element_at(w, i), element_at(w, i + 1), element_at(w, i + 2)), 31) | cast(i as bigint))))"
    met = "filter(k, (x, j) -> coalesce(shiftright(x, 31) = shiftright(get(k, j - 1), 31), false) or coalesce(shiftright(x, 31) = shiftright(get(k, j + 1), 31), false))"
    told = f"sort_array(transform(transform({met}, x -> cast(x & 2147483647L as int)), p -> struct(element_at(w, p) as a, element_at(w, p + 1) as b, element_at(w, p + 2) as c, p as p)))"
    same = lambda other: f"coalesce(x.a = get(s, {other}).a and x.b = get(s, {other}).b and x.c = get(s, {other}).c, false)"
    places = f"sort_array(transform(filter(s, (x, j) -> {same('j - 1')} or {same('j + 1')}), x -> x.p))"
    covered = f"aggregate({places}, struct(0 as until, 0L as n), (a, p) -> struct(p + 3 as until, a.n + p + 3 - greatest(a.until, p) as n), a -> a.n)"
    repeats = f"transform(array({hashed}), k -> transform(array({told}), s -> {covered})[0])[0]"
    of_words = f"transform(array({words}), w -> struct(cast(size(w) as bigint) as n_words, {repeats} as n_repeat_words))[0]"
    lines = f"filter(split({text}, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    of_lines = f"transform(array({lines}), l -> struct(cast(size(l) as bigint) as n_lines, cast(size(l) - size(array_distinct(l)) as bigint) as n_dup_lines))[0]"
    chars = f"cast(length({text}) - regexp_count({text}, '{_GAP}') as bigint)"
    symbols = f"cast(regexp_count({text}, '[#*$%&|<>]') as bigint)"
    return F.expr(f"struct({of_words} as w, {of_lines} as l, {chars} as word_chars, {symbols} as n_symbols)")


def measured(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep_text: bool = True) -> DataFrame:
    """doc (struct of the input's columns), host, MEASURES, and fails (struct of RULES)."""
    held = [c for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in held]).alias("doc"), F.col(f"`{host_col}`").cast("string").alias("host"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text0"))
    rows = rows.select("doc", "host", measures("text0").alias("m"))
    places = {"n_words": "m.w", "n_repeat_words": "m.w", "n_lines": "m.l", "n_dup_lines": "m.l"}
    rows = rows.select("doc", "host", *[F.col(f"{places.get(c, 'm')}.{c}").alias(c) for c in MEASURES])
    return rows.withColumn("fails", F.struct(*[F.expr(rule).alias(name) for name, rule in RULES.items()]))


def host_verdicts(rows: DataFrame, limit: float = LIMIT) -> DataFrame:
    """host, n_docs, shrunk (struct of a rate for each rule), bad; documents without a host are in none.

    The prior of a rule has the mean of all documents and the variance that the
    hosts' rates have beyond what drawing their documents explains (method of
    moments); its weight in documents stays within PRIOR_DOCUMENTS.
    """
    counts = rows.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(f"fails.{r}").cast("long")).alias(r) for r in RULES])
    counts = written(counts, "host-counts")
    moments = [F.sum(r).alias(f"f_{r}") for r in RULES] + [F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"s_{r}") for r in RULES]
    all_ = counts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), *moments).first()
    shrunk = []
    for r in RULES:
        weight, mean = PRIOR_DOCUMENTS[1], 0.0
        if all_["n"]:
            mean = all_[f"f_{r}"] / all_["n"]
            drawn = mean * (1 - mean)
            between = all_["n"] - all_["nn"] / all_["n"]  # as many documents tell hosts apart
            excess = all_[f"s_{r}"] - all_["n"] * mean * mean - (all_["hosts"] - 1) * drawn
            if between > 0 and excess > 0:
                weight = drawn * between / excess - 1
        weight = min(max(weight, PRIOR_DOCUMENTS[0]), PRIOR_DOCUMENTS[1])
        shrunk.append(F.round((F.col(r) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight)), 9).alias(r))
    out = counts.select("host", F.col("n").alias("n_docs"), F.struct(*shrunk).alias("shrunk"))
    return out.withColumn("bad", F.expr(" or ".join(f"shrunk.{r} > {limit}" for r in RULES)))


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = LIMIT, keep_text: bool = True) -> DataFrame:
    """doc, host, MEASURES, fails, base_failed, host_bad, kept, of every row.

    ``kept`` is false if the document fails the base rule or its host is bad.
    ``keep_text=False`` leaves the text out of ``doc``; the measures are then
    written once to the shared folder, else they are made twice, for the hosts
    and for the documents, and no text is written.

    Null and empty texts have no words and fail the base rule. A null host is
    no host: its documents are judged alone. Repeated rows count each. Texts
    are measured whole, in time n log n. An empty table gives no rows. Columns
    of any name ride along in ``doc``.
    """
    rows = measured(docs, text_col, host_col, keep_text)
    if not keep_text:
        rows = written(rows, "measured")
    verdicts = written(host_verdicts(rows, limit), "host-verdicts").select(F.sha2("host", 256).alias("key"), "n_docs", "bad")
    rows = rows.withColumn("key", F.sha2("host", 256))
    n = verdicts.count()
    if n <= BROADCAST_HOSTS:
        found = rows.join(F.broadcast(verdicts.select("key", F.col("bad").alias("host_bad"))), "key", "left")
    else:  # a host is hot or its documents are few: no task gets a hot host's rows
        least = verdicts.agg(F.sum("n_docs")).first()[0] / HOT_SHARE
        hot = F.broadcast(verdicts.filter(F.col("n_docs") >= least).select("key", F.col("bad").alias("hot_bad")))
        rest = verdicts.filter(F.col("n_docs") < least).select(F.col("key").alias("cold_key"), F.col("bad").alias("cold_bad"))
        found = rows.join(hot, "key", "left").withColumn("cold_key", F.when(F.col("hot_bad").isNull() & F.col("key").isNotNull(), F.col("key")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc").cast("string"))))
        found = found.join(rest, "cold_key", "left").withColumn("host_bad", F.coalesce("hot_bad", "cold_bad"))
    found = found.withColumn("host_bad", F.coalesce("host_bad", F.lit(False))).withColumn("base_failed", F.col("fails.base"))
    return found.withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad")).select("doc", "host", *MEASURES, "fails", "base_failed", "host_bad", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = LIMIT) -> DataFrame:
    """The documents that ``judge`` keeps, with their columns."""
    return judge(docs, text_col, host_col, limit).filter("kept").select("doc.*")
