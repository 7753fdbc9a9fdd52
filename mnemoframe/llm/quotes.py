"""Quotation linking: from messages that quote each other to reply-ordered
conversations without quotes. DataFrame functions only.

A line's level is its number of leading quote marks; a passage is a run of lines
of one level. Each quoted line is normalised and hashed, and joined to the
latest earlier message of the conversation that has the line as its own. Lines
without such a message are looked up as running text: line breaks count as
spaces, and a passage's windows of words are joined to those of the messages'
own texts, so quotes that were wrapped anew or that begin or end within a line
link too; such a line is found if windows cover all its words, and it comes from
the message with most of them. A passage belongs to the message that holds most
of its lines. "Latest earlier" is computed by windows over blocks of turns and over
the blocks' maxima, never by pairs, so a line that everybody repeats costs one
row for each message it is in.

A message replies to what its outermost quotes come from, else to the message
before it. A message that replies to the one just before it, by quotes or for
want of any, continues its run, so a chain of such replies costs no path;
``thread`` is the path of the runs that a message hangs from, so sorting by (thread, turn) walks the reply tree
depth first: the rest of a run, then what was attached to it, latest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

BLOCK = 1024
#: Words of a window; shorter passages are looked up whole, by windows of their length.
WINDOW = 5
_LOW = -(1 << 62)
_QUOTED = r"(?:^|\\r|\\n)[ \\t]*>"
#: "On ... wrote:" before a quote, in four languages.
_ATTRIBUTION = r"(?iu)^(on\\b.*\\bwrote|am\\b.*\\bschrieb.*|le\\b.*\\bécrit|el\\b.*\\bescribió)\\s*:$"


def latest_before(events: DataFrame, keys: list[str], at: str = "at", mark: str = "mark") -> DataFrame:
    """``events`` with ``found``: the largest ``at`` of the marked rows of the
    same keys that is smaller than the row's own. No key may be null."""
    rows = events.withColumn("_block", F.floor(F.col(at) / BLOCK))
    marked = F.when(F.col(mark), F.col(at))
    blocks = rows.groupBy(*keys, "_block").agg(F.max(marked).alias("_most"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", F.max("_most").over(earlier).alias("_earlier"))
    inside = Window.partitionBy(*keys, "_block").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_inside", F.max(marked).over(inside)).join(blocks, [*keys, "_block"]).withColumn("found", F.coalesce("_inside", "_earlier")).drop("_block", "_inside", "_earlier")


_PARSED = r"""
transform(split(text, '\\r\\n?|\\n'), l -> struct(
  length(regexp_replace(regexp_extract(l, '^[ \\t]*(>[> \\t]*)', 1), '[^>]', '')) as level,
  regexp_replace(l, '^[ \\t]*>[> \\t]*', '') as body))
"""
_ATTRIBUTED = f"transform(parsed, (l, i) -> struct(l.level, l.body, l.level = 0 and coalesce(get(parsed, i + 1).level, 0) > 0 and trim(l.body) rlike '{_ATTRIBUTION}' as attribution))"
#: Words of a normalised line; scripts without spaces count by characters.
_SCRIPTS = r"\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}"
_WORDS = rf"regexp_extract_all(norm, '[{_SCRIPTS}]|[\\p{{L}}\\p{{M}}\\p{{N}}&&[^{_SCRIPTS}]]+', 0)"
_OWN = "transform(filter(parsed, l -> l.level = 0 and not l.attribution), l -> l.body)"


def in_order(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``words`` of the lines of equal keys, one after the other, and ``owners``, each word's line."""
    said = F.array_sort(F.collect_list(F.struct("pos", "words")))
    texts = lines.groupBy(*keys).agg(said.alias("said"))
    return texts.select(*keys, F.expr("flatten(transform(said, l -> l.words))").alias("words"), F.expr("flatten(transform(said, l -> array_repeat(l.pos, size(l.words))))").alias("owners"))


def windows(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``line``, the hash of each run of ``n`` words, its place and the lines of its words."""
    each = "transform(sequence(0, size(words) - n), i -> struct(i, xxhash64(n, array_join(slice(words, i + 1, n), ' ')) as line, slice(owners, i + 1, n) as owners))"
    return texts.filter("size(words) >= n").select(*keys, F.explode(F.expr(each)).alias("w")).select(*keys, "w.*")


def found_by_windows(met: DataFrame, lines: DataFrame) -> DataFrame | None:
    """(key, at, hash, pos, found) of the quoted lines in ``met`` without an
    original whose words the own texts in ``lines`` hold; None if nothing is asked."""
    message = ["key", "at", "hash"]
    run = [*message, "passage", "run"]
    near = Window.partitionBy(*message, "passage").orderBy("pos")
    quoted = met.withColumn("run", F.col("pos") - F.row_number().over(near)).withColumn("words", F.expr(_WORDS))  # blank lines end a run
    open_runs = quoted.filter("found is null").select(*run).distinct()
    asked = in_order(quoted.join(open_runs, run, "left_semi"), run).filter("size(words) > 0").withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))
    asked = written(windows(asked, run), "quoted-windows")
    sizes = [r["n"] for r in asked.select(F.size("owners").alias("n")).distinct().collect()]  # WINDOW at most
    if not sizes:
        return None
    own = lines.filter("level = 0 and not attribution and norm <> ''").join(asked.select("key").distinct(), "key", "left_semi").withColumn("words", F.expr(_WORDS))
    own = in_order(own, [*message, "passage"]).withColumn("n", F.explode(F.array(*[F.lit(n) for n in sorted(sizes)])))
    own = windows(own, ["key", "at"]).select("key", "line", "at", F.lit(True).alias("mark"))
    events = own.union(asked.select("key", "line", "at", F.lit(False).alias("mark"))).distinct()
    origin = latest_before(events, ["key", "line"]).filter("not mark and found is not null").select("key", "line", "at", "found")
    hits = asked.join(origin, ["key", "line", "at"]).select(*run, "i", "found", F.posexplode("owners").alias("k", "pos"))
    words = hits.select(*message, "pos", "passage", "run", (F.col("i") + F.col("k")).alias("word"), "found").distinct()
    one = [*message, "pos"]
    covered = words.select(*one, "word").distinct().groupBy(*one).agg(F.count("*").alias("covered"))
    best = words.groupBy(*one, "found").agg(F.count("*").alias("n")).groupBy(*one).agg(F.max(F.struct("n", "found")).getField("found").alias("found"))
    wanted = quoted.filter("found is null").select(*one, F.size("words").cast("long").alias("covered"))
    return wanted.join(covered, [*one, "covered"], "left_semi").join(best, one).select(*one, "found")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row per message: doc (struct of all input columns, whatever their
    names), body, reply_to, linked, n_quoted, n_found, thread.

    ``body`` is the text without quoted lines and the attribution lines before
    them, trimmed; a text without quotes stays as it is, null stays null.
    ``reply_to`` is the turn replied to (null for a conversation's first),
    ``linked`` tells that quotes decided it; ``n_quoted`` counts quoted lines
    with words, ``n_found`` those whose original is known. Of several possible
    originals the latest counts; passages tie to the later original. Null
    conversations are one conversation; a null turn comes first. Rows of equal
    turn are siblings, each with its own quotes; a thread starts where any of
    them is linked (at the latest original) to another turn than the one before. An empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("k"), F.col(conv_col).cast("string")), F.lit("n")).alias("key")
    text = F.col(text_col).cast("string")
    rows = messages.select(F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("doc"), key, F.coalesce(F.col(turn_col).cast("long"), F.lit(_LOW)).alias("at"), F.xxhash64(text).alias("hash"), text.alias("text"))
    quoting = F.coalesce(F.expr(f"text rlike '{_QUOTED}'"), F.lit(False))
    talks = rows.filter(quoting).select("key").distinct()

    # lines of the conversations that quote at all
    said = rows.join(talks, "key", "left_semi").select("key", "at", "hash", "text").distinct()
    lines = said.select("key", "at", "hash", F.expr(_PARSED).alias("parsed")).select("key", "at", "hash", F.posexplode(F.expr(_ATTRIBUTED)).alias("pos", "l"))
    lines = lines.select("key", "at", "hash", "pos", "l.level", "l.attribution", F.expr("trim(regexp_replace(lower(l.body), '\\\\s+', ' '))").alias("norm"))
    by_message = Window.partitionBy("key", "at", "hash").orderBy("pos")
    starts = F.when(F.coalesce(F.lag("level").over(by_message) != F.col("level"), F.lit(True)), F.col("pos"))
    lines = lines.withColumn("start", starts).withColumn("passage", F.max("start").over(by_message.rowsBetween(Window.unboundedPreceding, 0)))
    quoted = lines.filter("level > 0 and norm <> ''").withColumn("line", F.xxhash64("norm"))
    own = lines.filter("level = 0 and not attribution and norm <> ''").select("key", F.xxhash64("norm").alias("line"), "at", F.lit(True).alias("mark"))
    asked = quoted.select("key", "line", "at", F.lit(False).alias("mark"))
    origin = latest_before(own.union(asked).distinct(), ["key", "line"]).filter("not mark and found is not null").select("key", "line", "at", "found")
    met = written(quoted.join(origin, ["key", "line", "at"], "left"), "quoted-lines")
    message = ["key", "at", "hash"]
    by_words = found_by_windows(met, lines)
    if by_words is not None:
        met = met.join(by_words.withColumnRenamed("found", "by_words"), [*message, "pos"], "left").withColumn("found", F.coalesce("found", "by_words"))
    passages = met.groupBy(*message, "level", "passage", "found").agg(F.count("*").alias("n"))
    passages = passages.groupBy(*message, "level", "passage").agg(F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("found").isNotNull(), F.col("n"))).alias("n_found"), F.max(F.when(F.col("found").isNotNull(), F.struct("n", "found"))).alias("best"))
    outermost = F.struct(-F.col("level"), F.col("best.n"), F.col("best.found").alias("found"))
    linked = passages.groupBy(*message).agg(F.sum("n_quoted").alias("n_quoted"), F.coalesce(F.sum("n_found"), F.lit(0)).alias("n_found"), F.max(F.when(F.col("best").isNotNull(), outermost)).getField("found").alias("parent"))
    linked = written(linked, "quote-links")

    # runs: a message linked to another than the one before it starts one, attached to its parent's run
    heads = linked.filter("parent is not null").groupBy("key", "at").agg(F.max("parent").alias("parent"))
    turns = rows.select("key", "at").distinct()
    turns = turns.join(heads, ["key", "at"], "left")
    turns = latest_before(turns.withColumn("mark", F.lit(True)), ["key"]).withColumnRenamed("found", "before")
    turns = turns.withColumn("parent", F.when(F.col("parent") != F.col("before"), F.col("parent")))
    turns = latest_before(turns.withColumn("mark", F.col("parent").isNotNull()), ["key"])
    turns = written(turns.select("key", "at", "parent", "before", F.when(F.col("mark"), F.col("at")).otherwise(F.col("found")).alias("run")), "turns")
    starts = turns.filter("parent is not null")
    of_parent = turns.select("key", F.col("at").alias("parent"), F.col("run").alias("up"))
    paths = written(starts.join(of_parent, ["key", "parent"]).select("key", F.col("at").alias("run"), "up", F.array(-F.col("parent"), F.col("at")).alias("thread")), "threads")
    while not paths.filter("up is not null").isEmpty():  # pointer jumping: rounds grow with the logarithm of the nesting
        above = paths.select("key", F.col("run").alias("up"), F.col("up").alias("up2"), F.col("thread").alias("thread2"))
        joined = paths.join(above, ["key", "up"], "left")
        paths = written(joined.select("key", "run", F.col("up2").alias("up"), F.when(F.col("thread2").isNull(), F.col("thread")).otherwise(F.concat("thread2", "thread")).alias("thread")), "threads")

    null = lambda c: F.when(c > _LOW, c)
    out = rows.alias("m").join(linked.alias("l"), (F.col("m.key") == F.col("l.key")) & (F.col("m.at") == F.col("l.at")) & (F.col("m.hash") == F.col("l.hash")), "left").select("doc", "m.key", "m.at", "text", "n_quoted", "n_found", F.col("l.parent").alias("own_parent"))
    out = out.join(turns.select("key", "at", "before", "run"), ["key", "at"]).join(paths.select("key", "run", "thread"), ["key", "run"], "left")
    parsed = F.expr(_PARSED)
    body = out.withColumn("parsed", F.when(quoting, parsed)).withColumn("parsed", F.expr(_ATTRIBUTED)).withColumn("body", F.when(quoting, F.expr(f"regexp_replace(array_join({_OWN}, '\\n'), '^\\\\s+|\\\\s+$', '')")).otherwise(F.col("text")))
    return body.select(
        "doc",
        "body",
        null(F.coalesce("own_parent", "before")).alias("reply_to"),
        F.col("own_parent").isNotNull().alias("linked"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"),
        F.coalesce("thread", F.expr("cast(array() as array<bigint>)")).alias("thread"),
    )
