"""Audit of how filters interact, from a histogram of failure masks.

Each document fails some of five filters: a mask of five bits. What any order of
the filters removes depends on how many documents have each mask only, so the
table is read once, counted into 32 cells a part, and all 120 orders are
enumerated from the cells.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_GAP = r"[\\x20\\x09-\\x0D]"


def text_mask(text: str) -> Column:
    """Bits 0 to 3: filters A to D, each a function of the text alone."""
    words = f"filter(split({text}, '{_GAP}+'), w -> w <> '')"
    # one lambda binds the words, which are cut once
    few = f"transform(array({words}), w -> if(size(w) < 200, 1, 0) + if(100L * size(array_distinct(w)) < 50L * size(w), 2, 0))[0]"
    upper = f"if(100L * regexp_count({text}, '[A-Z]') > 3L * length({text}), 4, 0)"
    marks = f"if({text} rlike '[#$%&*|]', 8, 0)"
    return F.expr(f"{few} + {upper} + {marks}")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask; at most 32 rows a part.

    Texts are grouped by their SHA-256, so a row of the shuffle is some hundred
    bytes. Copies are counted before each shuffle: a text that a third of the
    table holds is a row for each task and part.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask("text").cast("int").alias("mask"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marked = labels.groupBy(F.col(id_col).alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).filter("good + toxic > 0")
    same = ["part", "digest", "mask"]
    one = rows.join(marked, "id", "left").groupBy("id", *same).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    counts = F.struct("id", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # the rows of the smallest id of a text within a part, and all rows
    of_part = one.groupBy(*same).agg(F.min(F.when(F.col("id").isNotNull(), counts)).alias("first"), *[F.sum(F.when(F.col("id").isNotNull(), F.coalesce(c, F.lit(0))).otherwise(0)).alias(c) for c in ("n", "good", "toxic")], *[F.sum(F.when(F.col("id").isNull(), F.coalesce(c, F.lit(0))).otherwise(0)).alias(f"{c}0") for c in ("n", "good", "toxic")])
    # a text has a row for each part
    held = of_part.withColumn("passes", F.coalesce(F.col("first.id") == F.min("first.id").over(Window.partitionBy("digest")), F.lit(False)))
    kept = lambda c: F.when(F.col("passes"), F.col(f"first.{c}")).otherwise(0) + F.col(f"{c}0")
    split = [F.struct(F.col("mask"), *[kept(c).alias(c) for c in ("n", "good", "toxic")]), F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(c) + F.col(f"{c}0") - kept(c)).alias(c) for c in ("n", "good", "toxic")])]
    both = held.select("part", F.explode(F.array(*split)).alias("c")).select("part", "c.*").filter("n > 0")
    return both.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step and what the step's filter does in that order: 600 rows a part.

    Filters fail a text: A under 200 words, B fewer distinct words than half, C
    over 3 of 100 characters in A-Z, D any of #$%&*|, E equal to the text of a
    smaller id anywhere in the table. kept (after the step), removed (here),
    redundant (fails, but was removed earlier), unique_fails (fails this filter
    only), good_lost and toxic_lost (removed here with that label), shapley
    (removed by the filter, summed over all 120 orders).

    A null text is the empty one (and equals it); a null part is the empty
    string. A null id is not smaller than any and has no smaller one. Rows that
    repeat an id and its text count each and do not fail E through each other.
    Labels that repeat an id hold if any row has them; labels of no document
    count nowhere. An empty table gives no rows; other columns are not read.
    """
    held = cells(docs, labels, id_col, text_col, part_col)
    listed = ",".join(ORDERS)
    steps = held.withColumn("filter_order", F.explode(F.split(F.lit(listed), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = lambda letter: f"shiftleft(1, instr('{FILTERS}', {letter}) - 1)"
    before = f"aggregate(sequence(0, step - 1), 0, (a, i) -> if(i = 0, a, a | {at('substr(filter_order, i, 1)')}))"
    steps = steps.withColumn("bit", F.expr(at("substr(filter_order, step, 1)"))).withColumn("earlier", F.expr(before))
    removed = "(mask & bit) <> 0 and (mask & earlier) = 0"
    total = lambda what, n, name: F.expr(f"coalesce(sum(if({what}, {n}, 0)), 0)").cast("long").alias(name)
    return steps.groupBy("part", "filter_order", "step").agg(
        total("(mask & (bit | earlier)) = 0", "n", "kept"),
        total(removed, "n", "removed"),
        total("(mask & bit) <> 0 and (mask & earlier) <> 0", "n", "redundant"),
        total("mask = bit", "n", "unique_fails"),
        total(removed, "good", "good_lost"),
        total(removed, "toxic", "toxic_lost"),
        # of all orders, each filter that a mask fails comes first in an equal share
        total("(mask & bit) <> 0", f"n * ({len(ORDERS)} div greatest(bit_count(mask), 1))", "shapley"),
    )
