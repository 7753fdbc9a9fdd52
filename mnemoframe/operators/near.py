"""Similar vectors without comparing all: signatures of random hyperplanes in bands, every hit verified.

A vector's signature in a table is on which side of some planes it lies. Vectors
of equal signature meet; a query also looks where its least certain bits are
flipped. How many planes, flips and tables there are follows from the number of
vectors, the least similarity and the recall asked for: of all settings that give
the recall at that similarity, the one with the least work. Higher similarities
are found with higher probability. Hits are compared exactly, in blocks.

Equal vectors are one class, of which the newest few stand for all, so copies
cost nothing; a crowded signature is compared in chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

RECALL, CHUNK, BLOCK = 0.995, 16_000, 128
#: Fewest and most planes of a table; flips of the least certain bits; rows that travel once cost as much as so many comparisons.
PLANES, FLIPS, TRAVEL = (3, 24), (0, 1), 6000
#: Crowded signatures that are broadcast (some 30 bytes each); more of them meet by a shuffle.
BROADCAST_CROWDS = 100_000


@lru_cache
def plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int, int]:
    """(planes, flips, tables) of least work for ``n`` vectors, with so many planes that an even signature is no crowd.

    The chance to meet at the threshold is estimated from simulated pairs: the
    margins of a query are normal, a bit of its partner differs if the partner's
    own part outweighs the margin.
    """
    rng = np.random.default_rng(11)
    most = PLANES[1]
    margin, own = np.abs(rng.normal(size=(20_000, most))), rng.normal(size=(20_000, most))
    differs = own * math.sqrt(max(0.0, 1 - threshold**2)) > threshold * margin
    best = None
    for planes in range(PLANES[0], most + 1):
        if n / 2**planes > CHUNK / 2 and planes < most:
            continue
        rank = margin[:, :planes].argsort(axis=1).argsort(axis=1)
        for flips in FLIPS:
            met = float((~differs[:, :planes] | (rank < flips)).all(axis=1).mean())
            if met < 0.002:
                continue
            tables = 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))
            work = tables * (2**flips * n / 2**planes + TRAVEL * (1 + 2**flips))
            if best is None or work < best[0]:
                best = (work, planes, flips, tables)
    return best[1:]


def planes_of(planes: int, tables: int, dimensions: int) -> np.ndarray:
    """The same on every worker."""
    return np.random.default_rng(7).normal(size=(tables, planes, dimensions))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _signed(rows: DataFrame, planes: int, flips: int, tables: int, dimensions: int, bare: bool = False) -> DataFrame:
    """(scope, part, code, cls, before, v): ``part`` is the table, ``code`` the signature; with ``flips`` also the flipped
    ones. ``bare`` gives the first three, to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, powers = planes_of(planes, tables, dimensions), 1 << np.arange(planes)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, every = _matrix(batch.column("v")), np.arange(batch.num_rows)
            for part in range(tables):
                sides = vectors @ normals[part].T
                code = (sides > 0) @ powers
                unsure = powers[np.abs(sides).argsort(axis=1)[:, :flips]] if flips else np.zeros((len(code), 0), np.int64)
                for chosen in range(1 << flips):
                    mask = np.zeros(len(code), np.int64)
                    for bit in range(flips):
                        if chosen >> bit & 1:
                            mask ^= unsure[:, bit]
                    own = [batch.column("scope"), pa.array(np.full(len(every), part, np.int32)), pa.array((code ^ mask).astype(np.int64))]
                    rest = [] if bare else ["cls", "before", "v"]
                    yield pa.RecordBatch.from_arrays([*own, *[batch.column(c) for c in rest]], ["scope", "part", "code", *rest])

    return rows.select("scope", "cls", "before", "v").mapInArrow(run, "scope string, part int, code long" + ("" if bare else ", cls string, before long, v array<float>"))


_HIT = "scope string, asked string, cls string, similarity double"


def _compared(k: int, threshold: float):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if asked.num_rows and rows.num_rows:
            q, v = (_matrix(t.column("v").combine_chunks()) for t in (asked, rows))
            q, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, v))
            names, places, before = asked.column("cls").to_pylist(), rows.column("cls").to_numpy(zero_copy_only=False), rows.column("before").to_numpy()
            for start in range(0, len(q), BLOCK):
                near = np.round(np.clip(q[start : start + BLOCK] @ v.T, 0, 1), 12)
                line, at = np.nonzero(near >= threshold)
                close = near[line, at]
                # of each query the nearest k: most similar, then latest, then by name
                many = np.flatnonzero(np.bincount(line, minlength=len(near)) > k)
                keep = np.ones(len(line), bool)
                for i in many:
                    own = np.flatnonzero(line == i)
                    edge = np.partition(close[own], len(own) - k)[len(own) - k]
                    keep[own] = close[own] >= edge
                    own = own[close[own] >= edge]
                    if len(own) > k:
                        keep[own] = False
                        keep[own[np.lexsort((places[at[own]].astype(str), before[at[own]], -close[own]))[:k]]] = True
                found[0] += [names[start + i] for i in line[keep]]
                found[1] += places[at[keep]].tolist()
                found[2] += close[keep].tolist()
        scope = (asked if asked.num_rows else rows).column("scope")[0].as_py() if asked.num_rows or rows.num_rows else None
        return pa.table({"scope": pa.array([scope] * len(found[0]), pa.string()), "asked": pa.array(found[0], pa.string()), "cls": pa.array(found[1], pa.string()), "similarity": pa.array(found[2], pa.float64())})

    return run


def _usable(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce("scope", F.lit("")).alias("scope") if "scope" in rows.columns else F.lit("").alias("scope"), F.col("id").cast("string").alias("id"), (F.coalesce("at", F.lit(0)) if "at" in rows.columns else F.lit(0)).cast("long").alias("at"), F.col("v").cast("array<float>").alias("v")).filter("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")


def similar(rows: DataFrame, threshold: float, k: int, queries: DataFrame | None = None, recall: float = RECALL) -> DataFrame:
    """(query_id, id, similarity, rank): of each query the ``k`` most similar rows of its scope, from ``threshold`` on.

    ``rows`` and ``queries`` hold id, v (a vector) and, if wanted, at (of equal
    similarities the later comes first, then the smaller id) and scope (rows of
    other scopes are not looked at). Without ``queries`` every row asks for the
    others. Similarity is the cosine, clamped to [0, 1] and rounded to 12
    digits. A row of the query's own id is no candidate. Null and zero vectors,
    and those with null or non-finite components, take no part; nor do vectors
    of another length than the most frequent. Pairs are missed with a
    probability of at most 1 - ``recall`` at the threshold, less above.
    """
    alive = _usable(rows)
    common = alive.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = common["n"] if common else 1
    alive = alive.filter(F.size("v") == size)
    asking = alive if queries is None else _usable(queries).filter(F.size("v") == size)
    # Spark keeps the newest few of each task before it shuffles, so copies stay where they are
    newest = Window.partitionBy("scope", "v").orderBy(F.desc("at"), "id")
    few = alive.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= k + 1)
    members = few.groupBy("scope", "v").agg(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("before"), "id"))).alias("members"))  # k + 1 of a class
    classes = written(members.withColumns({"cls": F.col("members")[0]["id"], "before": F.col("members")[0]["before"]}), "near-classes")
    questions = classes if queries is None else written(asking.groupBy("scope", "v").agg(F.min("id").alias("cls"), F.lit(0).cast("long").alias("before")), "near-questions")
    planes, flips, tables = plan(max(classes.count(), 1), threshold, recall)
    key = ["scope", "part", "code"]
    count = lambda t, f, name: _signed(t, planes, f, tables, size, bare=True).groupBy(*key).agg((F.count("*") / CHUNK).alias(name)).filter(F.col(name) > 1)
    crowds = count(classes, 0, "nr").join(count(questions, flips, "nq"), key, "full_outer").select(*key, *[F.ceil(F.coalesce(c, F.lit(1))).cast("int").alias(c) for c in ("nr", "nq")])
    crowds = written(crowds, "near-crowds")
    crowds = F.broadcast(crowds) if crowds.count() <= BROADCAST_CROWDS else crowds
    # signatures are made anew rather than written: they are many, and hold the vectors
    held, asked = _signed(classes, planes, 0, tables, size), _signed(questions, planes, flips, tables, size)

    def dealt(t: DataFrame, own: str, other: str) -> DataFrame:
        t = t.join(crowds, key, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("nr", "nq")})
        mine = F.pmod(F.xxhash64("cls"), F.col(f"n{own}")).cast("int").alias(own)
        return t.select(*key, "cls", "before", "v", mine, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)).alias(other))

    chunk = [*key, "q", "r"]
    hits = dealt(asked, "q", "r").groupBy(*chunk).cogroup(dealt(held, "r", "q").groupBy(*chunk)).applyInArrow(_compared(k + 1, threshold), _HIT)
    hits = hits.distinct().join(classes.select("scope", "cls", "members"), ["scope", "cls"])
    best = Window.partitionBy("scope", "asked").orderBy(F.desc("similarity"), F.col("members")[0]["before"], F.col("members")[0]["id"])
    top = hits.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    # at most (k + 1) squared candidates of a class
    listed = F.transform("members", lambda m: F.struct((-F.col("similarity")).alias("less"), m["before"].alias("before"), m["id"].alias("id")))
    lists = top.groupBy("scope", "asked").agg(F.slice(F.array_sort(F.flatten(F.collect_list(listed))), 1, k + 1).alias("found"))
    lists = lists.join(questions.select("scope", F.col("cls").alias("asked"), "v"), ["scope", "asked"])
    each = asking.join(lists, ["scope", "v"]).select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k).alias("found"))
    return each.select("query_id", F.posexplode("found").alias("rank", "f")).select("query_id", F.col("f.id").alias("id"), (-F.col("f.less")).alias("similarity"), (F.col("rank") + 1).cast("int").alias("rank"))


_EXACT = "scope string, asked long, cls long, similarity double"


def _rows_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors in double precision, filled up with zeros to one length; their lengths; their norms."""
    lists = t.column("v").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = np.zeros((len(size), int(size.max(initial=0))))
    vectors[np.arange(vectors.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return vectors, size, t.column("norm").to_numpy(zero_copy_only=False)


def _exact(k: int, threshold: float):
    """Of each asked class the nearest k: matrix products say which pairs can be among them, these are summed in order."""

    def similarity(q: tuple, v: tuple, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = min(q[0].shape[1], v[0].shape[1])
        parts = q[0][line, :n] * v[0][at, :n]
        parts[np.arange(n) >= np.minimum(q[1][line], v[1][at])[:, None]] = 0.0
        length = q[2][line] * v[2][at]
        some = ~(length <= 0)
        # as Spark's least and greatest, to which NaN is the largest number
        with np.errstate(invalid="ignore"):
            out = np.fmax(0.0, np.fmin(1.0, parts.cumsum(axis=1)[:, -1] / np.where(some, length, 1.0)))
        return np.where(some, out, 0.0)

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if asked.num_rows and rows.num_rows:
            rows = rows.sort_by([("before", "ascending"), ("id", "ascending")])  # of equal similarity the first comes first
            q, v = _rows_of(asked), _rows_of(rows)
            n = min(q[0].shape[1], v[0].shape[1])
            odd = lambda norms: ~((norms == 0) | ((norms > 1e-100) & (norms < 1e100)))
            plain = [(x[2] != 0) & ~odd(x[2]) for x in (q, v)]
            units = [(np.where(p[:, None], x[0][:, :n], 0.0) / np.where(p, x[2], 1.0)[:, None]).astype(np.float32) for p, x in zip(plain, (q, v))]
            names, classes, odd_q, odd_v = asked.column("cls").to_numpy(), rows.column("cls").to_numpy(), odd(q[2]), odd(v[2])
            few, slack = min(k, len(classes)), 4e-7 * (n + 8)
            for start in range(0, len(names), BLOCK):
                near = np.clip(units[0][start : start + BLOCK] @ units[1].T, 0, 1)
                edge = np.partition(np.where(odd_v, -1, near) if odd_v.any() else near, len(classes) - few, axis=1)[:, len(classes) - few]
                can = near >= np.maximum(edge - 2 * slack, threshold - slack)[:, None]
                if odd_v.any() or odd_q[start : start + BLOCK].any():
                    can |= odd_v | odd_q[start : start + BLOCK, None]
                line, at = np.nonzero(can)
                close = np.empty(len(line))
                for first in range(0, len(line), CHUNK):
                    close[first : first + CHUNK] = similarity(q, v, line[first : first + CHUNK] + start, at[first : first + CHUNK])
                kept = close >= threshold
                line, at, close = line[kept], at[kept], close[kept]
                order = np.lexsort((at, -close, line))
                line, at, close = line[order], at[order], close[order]
                best = np.arange(len(line)) - np.searchsorted(line, line) < k
                for out, values in zip(found, (names[line[best] + start], classes[at[best]], close[best])):
                    out.append(values)
        scope = (asked if asked.num_rows else rows).column("scope")[0].as_py() if asked.num_rows or rows.num_rows else None
        each = [np.concatenate(x) if x else np.empty(0) for x in found]
        return pa.table({"scope": pa.array([scope] * len(each[0]), pa.string()), "asked": pa.array(each[0], pa.int64()), "cls": pa.array(each[1], pa.int64()), "similarity": pa.array(each[2], pa.float64())})

    return run


def nearest(rows: DataFrame, threshold: float, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): as ``similar``, but every pair of a scope is compared and similarity is not rounded.

    ``rows`` and ``queries`` hold id, v, at (nulls last) and scope (rows of none take
    no part). Vectors of any length meet over the shorter one; what has no norm is
    0 to all. Equal vectors are one class here too; a scope is compared in chunks,
    of which only the nearest few of each class leave a task, so the work is the
    square of a scope's classes in matrix products, and the rows shuffled are the
    classes once for each chunk of their scope.
    """
    whole = lambda t: t.select(F.col("scope").cast("string").alias("scope"), "id", F.coalesce(-F.col("at").cast("long"), F.lit((1 << 63) - 1)).alias("before"), "v").filter("scope is not null and id is not null and size(v) > 0")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    alive = whole(rows)
    asking = alive if queries is None else whole(queries)
    newest = Window.partitionBy("scope", "v").orderBy("before", "id")
    few = alive.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= k + 1)
    members = few.groupBy("scope", "v").agg(F.array_sort(F.collect_list(F.struct("before", "id"))).alias("members"))
    numbered = lambda t: t.withColumns({"cls": F.monotonically_increasing_id(), "norm": F.coalesce(F.sqrt(square), F.lit(0.0))})
    classes = written(numbered(members), "nearest-classes")
    questions = classes if queries is None else written(numbered(asking.select("scope", "v").distinct()), "nearest-questions")
    count = lambda t, name: t.groupBy("scope").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    parts = written(count(classes, "nr").join(count(questions, "nq"), "scope"), "nearest-scopes")

    def dealt(t: DataFrame, own: str, other: str, *more) -> DataFrame:
        mine = F.pmod(F.xxhash64("cls"), F.col(f"n{own}")).cast("int").alias(own)
        return t.join(parts, "scope").select(*[F.col(c).alias(c) for c in ("scope", "cls", "v", "norm")], *more, mine, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)).alias(other))

    chunk = ["scope", "q", "r"]
    first = [F.col("members")[0][c].alias(c) for c in ("before", "id")]
    hits = dealt(questions, "q", "r").groupBy(*chunk).cogroup(dealt(classes, "r", "q", *first).groupBy(*chunk)).applyInArrow(_exact(k + 1, threshold), _EXACT)
    # at most (k + 1) squared candidates of a class from each chunk
    listed = F.transform("members", lambda m: F.struct((-F.col("similarity")).alias("less"), m["before"].alias("before"), m["id"].alias("id")))
    hits = hits.join(classes.select("cls", "members"), "cls").select("scope", "asked", "similarity", "members")
    best = Window.partitionBy("asked").orderBy(F.desc("similarity"), F.col("members")[0])
    top = hits.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    lists = top.groupBy("asked").agg(F.slice(F.array_sort(F.flatten(F.collect_list(listed))), 1, k + 1).alias("found"))
    lists = lists.join(questions.select("scope", F.col("cls").alias("asked"), "v"), "asked")
    each = asking.join(lists, ["scope", "v"]).select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k).alias("found"))
    return each.select("query_id", F.posexplode("found").alias("rank", "f")).select("query_id", F.col("f.id").alias("id"), (-F.col("f.less")).alias("similarity"), (F.col("rank") + 1).cast("int").alias("rank"))
