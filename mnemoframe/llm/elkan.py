"""Centroid clustering of integer vectors with Elkan's bounds.

Every vector keeps an upper bound of the distance to its own centroid and a
lower bound of the distance to each centroid. A round moves the bounds by how far
the centroids moved and computes a distance only where the bounds, and half the
distance between two centroids, leave the nearest open. Vectors and bounds are a
table in the shared folder, written anew each round; only the centroids and the
sums of each cluster (k rows) pass through the driver.

Distances are exact integers. Bounds are rounded outwards, and a centroid is
passed over only if it is strictly farther, so ties go to the smaller number as
without bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written

CLUSTERS, ROUNDS, SCALE, DIMENSIONS = 16, 3, 64, 64
#: By how much bounds are widened: more than square roots, sums and 32-bit storage of a double round by.
_WIDER = 2.0**-48
_LONG = 1 << 63


def largest_component(dimensions: int) -> int:
    """Integers up to this have squared distances that fit a long."""
    return int((2**61 // max(dimensions, 1)) ** 0.5)


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of the vectors of ``dimensions`` finite components."""
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    whole = f"x is not null and size(x) = {dimensions} and forall(x, c -> c is not null and not isnan(c) and abs(c * {scale}) <= {largest_component(dimensions)})"
    return out.filter(whole).select("id", F.expr(f"transform(x, c -> cast(floor(c * {scale}) as int))").alias("v"))


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + _WIDER)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) * (1 - _WIDER)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to ``b`` (a row, or as many)."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


class Centroids:
    """Centroids, half the distances between them, and how far each came from the last round's."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        k = len(now)
        self.now = now
        self.moved = _up(np.sqrt(_squares(now, before).astype(np.float64))) if before is not None else None
        apart = np.array([_squares(now, c) for c in now]).reshape(k, k).astype(np.float64)
        self.half = _down(0.5 * np.sqrt(apart))
        self.nearest = np.where(np.eye(k, dtype=bool), np.inf, self.half).min(axis=1)

    def assign(self, rows: np.ndarray, own: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """own, exact squared distance (-1: not computed), upper, lower, number of distances computed, of each row."""
        n, k = len(rows), len(self.now)
        square, computed = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        if own is None:
            own, lower = np.zeros(n, np.int64), np.zeros((n, k))
            upper = np.full(n, np.inf)
        else:
            own, upper, lower = own.copy(), _up(upper + self.moved[own]), _down(lower - self.moved)
        rest = np.flatnonzero(~(upper < self.nearest[own]))
        for j in range(k):
            at = rest[self._near(rest, j, own, upper, lower)]
            stale = at[square[at] < 0]
            self.measure(rows, stale, own, square, upper, lower, computed)
            at = at[self._near(at, j, own, upper, lower)]
            d = _squares(rows[at], self.now[j])
            lower[at, j] = _down(np.sqrt(d.astype(np.float64)))
            computed[at] += 1
            closer = (d < square[at]) | ((d == square[at]) & (j < own[at]))
            at, d = at[closer], d[closer]
            own[at], square[at], upper[at] = j, d, _up(np.sqrt(d.astype(np.float64)))
        return own, square, upper, lower, computed

    def _near(self, at: np.ndarray, j: int, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Whether centroid j may be as near as the own one."""
        return (own[at] != j) & ~(lower[at, j] > upper[at]) & ~(self.half[own[at], j] > upper[at])

    def measure(self, rows: np.ndarray, at: np.ndarray, own: np.ndarray, square: np.ndarray, upper: np.ndarray, lower: np.ndarray, computed: np.ndarray) -> None:
        """Exact distances to the own centroids."""
        if len(at):
            square[at] = _squares(rows[at], self.now[own[at]])
            root = np.sqrt(square[at].astype(np.float64))
            upper[at], lower[at, own[at]] = _up(root), _down(root)
            computed[at] += 1


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


_STATE = "id long, v array<int>, own int, square long, upper float, lower array<float>, computed long"
_NAMES = ["id", "v", "own", "square", "upper", "lower", "computed"]


def _round(state: DataFrame, centroids: Centroids, last: bool) -> DataFrame:
    """The next state; in the last round every row has its exact distance."""
    shipped = state.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("v"), np.int64)
            held = "own" in batch.schema.names
            before = [batch.column("own").to_numpy().astype(np.int64), batch.column("upper").to_numpy().astype(np.float64), _matrix(batch.column("lower"), np.float64)] if held else [None] * 3
            own, square, upper, lower, computed = at.assign(rows, *before)
            if last:
                at.measure(rows, np.flatnonzero(square < 0), own, square, upper, lower, computed)
            if held:
                computed = computed + batch.column("computed").to_numpy()
            # stored in 32 bits, again rounded outwards
            upper32, lower32 = np.nextafter(upper.astype(np.float32), np.float32(np.inf)), np.nextafter(lower.astype(np.float32), np.float32(-np.inf))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(at.now)), pa.array(np.maximum(lower32, 0).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own.astype(np.int32)), pa.array(square), pa.array(upper32), lists, pa.array(computed)], _NAMES)

    return state.mapInArrow(run, _STATE)


def _sums(state: DataFrame, dimensions: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and componentwise sums of each cluster: one row a cluster reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            own, rows = batch.column("own").to_numpy(), _matrix(batch.column("v"), np.int64) if batch.num_rows else None
            for j in np.unique(own).tolist():
                counts[j] = counts.get(j, 0) + int((own == j).sum())
                sums[j] = sums.get(j, 0) + rows[own == j].sum(axis=0)
        for j in counts:
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([counts[j]], pa.int64()), pa.array([sums[j].tolist()], pa.list_(pa.int64()))], ["own", "n", "sums"])

    parts = state.select("own", "v").mapInArrow(run, "own int, n long, sums array<long>")
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions)]
    return {r["own"]: (r["n"], [int(r[f"s{i}"]) for i in range(dimensions)]) for r in parts.groupBy("own").agg(F.sum("n").alias("n"), *total).collect()}


def cluster(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256, computed, of every kept vector.

    Vectors are turned into integers floor(scale * x). The k with the smallest
    hex SHA-256 of ``1:<id>`` are the first centroids, in that order. Each round
    assigns every vector to the nearest centroid (ties: smaller number) and puts
    each centroid at the floor of its vectors' mean; one without vectors stays.
    Then vectors are assigned once more. ``computed`` counts the distances that
    were computed for the vector; without bounds it would be k * (rounds + 1).

    Vectors that are null, of another length, or hold null or non-finite
    components take no part; nor do those with a component beyond
    ``largest_component`` (some 2,900,000 for 64 components of scale 64), whose
    squared distances a long does not hold. Rows of equal id are vectors of
    their own (as first centroids ordered by components); a null id is
    clustered and chosen as a first centroid last. Fewer than k vectors make
    fewer centroids; equal first centroids leave the later one empty. An
    inertia beyond a long is null. An empty table gives no rows. Other columns
    of the table are not read.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, id_col, vector_col, dimensions, scale)
    seeds = vectors.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    kinds = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, computed long"
    if not seeds:
        return spark.createDataFrame([], kinds)
    now = np.array([r["v"] for r in seeds], np.int64)
    state = written(_round(vectors, Centroids(now), rounds == 0), "elkan")
    for i in range(rounds):
        before, now = now, now.copy()
        for j, (n, sums) in _sums(state, dimensions).items():
            now[j] = [s // n for s in sums]
        last = state
        state = written(_round(state, Centroids(now, before), i == rounds - 1), "elkan")
        discard(last)
    inertia = {r["own"]: int(r["d"]) for r in state.groupBy("own").agg(F.sum(F.col("square").cast("decimal(38,0)")).alias("d")).collect()}
    long = lambda x: x if x < _LONG else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    named = [(j, long(d), long(sum(inertia.values())), digest(now[j])) for j, d in inertia.items()]
    # at most k rows
    of_cluster = F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    found = state.select("id", F.col("own").alias("cluster"), F.col("square").alias("distance"), "computed")
    return found.join(of_cluster, "cluster").select(*[c.split()[0] for c in kinds.split(", ")])
