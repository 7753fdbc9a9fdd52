"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then put into a leaf by
descending to the nearest centre. A query visits leaves best bin first: a
priority queue holds the nodes seen so far by distance to their centres, and the
nearest is opened next. How many leaves are visited is calibrated: for some
queries the exact neighbours are found over all rows, and visits widen until
their mean recall reaches the target.

Rows and visits meet in Spark by cells. A cell is a subtree of at most
CHUNK_ROWS rows, or a larger leaf; a query travels once to a cell, with the list
of the leaves it visits there, and at most k hits come back. Larger leaves are
cut into chunks of rows, popular cells into chunks of queries, so neither a
crowded leaf nor a popular region becomes one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

FIT_ROWS, BRANCHES, LEAF_SAMPLE, CALIBRATION = 20_000, 12, 24, 128
CHUNK_ROWS, CHUNK_QUERIES, BLOCK_QUERIES = 20_000, 20_000, 32
#: Share of the squared norms by which a product may err; doubles of some thousand dimensions stay far below it.
SLACK = 1e-9


class Tree:
    """Nodes in arrays: a node's children are ``first[i]:first[i] + many[i]``; ``leaf[i]`` or -1."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        centres, first, many, leaf = [sample.mean(axis=0)], [0], [0], [-1]
        open_, n_leaves = [(0, sample)], 0
        for node, rows in open_:  # grows while it is walked
            parts = _kmeans(rows, branches, rng) if len(rows) > leaf_sample else []
            if len(parts) < 2:
                leaf[node], n_leaves = n_leaves, n_leaves + 1
                continue
            first[node], many[node] = len(centres), len(parts)
            for part in parts:
                open_.append((len(centres), part))
                centres.append(part.mean(axis=0))
                first.append(0)
                many.append(0)
                leaf.append(-1)
        self.centres, self.first, self.many, self.leaf, self.n_leaves = np.array(centres), np.array(first), np.array(many), np.array(leaf), n_leaves

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(rows), np.int64)
        while True:
            inner = np.flatnonzero(self.many[node] > 0)
            if not len(inner):
                return self.leaf[node]
            for n in np.unique(node[inner]):
                own = inner[node[inner] == n]
                a, b = self.first[n], self.first[n] + self.many[n]
                node[own] = a + _squares(rows[own], self.centres[a:b]).argmin(axis=1)

    def cells(self, counts: np.ndarray) -> np.ndarray:
        """The cell of each leaf: that of its highest node of at most CHUNK_ROWS rows, else its own."""
        rows = np.zeros(len(self.leaf), np.int64)
        for n in reversed(range(len(self.leaf))):  # children stand after their node
            rows[n] = counts[self.leaf[n]] if self.leaf[n] >= 0 else rows[self.first[n] : self.first[n] + self.many[n]].sum()
        of_node, of_leaf, n_cells = np.full(len(self.leaf), -1, np.int64), np.zeros(self.n_leaves, np.int64), 0
        for n in range(len(self.leaf)):
            if of_node[n] < 0 and (self.leaf[n] >= 0 or rows[n] <= CHUNK_ROWS):
                of_node[n], n_cells = n_cells, n_cells + 1
            if self.leaf[n] >= 0:
                of_leaf[self.leaf[n]] = of_node[n]
            else:
                of_node[self.first[n] : self.first[n] + self.many[n]] = of_node[n]
        return of_leaf

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """All leaves, nearest opened first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
                continue
            a, b = self.first[node], self.first[node] + self.many[node]
            for d, child in zip(((self.centres[a:b] - query) ** 2).sum(axis=1).tolist(), range(a, b), strict=True):
                heapq.heappush(queue, (d, child))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b * b).sum(axis=1) - 2 * (a @ b.T)  # up to what is equal for all b


def _kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> list[np.ndarray]:
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        own = _squares(rows, centres).argmin(axis=1)
        centres = np.array([rows[own == j].mean(axis=0) for j in range(len(centres)) if (own == j).any()])
    own = _squares(rows, centres).argmin(axis=1)
    return [rows[own == j] for j in range(len(centres)) if (own == j).any()]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a finite vector that is not null or zero,
    of the most frequent length."""
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    out = out.filter("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    common = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return out.filter(F.size("v") == (common["n"] if common else 0))


def _nearest(ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, queries: np.ndarray, k: int, leaf: np.ndarray | None = None, opened: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its place, the places of its k nearest rows of other ids
    (one row an id, ties to smaller ids) and their distances.

    ``opened[i, leaf[j]]``: query i visits the leaf of row j. One matrix product
    a block of queries chooses rows, with room for its rounding; the distances
    and the order come from differences.
    """
    norms = (rows * rows).sum(axis=1)
    # so many rows hold k ids, however often an id repeats
    enough = k * int(np.unique(ids, return_counts=True)[1].max())
    for start in range(0, len(asked), BLOCK_QUERIES):
        block = queries[start : start + BLOCK_QUERIES]
        about = norms - 2 * (block @ rows.T)
        hidden = asked[start : start + BLOCK_QUERIES, None] == ids[None, :]
        if opened is not None:
            hidden |= ~opened[start : start + BLOCK_QUERIES][:, leaf]
        about[hidden] = np.inf
        edge = np.partition(about, enough - 1, axis=1)[:, enough - 1] if enough < len(ids) else np.full(len(block), np.inf)
        edge = edge + SLACK * (norms.max() + (block * block).sum(axis=1))
        for i, query in enumerate(block):
            near = np.flatnonzero(~(about[i] > edge[i]) & ~hidden[i])
            d = np.sqrt(((rows[near] - query) ** 2).sum(axis=1))
            order = np.lexsort((ids[near], d))
            order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])][:k]
            yield start + i, near[order], d[order]


_HIT = "query_id long, vec_id long, leaf long, score double"


def _hits(ids: np.ndarray, leaves: np.ndarray, asked: np.ndarray, found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    found = list(found)
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    place = join([near for _, near, _ in found], np.int64)
    queries = join([np.full(len(near), asked[i]) for i, near, _ in found], np.int64)
    return pa.table({"query_id": queries, "vec_id": ids[place], "leaf": leaves[place], "score": join([d for _, _, d in found], np.float64)})


def _top(hits: DataFrame, k: int) -> DataFrame:
    # one row for an id: rows of equal id count as one candidate, at its nearest
    hits = hits.groupBy("query_id", "vec_id").agg(F.min(F.struct("score", "leaf")).alias("s")).select("query_id", "vec_id", "s.score", "s.leaf")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Index:
    """A fitted tree and the table of all rows with their leaves."""

    def __init__(self, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS):
        spark = rows.sparkSession
        vectors = valid_vectors(rows, id_col, vector_col)
        n = vectors.count()
        share = min(1.0, fit_rows / max(n, 1))
        picked = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else vectors
        # at most fit_rows vectors reach the driver, whatever the table
        sample = picked.orderBy(F.xxhash64("id"), "v").limit(fit_rows).select("v").toArrow().column("v").combine_chunks()
        self.tree = Tree(_matrix(sample)) if len(sample) else None
        tree = self.tree
        shipped = spark.sparkContext.broadcast(tree)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = 0
            for batch in batches:
                leaves = shipped.value.assign(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int64)
                places = pa.array(np.arange(at, at := at + batch.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(leaves.astype(np.int64)), batch.column(0), batch.column(1), places], ["leaf", "id", "v", "place"])

        # the place within the task deals a leaf's rows to chunks evenly, whatever their ids and vectors
        self.rows = written(vectors.mapInArrow(run, "leaf long, id long, v array<double>, place long"), "leaves") if tree else vectors.select(F.lit(0).cast("long").alias("leaf"), "id", "v", F.lit(0).cast("long").alias("place"))
        counted = self.rows.groupBy("leaf").count().collect()  # a row for each leaf of the tree
        self.counts = np.zeros(tree.n_leaves if tree else 0, np.int64)
        for r in counted:
            self.counts[r["leaf"]] = r["count"]

    def exact(self, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
        """Exact neighbours of a few queries, over all rows in batches."""
        shipped = self.rows.sparkSession.sparkContext.broadcast((np.array([i for i, _ in queries], np.int64), np.array([v for _, v in queries], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ids, asked = batch.column(1).to_numpy(), shipped.value[0]
                    yield from _hits(ids, batch.column(0).to_numpy(), asked, _nearest(ids, _matrix(batch.column(2)), *shipped.value, k)).to_batches()

        return _top(self.rows.select("leaf", "id", "v").mapInArrow(run, _HIT), k)

    def calibrate(self, queries: DataFrame, k: int, target: float) -> tuple[int, float]:
        """Leaves to visit for the target recall, and the recall they give, from up to CALIBRATION of ``queries`` (id, v)."""
        some = [(r["id"], r["v"]) for r in queries.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).collect()]
        if not some:
            return 1, 1.0
        ranks = {}
        for q, v in some:
            place = np.empty(self.tree.n_leaves, np.int64)
            place[np.fromiter(self.tree.best_bins(np.array(v)), np.int64)] = np.arange(self.tree.n_leaves)
            ranks[q] = place
        needed = np.sort([ranks[r["query_id"]][r["leaf"]] for r in self.exact(some, k).collect()])
        if not len(needed):
            return 1, 1.0
        visits = 1
        while np.searchsorted(needed, visits) < target * len(needed):
            visits = min(self.tree.n_leaves, max(visits + 1, int(visits * 1.05)))
        return int(visits), float(np.searchsorted(needed, visits) / len(needed))

    def search(self, queries: DataFrame, k: int = 10, target: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """query_id, rank, vec_id, score, leaves visited, recall: each query's k nearest found.

        ``recall`` is the calibration queries' mean at the visits chosen.
        Euclidean distance in double precision; ties to the smaller id; a row
        of the query's own id is no candidate. Null, zero, non-finite vectors
        and those of another length than the table's most frequent take no
        part on either side; nor do null ids. Rows of equal id are one
        candidate. Queries of equal id count once, with the smaller vector.
        """
        spark = queries.sparkSession
        if self.tree is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visited long, recall double")
        asked = valid_vectors(queries, id_col, vector_col).filter(F.size("v") == self.tree.centres.shape[1])
        asked = written(asked.groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
        visits, recall = self.calibrate(asked, k, target)
        cells = self.tree.cells(self.counts)
        shipped = spark.sparkContext.broadcast((self.tree, self.counts, cells))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, counts, cells = shipped.value
            for batch in batches:
                at, cell, leaves, visited = [], [], [], []
                for i, v in enumerate(_matrix(batch.column(1))):
                    own, rows = [], 0
                    for leaf in tree.best_bins(v):
                        own.append(leaf)
                        rows += counts[leaf]
                        if len(own) >= visits and rows > k:
                            break
                    own = np.array(own)
                    own = own[counts[own] > 0]
                    for c in np.unique(cells[own]):
                        at.append(i)
                        cell.append(c)
                        leaves.append(own[cells[own] == c].astype(np.int32))
                        visited.append(len(own))
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(leaves, pa.list_(pa.int32())), pa.array(visited, pa.int64())], ["cell", "query_id", "q", "leaves", "visited"])

        visits_of = written(asked.repartition(spark.sparkContext.defaultParallelism, "id").mapInArrow(visit, "cell long, query_id long, q array<double>, leaves array<int>, visited long"), "ann-visits")
        popular = {r["cell"]: r["count"] for r in visits_of.groupBy("cell").count().collect()}  # a row for each cell
        held = np.bincount(cells, weights=self.counts)
        chunks = [(c, max(1, -(-int(n) // CHUNK_ROWS)), max(1, -(-popular.get(c, 0) // CHUNK_QUERIES))) for c, n in enumerate(held)]
        # a row for each leaf of the tree, whose size the sample bounds
        sizes = spark.createDataFrame(chunks, "cell long, nr int, nq int")
        of_leaf = F.broadcast(spark.createDataFrame(list(enumerate(cells.tolist())), "leaf long, cell long").join(sizes, "cell"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.rows.join(of_leaf, "leaf").withColumn("r", F.pmod("place", F.col("nr")).cast("int")).withColumn("c", every("nq")).drop("nr", "nq", "place")
        right = visits_of.join(F.broadcast(sizes), "cell").withColumn("c", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int")).withColumn("r", every("nr")).drop("nr", "nq", "visited")

        def scan(rows: pa.Table, asked: pa.Table) -> pa.Table:
            ids, leaf, queries = rows.column("id").to_numpy(), rows.column("leaf").to_numpy(), asked.column("query_id").to_numpy()
            if not len(ids) or not len(queries):
                return _hits(ids, leaf, queries, iter(()))
            local, at = np.unique(leaf, return_inverse=True)
            # which of the cell's leaves each query visits; a leaf may have no row in this chunk
            lists = asked.column("leaves").combine_chunks()
            flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(queries)), lists.value_lengths().to_numpy())
            known = np.isin(flat, local)
            opened = np.zeros((len(queries), len(local)), bool)
            opened[owner[known], np.searchsorted(local, flat[known])] = True
            return _hits(ids, leaf, queries, _nearest(ids, _matrix(rows.column("v").combine_chunks()), queries, _matrix(asked.column("q").combine_chunks()), k, at, opened))

        hits = left.groupBy("cell", "r", "c").cogroup(right.groupBy("cell", "r", "c")).applyInArrow(scan, _HIT)
        visited = visits_of.select("query_id", "visited").distinct()
        return _top(hits, k).join(visited, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "visited", F.lit(recall).alias("recall"))
