"""Similarity self-join of n-gram sets by PartEnum signatures.

Features are the hashes of ``words``-word shingles. Sets whose sizes fall into
one band (the smaller size in [2^c, 2^(c+1))) meet in one instance, in which the
hash domain is cut into n parts. Two sets within the threshold differ in at most
k features, so at most k parts differ; a set with more than k non-empty parts
therefore shares the projection onto one of them with each of its partners.
Each non-empty part is a signature (here every subset enumerated is a single
part: with k near a third of the set, larger subsets cost more signatures than
features). Sets that land in too few parts also emit each feature, which any
partner shares. So every linked pair shares a signature.

Plan. (1) Per row a digest of its set: equal sets are one class from then on.
(2) Workers emit signatures of blocks of documents, one copy of each class,
packed by hash buckets; each band has buckets of its own, in number by its
volume, so a class's heads stay few. (3) A bucket finds the classes of each
signature. Up to ``FEW`` of them: all pairs, counted; a linked pair must share
at least max(parts of either) - k parts, which removes pairs that merely share a
passage. More: the signature is hot, and its members are kept as rows. A class
with more than k parts that are not hot has its pairs found there; the others
share at least parts - k hot signatures with any partner not found yet, so the
rarest hot - (parts - k) + 1 of each meet. (4) Candidate pairs are verified
exactly on the sets: first one partner for each class (for hot members a pivot
and a few more), then whatever pairs the resulting components leave open.
(5) Members of a hot signature that still lie in different components are
compared in chunks, first by their lists of hot signatures: each pair where both
meet first, by the count bound. Only classes with a partner within that bound
ship their sets, in runs of bounded size, to be compared exactly. Components
larger than a chunk have chunks of their own, which are never compared with one
another. Links within a component are never expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACES, blocks, longs, mixed, pack, ragged, runs, slices_by, unpack, utf8, window_hashes, word_hashes, word_spans
from .graph import components
from .storage import discard, lean, release, written

FEW, CHUNK, SLACK, TRIES, SALTS = 24, 1000, 1.35, 4, 16
#: Signatures of a bucket, and features of a run of sets that are compared at once.
BUCKET, RUN = 2_000_000, 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def sets_of(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, counts, digests): each text's distinct shingle hashes, ascending."""
    offsets, body = utf8(texts)
    body = _LOWER[body]
    starts, ends, firsts = word_spans(offsets, body, SPACES)
    h = word_hashes(body, starts, ends)
    n_words = np.diff(firsts)
    counts = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    features = np.zeros(int(counts.sum()), _U)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    full = n_words >= words
    if full.any():
        place = ragged(bounds[:-1][full], counts[full])
        features[place] = window_hashes(h, words)[ragged(firsts[:-1][full], counts[full])]
    for d in np.flatnonzero((n_words > 0) & ~full):
        whole = window_hashes(h[firsts[d] : firsts[d + 1]], int(n_words[d]))
        features[bounds[d]] = mixed(whole + _U(n_words[d]))[0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        features[a:b].sort()
    doc = np.repeat(np.arange(len(counts)), counts)
    features = features[first := runs(doc, features)]
    return features, np.bincount(doc[first], minlength=len(counts)), doc[first]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def digests(features: np.ndarray, counts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set, as int64."""
    a = mixed(_sums(mixed(features + _U(2 * seed + 1)), counts) + counts.astype(_U))
    b = _sums(mixed(features ^ _U(0xA5A5A5A5A5A5A5A5)), counts)
    return a.view(np.int64), b.view(np.int64)


def _summaries(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            features, counts, _ = sets_of(block.column(1), words)
            cls, other = digests(features, counts, seed)
            yield pa.RecordBatch.from_pydict({"id": block.column(0), "hash": block.column(2), "n": counts.astype(np.int64), "cls": cls, "other": other})

    return run


class Bands:
    """Sizes, instances and bounds for a threshold of ``percent`` (over 50)."""

    def __init__(self, percent: int):
        if not 50 < percent <= 100:
            raise ValueError("the threshold is a percentage over 50, at most 100")
        self.percent = percent

    def differing(self, total):
        """Most features in which two linked sets differ, by the sum of their sizes."""
        return (100 - self.percent) * total // (100 + self.percent)

    def common(self, total):
        """Fewest features that two linked sets share, by the sum of their sizes."""
        return -(-self.percent * total // (100 + self.percent))

    def most(self, size):
        """The same for one set and any partner."""
        return (100 - self.percent) * size // self.percent

    def parts(self, c: np.ndarray) -> np.ndarray:
        k = self.most((1 << (c + 1)) - 1)
        return np.where(k > 0, np.ceil(SLACK * k) + 1, 1).astype(np.int64)

    def instances(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """[(which sets, their c)]: as the smaller partner, then as the larger."""
        c = np.frexp(sizes)[1].astype(np.int64) - 1
        larger = (c > 0) & (sizes * self.percent <= 100 * ((1 << np.maximum(c, 0)) - 1))
        return [(np.flatnonzero(sizes > 0), c[sizes > 0]), (np.flatnonzero(larger), c[larger] - 1)]


ELEMENTS = 255


def signatures(features: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, instance, occupied parts of that set there), one row each."""
    bounds = np.concatenate(([0], np.cumsum(counts)))
    out, low = [], np.zeros(len(counts), bool)
    for which, c in bands.instances(counts):
        if not len(which):
            continue
        sizes, n = counts[which], bands.parts(c)
        own = features[ragged(bounds[:-1][which], sizes)]
        row = np.repeat(np.arange(len(which)), sizes)
        # multiply-shift keeps the order of the hashes, so a part is one run
        part = ((own >> _U(32)) * n[row].astype(_U)) >> _U(32)
        first = runs(row, part)
        size = np.diff(np.append(first, len(own)))
        sig = mixed(_sums(mixed(own), size) + mixed(part[first] * _U(64) + c[row[first]].astype(_U) + _U(1)))
        occupied = np.bincount(row[first], minlength=len(which))
        low[which] |= occupied <= bands.most(sizes)
        out.append((sig, which[row[first]], c[row[first]], occupied[row[first]]))
    thin = np.flatnonzero(low)
    if len(thin):
        own = features[ragged(bounds[:-1][thin], counts[thin])]
        row = np.repeat(thin, counts[thin])
        out.append((mixed(own ^ _U(0x5BD1E9955BD1E995)), row, np.full(len(row), ELEMENTS), np.ones(len(row), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (_U, np.int64, np.int64, np.int64))


def dealt(sizes: dict[int, int], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(first bucket, number of buckets) of each instance. ``sizes``: how many sets have a size in [2^c, 2^(c+1))."""
    load = np.zeros(ELEMENTS + 1)
    for c, n in sizes.items():
        load[c] += n * float(bands.parts(np.array(c)))
        load[max(c - 1, 0)] += n * float(bands.parts(np.array(max(c - 1, 0)))) / 2  # as larger partners
        if c < 8:  # larger sets hardly ever lie in too few parts
            load[ELEMENTS] += n * 2.0 ** (c + 1)
    number = np.maximum(1, np.ceil(load / BUCKET)).astype(np.int64)
    return np.cumsum(number) - number, number


def _emit(words: int, percent: int, seed: int, first: np.ndarray, number: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, n_buckets = Bands(percent), int(number.sum())
        for block in blocks(batches, "text"):
            features, counts, _ = sets_of(block.column(0), words)
            cls, _ = digests(features, counts, seed)
            _, keep = np.unique(cls, return_index=True)
            keep = keep[counts[keep] > 0]
            bounds = np.concatenate(([0], np.cumsum(counts)))
            features, cls, counts = features[ragged(bounds[:-1][keep], counts[keep])], cls[keep], counts[keep]
            sig, row, inst, occupied = signatures(features, counts, bands)
            bucket = first[inst] + ((sig >> _U(32)) % number[inst].astype(_U)).astype(np.int64)
            order, cuts = slices_by(bucket, n_buckets)
            full = np.flatnonzero(np.diff(cuts))
            blobs = []
            for b in full:
                own = order[cuts[b] : cuts[b + 1]]
                start = runs(row[own])
                head = own[start]
                size = np.diff(np.append(start, len(own))).astype(np.uint32)
                blobs.append(pack(cls[row[head]], counts[row[head]].astype(np.uint32), occupied[head].astype(np.uint32), size, sig[own].astype(np.uint32)))
            if len(full):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full.astype(np.int32)), "blob": pa.array(blobs, pa.binary())})

    return run


def _pairs_of(group: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the groups of up to FEW members; ``group``: their starts among n rows."""
    size = np.diff(np.append(group, n))
    for m in range(2, FEW + 1):
        at = group[size == m]
        if len(at):
            i, j = np.triu_indices(m, 1)
            yield (at[:, None] + i).ravel(), (at[:, None] + j).ravel()


def _meet(percent: int, first_bucket: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        bands = Bands(percent)
        bucket = table.column("bucket")[0].as_py()
        inst = int(np.searchsorted(first_bucket, bucket, "right")) - 1
        heads = [unpack(blob.as_buffer().to_pybytes(), np.int64, np.uint32, np.uint32, np.uint32, np.uint32) for blob in table.column("blob")]
        cls, n, occupied, size, sig = (np.concatenate(x) for x in zip(*heads, strict=True))
        del heads
        row = np.repeat(np.arange(len(cls), dtype=np.int32), size.astype(np.int64))
        once = np.zeros(len(cls), bool)  # copies of a class from several blocks
        once[np.unique(cls, return_index=True)[1]] = True
        sig, row = sig[once[row]], row[once[row]]
        order = np.argsort(sig, kind="stable")
        same = sig[order[1:]] == sig[order[:-1]]
        own = order[np.append(same, False) | np.insert(same, 0, False)] if len(same) else order[:0]
        sig, row = sig[own], row[own]
        # two signatures of one class may agree in the bits kept: both stay, counts are never too low
        order = np.lexsort((cls[row], sig))
        sig, row = sig[order], row[order]
        group = runs(sig)
        size = np.diff(np.append(group, len(sig)))
        many = np.repeat(size > FEW, size)
        a, b, need = [], [], []
        for i, j in _pairs_of(group, len(sig)):
            x, y = row[i], row[j]
            small, large = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y]).astype(np.int64)
            fits = (x != y) & (large * percent <= 100 * small)
            if inst != ELEMENTS:
                fits &= np.frexp(small)[1] - 1 == inst
            x, y, both = x[fits], y[fits], (small + large)[fits]
            a.append(cls[x])
            b.append(cls[y])
            need.append(bands.common(both) if inst == ELEMENTS else np.maximum(occupied[x], occupied[y]).astype(np.int64) - bands.differing(both))
        a, b, need = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, need))
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        start = runs(a, b)
        hot = row[many]
        none = np.zeros(len(hot), np.int64)
        pair = np.arange(len(start) + len(hot)) < len(start)
        column = lambda x, y, given=None: pa.array(np.concatenate((x, y)).astype(np.int64), mask=None if given is None else ~given)
        zero = np.zeros(len(start), np.int64)
        return pa.table(
            {
                "a": column(a[start], cls[hot]),
                "b": column(b[start], none, pair),
                "shared": column(np.diff(np.append(start, len(a))), none, pair),
                "need": column(need[start], none, pair),
                "sig": column(zero, bucket << 32 | sig[many].astype(np.int64), ~pair),
                "inst": column(zero + inst, none + inst),
                "n": column(zero, n[hot], ~pair),
                "occupied": column(zero, occupied[hot], ~pair),
            }
        )

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            ok = [linked(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), percent) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _sets(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            features, counts, _ = sets_of(block.column(0), words)
            cls, _ = digests(features, counts, seed)
            bounds = np.concatenate(([0], np.cumsum(counts)))
            yield pa.RecordBatch.from_pydict({"cls": cls, "features": pa.array([features[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())})

    return run


def _products(owner: np.ndarray, place: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """For each two of n owners the sum of products of ``times`` over the places they share (in slabs of places)."""
    both = np.zeros((n, n), np.float32)
    if not len(place):
        return both
    order = np.argsort(place, kind="stable")
    owner, times = owner[order], times[order]
    place = np.cumsum(np.diff(place[order], prepend=place[order[0]]) > 0)
    for low in range(0, int(place[-1]) + 1, 1024):
        a, b = np.searchsorted(place, [low, low + 1024])
        has = np.zeros((n, 1024), np.float32)
        np.add.at(has, (owner[a:b], place[a:b] - low), times[a:b])
        for r in range(0, n, 512):
            both[r : r + 512] += has[r : r + 512] @ has.T
    return both


def _near(percent: int):
    """Of two chunks of a hot signature's members, those with a partner in another
    component that the count of shared hot signatures leaves possible, in runs
    of bounded size. A pair counts at the smallest signature where both meet."""

    def run(table: pa.Table) -> pa.Table:
        bands = Bands(percent)
        key = {c: table.column(c)[0].as_py() for c in ("sig", "c1", "c2")}
        inst = table.column("inst")[0].as_py()
        cls, comp, n, occupied, side, prefix = (longs(table.column(c).combine_chunks()) for c in ("cls", "comp", "n", "occupied", "side", "prefix"))
        lists = table.column("sigs").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        values = longs(lists.flatten())
        owner = np.repeat(np.arange(len(cls)), sizes)
        at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        _, place, often = np.unique(values, return_inverse=True, return_counts=True)
        many, ones = often[place] > 1, np.ones(len(values), np.float32)
        shared = _products(owner[many], place[many], ones[many], len(cls))
        earlier = many & (at < prefix[owner]) & (values < key["sig"])
        near = _products(owner[earlier], place[earlier], ones[earlier], len(cls)) == 0
        for x in range(len(cls)):
            small, total = np.minimum(n, n[x]), n + n[x]
            need = bands.common(total) if inst == ELEMENTS else np.maximum(occupied, occupied[x]) - bands.differing(total)
            fits = (shared[x] >= need) & (np.maximum(n, n[x]) * percent <= 100 * small) & (comp != comp[x]) & ((side != side[x]) | (side == 2))
            near[x] &= fits if inst == ELEMENTS else fits & (np.frexp(small)[1] - 1 == inst)
        asked = np.flatnonzero(near.any(axis=1))
        asked = asked[np.lexsort((cls[asked], comp[asked]))]
        part = (np.cumsum(n[asked]) // RUN).astype(np.int64)
        out: dict[str, list] = {c: [] for c in ("r1", "r2", "side", "cls", "comp")}
        parts = [asked[part == r] for r in np.unique(part)]
        for i, left in enumerate(parts):
            for j, right in enumerate(parts[i:], i):
                met = near[np.ix_(left, right)]
                rows = [(left[met.any(axis=1)], 2 if i == j else 0)] + ([(right[met.any(axis=0)], 1)] if i != j else [])
                for own, where in rows:
                    for c, v in (("r1", i), ("r2", j), ("side", where)):
                        out[c].append(np.full(len(own), v, np.int64))
                    out["cls"].append(cls[own])
                    out["comp"].append(comp[own])
        flat = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}
        return pa.table({**{c: pa.array([v] * len(flat["cls"]), pa.int64()) for c, v in key.items()}, **flat})

    return run


def _across(percent: int):
    """Links across components within two runs of sets: as many as join what is
    linked, compared on the whole sets."""

    def run(table: pa.Table) -> pa.Table:
        cls, comp, side = (longs(table.column(c).combine_chunks()) for c in ("cls", "comp", "side"))
        sets = [np.frombuffer(x.as_buffer(), _U) for x in table.column("features")]
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner, place = owner[times[place] > 1], place[times[place] > 1]
        both = _products(owner, place, np.ones(len(owner), np.float32), len(sets))
        del owner, place, times
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        a, b = [], []
        for x in range(len(sets)):
            shared = both[x].astype(np.float64)
            near = (100 * shared >= percent * (sizes[x] + sizes - shared)) & (comp != comp[x]) & ((side != side[x]) | (side == 2))
            for y in np.flatnonzero(near[:x]).tolist():
                p, q = find(int(comp[x])), find(int(comp[y]))
                if p != q:
                    root[p] = q
                    a.append(int(cls[x]))
                    b.append(int(cls[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _salted(rows: DataFrame, by: str, table: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key`` of many rows a key with a row a key: the rows of a hot key are dealt by ``by``."""
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [key, "_salt"]).drop("_salt")


def _chunked(rows: DataFrame) -> DataFrame:
    """Members of hot signatures that hold several components, a row for each
    two chunks (c1 <= c2) to compare; ``side`` tells the chunk, 2 if both are one."""
    per = rows.groupBy("sig", "comp").agg(F.count("*").alias("m"))
    big = F.col("m") * 4 > CHUNK
    chunks = F.ceil(F.col("m") / CHUNK)
    sigs = per.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(F.coalesce(F.sum(F.when(~big, F.col("m"))), F.lit(0)) / CHUNK).alias("small"), F.array_sort(F.collect_list(F.when(big, F.struct("comp", chunks.alias("k"))))).alias("big"))
    sigs = sigs.filter("x <> y").drop("x", "y")
    # chunks 0..small-1 hold small components; then each big one has its own
    low = "transform(big, (b, i) -> struct(b.comp as comp, b.k as k, small + aggregate(slice(big, 1, i), 0L, (s, o) -> s + o.k) as low))"
    sigs = sigs.withColumn("big", F.expr(low)).withColumn("total", F.expr("small + aggregate(big, 0L, (s, o) -> s + o.k)"))
    placed = _salted(rows, "cls", sigs, "sig").withColumn("home", F.expr("get(filter(big, b -> b.comp = comp), 0)"))
    placed = placed.withColumn("own", F.coalesce(F.expr("home.low + pmod(xxhash64(cls), home.k)"), F.expr("pmod(xxhash64(comp), small)")))
    placed = placed.withColumn("other", F.explode(F.expr("filter(sequence(0L, total - 1), j -> home is null or j < home.low or j >= home.low + home.k)")))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("long")
    return placed.withColumns({"c1": F.least("own", "other"), "c2": F.greatest("own", "other"), "side": side}).drop("big", "small", "total", "home", "own", "other")


def _labelled(nodes: DataFrame, column: str, comps: DataFrame, name: str) -> DataFrame:
    found = comps.select(F.col("node").alias(column), F.col("component").alias("_c"))
    return nodes.join(found, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, keys: bool = False) -> DataFrame:
    """Components under "Jaccard similarity of shingle sets is at least percent/100".

    Words: A-Z lower-cased, maximal runs of bytes other than space and 09-0D. A
    set: the distinct ``words``-word shingles; of fewer words, the whole
    sequence as one; none for null or empty texts, which link with nothing.
    Returns a row for each input row: ``id_col``, n_shingles, component_id (the
    smallest id reachable by links; own id if none). A null id is smaller than
    all others, and a component_id is null if that row is the smallest. Rows of
    equal id are separate sets. Other columns are not read; an empty table
    gives no rows. Features are 64-bit hashes; links are decided on whole sets.
    ``keys`` adds what tells rows of equal id apart: text_hash (xxhash64 of the
    text as string) and group_id (one long a component; null without a set).
    """
    spark = docs.sparkSession
    lean(spark)
    bands = Bands(percent)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))

    for seed in range(8):
        made = written(rows.select("id", "text", "hash").mapInArrow(_summaries(words, seed), "id long, hash long, n long, cls long, other long"), "set-digests")
        classes = made.filter("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.max("n").alias("n2"), F.min("other").alias("o"), F.max("other").alias("o2"))
        if classes.filter("n <> n2 or o <> o2").isEmpty():
            break  # no two different sets share a digest
    else:
        raise RuntimeError("set digests collide under every seed")

    # at most 64 rows
    sizes = {r["c"]: r["m"] for r in made.filter("n > 0").groupBy((F.length(F.bin("n")) - 1).alias("c")).agg(F.count("*").alias("m")).collect()}
    first, number = dealt(sizes, bands)
    met = rows.select("text").mapInArrow(_emit(words, percent, seed, first, number), "bucket int, blob binary").groupBy("bucket").applyInArrow(_meet(percent, first), "a long, b long, shared long, need long, sig long, inst long, n long, occupied long")
    met = written(met, "set-pairs")
    release(spark)

    hot = met.filter("sig is not null").groupBy(F.col("a").alias("cls"), "inst", "n", "occupied").agg(F.collect_list("sig").alias("sigs"))
    hot = written(hot.withColumn("hot", F.size("sigs")), "hot-members")
    heat = hot.groupBy("cls", "inst").agg(F.max("hot").alias("hot"))
    pairs = met.filter("b is not null").groupBy("a", "b", "inst").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))
    if hot.isEmpty():
        pairs = pairs.withColumns({"ha": F.lit(0), "hb": F.lit(0)})
    else:
        pairs = pairs.join(heat.select(F.col("cls").alias("a"), "inst", F.col("hot").alias("ha")), ["a", "inst"], "left")
        pairs = pairs.join(heat.select(F.col("cls").alias("b"), "inst", F.col("hot").alias("hb")), ["b", "inst"], "left")
    pairs = pairs.filter(F.col("shared") >= F.col("need") - F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))))
    pairs = written(pairs.select("a", "b").distinct(), "candidates")
    discard(met)

    # a pair that only hot signatures hold shares ``least`` of them, so members meet in their ``prefix`` rarest
    least = F.when(F.col("inst") == ELEMENTS, F.ceil(percent * F.col("n") / 100)).otherwise(F.greatest(F.lit(1), F.col("occupied") - F.floor((100 - percent) * F.col("n") / percent)))
    risky = hot.withColumn("least", least).filter("hot >= least")
    each = risky.select("cls", "inst", "n", "occupied", (F.col("hot") - F.col("least") + 1).alias("prefix"), F.explode("sigs").alias("sig"))
    # of each hot signature: how often, its smallest member, and some others
    others = [F.min_by("cls", F.xxhash64("cls", "sig", F.lit(r))) for r in range(3)]
    stats = each.groupBy("sig").agg(F.count("*").alias("often"), F.array(F.min("cls"), *others).alias("pivots"))
    ranked = _salted(each, "cls", stats, "sig").groupBy("cls", "inst", "n", "occupied", "prefix").agg(F.array_sort(F.collect_list(F.struct("often", "sig", "pivots"))).alias("order"))
    held = written(ranked, "hot-prefixes")

    # some partners for each class: its smallest candidate; of its hot signatures the most common
    # smallest member, and a few others
    met_in = held.select("cls", F.explode(F.slice("order", F.lit(1), F.col("prefix").cast("int"))).alias("o")).select("cls", "o.pivots")
    by_class = met_in.groupBy("cls").agg(F.mode(F.col("pivots")[0], True).alias("most"), F.slice(F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list(F.slice("pivots", 2, 3)))), lambda p: F.struct(F.xxhash64(p, F.lit(7)).alias("h"), p.alias("p")))), 1, TRIES).alias("some"))
    pivots = by_class.select(F.col("cls").alias("b"), F.explode(F.array_union(F.array("most"), F.col("some.p"))).alias("a")).filter("a <> b")
    tried = pairs.groupBy("b").agg(F.min("a").alias("a")).select("b", "a").union(pivots).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = written(tried, "first-pairs")

    def sets_for(wanted: DataFrame, what: str) -> DataFrame:
        """The sets of some classes, from their representatives' texts."""
        ids = classes.join(wanted.distinct(), "cls", "left_semi").select(F.col("rep").alias("id"))
        return written(rows.join(ids, "id", "left_semi").select("text").mapInArrow(_sets(words, seed), "cls long, features binary"), what)

    def ends(some: DataFrame) -> DataFrame:
        return some.select(F.col("a").alias("cls")).union(some.select("b"))

    def verified(some: DataFrame, sets: DataFrame) -> DataFrame:
        # the side that repeats (pivots) comes last, when rows are heavy enough for skew joins to split
        with_b = some.join(sets.select(F.col("cls").alias("b"), F.col("features").alias("fb")), "b")
        both = with_b.join(sets.select(F.col("cls").alias("a"), F.col("features").alias("fa")), "a")
        return both.select("a", "b", "fa", "fb").mapInArrow(_verify(percent), "a long, b long")

    sets = sets_for(ends(tried), "candidate-sets")
    links = written(verified(tried, sets), "links")
    discard(sets)
    release(spark)
    comps = components(links)

    # what is left: candidate pairs in two components, and hot signatures that hold several
    open_ = written(_labelled(_labelled(pairs, "a", comps, "ca"), "b", comps, "cb").filter("ca <> cb").select("a", "b"), "open-pairs")
    members = held.select("cls", "inst", "n", "occupied", "prefix", F.col("order.sig").alias("sigs"))
    members = _labelled(members, "cls", comps, "comp").withColumn("sig", F.explode(F.array_distinct(F.slice("sigs", F.lit(1), F.col("prefix").cast("int")))))
    near = _chunked(members).groupBy("sig", "c1", "c2").applyInArrow(_near(percent), "sig long, c1 long, c2 long, r1 long, r2 long, side long, cls long, comp long")
    near = written(near, "near-members")
    sets = sets_for(ends(open_).union(near.select("cls")), "open-sets")
    more = verified(open_, sets).union(near.join(sets, "cls").groupBy("sig", "c1", "c2", "r1", "r2").applyInArrow(_across(percent), "a long, b long"))
    more = written(more, "links")
    comps = comps if more.isEmpty() else components(links.union(more))
    discard(hot, pairs, held, tried, open_, near, sets)
    release(spark)

    labels = _labelled(classes.select("cls", "rep"), "cls", comps, "comp")
    smallest = labels.groupBy("comp").agg(F.min("rep").alias("component_id"))
    labels = labels.join(smallest, "comp").select("cls", "component_id", F.col("comp").alias("group_id"))
    out = made.join(labels, (made["cls"] == labels["cls"]) & (made["n"] > 0), "left").drop(labels["cls"])
    null = lambda c: F.nullif(c, F.lit(-(1 << 63)))
    return out.select(null(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), null(F.coalesce("component_id", "id")).alias("component_id"), *([F.col("hash").alias("text_hash"), "group_id"] if keys else []))
