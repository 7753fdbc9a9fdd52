"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that
is itself a token with one probe and one comparison. Tier two: a miss is merged
bottom up, as a linked list of byte symbols with a heap of ranked neighbour
pairs; stale heap entries are recognised and skipped.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, ragged, utf8
from .memo import PieceMemo, per_document
from .storage import lean


class PerfectHash:
    """Hash-and-displace minimal perfect hash: n keys fill n slots exactly.

    Keys are spread over small buckets; each bucket, largest first, gets the
    first displacement that puts all its keys into free slots.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = len(keys)
        self.n, self.n_buckets = n, max(1, -(-n // per_bucket))
        self.shifts = [0] * self.n_buckets
        self.slots: list[int] = [-1] * n
        grouped: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            grouped.setdefault(h % self.n_buckets, []).append((h, i))
        for bucket, members in sorted(grouped.items(), key=lambda kv: -len(kv[1])):
            shift = 0
            while True:
                places = [self._slot(h, shift) for h, _ in members]
                if len(set(places)) == len(places) and all(self.slots[p] < 0 for p in places):
                    break
                shift += 1
                if shift > 64 * n + 1024:
                    raise ValueError("two keys have the same hash")
            self.shifts[bucket] = shift
            for (_, i), p in zip(members, places, strict=True):
                self.slots[p] = i
        self.keys = keys

    def _slot(self, h: int, shift: int) -> int:
        h = (h ^ (shift * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        h = (h ^ (h >> 31)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return (h ^ (h >> 32)) % self.n

    def find(self, key: bytes) -> int:
        """The index of ``key`` among the keys, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        i = self.slots[self._slot(h, self.shifts[h % self.n_buckets])]
        return i if self.keys[i] == key else -1


class ByteBpe:
    """``ranks``: token bytes -> id, lower ids merge first; single bytes included."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        keys = list(ranks)
        self.key_ids = [ranks[k] for k in keys]
        self.whole = PerfectHash(keys)
        self.pattern = pattern
        self.byte_ids = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.byte_ids) < 0:
            raise ValueError("the vocabulary lacks single bytes")

    def prepared(self) -> ByteBpe:
        """Adds what a worker derives for itself: the pair table and the regex."""
        if not hasattr(self, "pairs"):
            known = {t: i for i, t in enumerate(self.tokens) if t}
            pairs: dict[int, int] = {}
            for token, i in known.items():
                for cut in range(1, len(token)):
                    left, right = known.get(token[:cut]), known.get(token[cut:])
                    if left is not None and right is not None:
                        pairs[left << 24 | right] = i
            self.pairs = pairs
            self.split = regex.compile(self.pattern).findall
            sizes = np.array([len(t) for t in self.tokens], np.int64)
            self.sizes, self.places = sizes, np.concatenate(([0], np.cumsum(sizes)))[:-1]
            self.letters = np.frombuffer(b"".join(self.tokens), np.uint8)
        return self

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        found = self.whole.find(raw)
        return [self.key_ids[found]] if found >= 0 else self.merge(raw)

    def merge(self, raw: bytes) -> list[int]:
        """The ids of a pre-token that is no token, lowest rank and leftmost first."""
        ids = [self.byte_ids[b] for b in raw]
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 24 | ids[i + 1])
            if rank is not None:
                heap.append((rank, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pairs.get(rank << 24 | ids[k])
                if new is not None:
                    heapq.heappush(heap, (new, i, rank, ids[k]))
            h = before[i]
            if h >= 0:
                new = pairs.get(ids[h] << 24 | rank)
                if new is not None:
                    heapq.heappush(heap, (new, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one gather over the vocabulary's bytes."""
        return self.letters[ragged(self.places[ids], self.sizes[ids])]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_ready: dict[str, tuple[ByteBpe, PieceMemo]] = {}


def _worker(bpe_broadcast, key: str) -> tuple[ByteBpe, PieceMemo]:
    """One prepared codec and memo for each worker process and vocabulary."""
    if key not in _ready:
        _ready.clear()
        bpe = bpe_broadcast.value.prepared()
        _ready[key] = bpe, PieceMemo(bpe.encode_piece)
    return _ready[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Token ids of every whole text, and the bytes they decode to.

    Returns ``id_col`` (as given), ids (binary, little-endian unsigned 32 bit;
    left out unless ``keep_ids``), n_tokens, ids_sha256, decoded_sha256 and
    round_trip (the decoded bytes are the text's). A null text counts as empty:
    no ids. Null or repeated ids pass through, a row each; other columns are
    not read. One pass, no shuffle; a text of any length is one block.
    """
    spark = docs.sparkSession
    lean(spark)
    codec = ByteBpe(load_ranks(ranks_path), pattern)
    shipped, key = spark.sparkContext.broadcast(codec), f"{ranks_path}|{pattern}"
    # the broadcast is of the vocabulary's size, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo = _worker(shipped, key)
        for block in blocks(batches, "text"):
            memo.trim()
            offsets, body = utf8(block.column(1))
            texts = [t or "" for t in block.column(1).to_pylist()]
            pieces: list[str] = []
            counts = []
            for text in texts:
                found = bpe.split(text)
                pieces += found
                counts.append(len(found))
            ids, lengths = memo.flat(pieces)
            ends = per_document(lengths, counts)
            decoded = bpe.decode(ids)
            token_bytes = np.concatenate(([0], np.cumsum(bpe.sizes[ids])))
            cuts = token_bytes[ends]
            raw, plain = ids.astype("<u4").view(np.uint8), memoryview(np.ascontiguousarray(decoded))
            parts = [memoryview(raw)[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]
            back = [plain[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            original = memoryview(np.ascontiguousarray(body))
            columns = {
                "id": block.column(0),
                "ids": pa.array([bytes(p) for p in parts], pa.binary()) if keep_ids else None,
                "n_tokens": pa.array(np.diff(ends)),
                "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in back], pa.string()),
                "round_trip": pa.array([p == original[a:b] for p, a, b in zip(back, offsets, offsets[1:], strict=False)], pa.bool_()),
            }
            yield pa.RecordBatch.from_pydict({k: v for k, v in columns.items() if v is not None})

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, " + "ids binary, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
