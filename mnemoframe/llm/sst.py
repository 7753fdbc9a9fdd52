"""Token ids in sorted-string-table shards, and reading them back.

File: data blocks, Bloom filter, block index, footer. A data block holds
entries in key order: each key is cut to what differs from its predecessor
(whole at every ``RESTART``-th entry, whose offsets close the block, so that a
block is searched by bisection), followed by the ids, little-endian, two bytes
each if the vocabulary allows it, else four. Blocks are zstd-compressed. The
sparse index has each block's first key, offset and size; the footer says where
index and filter are and how many documents and ids the shard has.

A key is the document id in order-preserving big-endian form (null first) and
a counter that keeps rows of equal id apart.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import blocks
from .files import new_file, read_at
from .memo import PieceMemo, per_document
from .storage import fresh_dir, lean, written

MAGIC = b"MFSST001"
FOOTER = struct.Struct("<QQQQQQB8s")
RESTART, BLOCK, BITS_PER_KEY, PROBES = 16, 256 << 10, 10, 7
SHARD_BYTES = 32 << 20


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    if doc_id is None:
        return struct.pack(">BQI", 0, 0, nth)
    return struct.pack(">BQI", 1, (doc_id + (1 << 63)) & 0xFFFFFFFFFFFFFFFF, nth)


def id_of(key: bytes) -> int | None:
    known, place, _ = struct.unpack(">BQI", key)
    return place - (1 << 63) if known else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, n_bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % n_bits for i in range(PROBES)]


class Writer:
    """Takes (key, ids) in key order; keeps one block, the index and key hashes."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.n_tokens = 0
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.restarts, self.in_block, self.first = bytearray(), [], 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            shared = len(os.path.commonprefix([self.keys[-1], key]))
        if not self.in_block:
            self.first = key
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.keys.append(key)
        self.n_tokens += len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        self.block += struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        self._put(packed := zstandard.ZstdCompressor(level=1).compress(bytes(self.block)))
        self.index.append((self.first, self.at - len(packed), len(packed)))
        self._new_block()

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def close(self) -> int:
        """Writes filter, index and footer; the file's size."""
        self._flush()
        n_bits = max(64, len(self.keys) * BITS_PER_KEY)
        bits = np.zeros(n_bits, bool)
        for key in self.keys:
            bits[_probes(key, n_bits)] = True
        bloom_at = self.at
        self._put(struct.pack("<Q", n_bits) + np.packbits(bits, bitorder="little").tobytes())
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index))
        self._put(FOOTER.pack(bloom_at, index_at - bloom_at, index_at, self.at - index_at, len(self.keys), self.n_tokens, self.width, MAGIC))
        self.sink.close()
        return self.at


class Reader:
    """Lookup (filter, index bisection, block bisection) and ordered scan."""

    def __init__(self, uri: str):
        self.file = read_at(uri)
        tail = self._at(self.file.size() - FOOTER.size, FOOTER.size)
        bloom_at, bloom_n, index_at, index_n, self.n_docs, self.n_tokens, self.width, magic = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard of this format")
        bloom = self._at(bloom_at, bloom_n)
        (self.n_bits,) = struct.unpack_from("<Q", bloom)
        self.bloom, raw, at = bloom[8:], self._at(index_at, index_n), 0
        self.firsts, self.places = [], []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.firsts.append(raw[at : at + n])
            place, at = _read_varint(raw, at + n)
            size, at = _read_varint(raw, at)
            self.places.append((place, size))

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def _block(self, i: int) -> tuple[bytes, tuple[int, ...]]:
        raw = zstandard.ZstdDecompressor().decompress(self._at(*self.places[i]))
        (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
        return raw, struct.unpack_from(f"<{n}I", raw, len(raw) - 4 - 4 * n)

    def _entries(self, raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            yield key, np.frombuffer(raw, f"<u{self.width}", size // self.width, at + rest)
            at += rest + size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.places)):
            raw, restarts = self._block(i)
            yield from self._entries(raw, 0, len(raw) - 4 - 4 * len(restarts))

    def get(self, key: bytes) -> np.ndarray | None:
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.n_bits)):
            return None
        i = bisect.bisect_right(self.firsts, key) - 1
        if i < 0:
            return None
        raw, restarts = self._block(i)
        first_of = lambda at: next(self._entries(raw, at, len(raw)))[0]
        r = bisect.bisect_right(restarts, key, key=first_of) - 1
        end = restarts[r + 1] if r + 1 < len(restarts) else len(raw) - 4 - 4 * len(restarts)
        return next((ids for k, ids in self._entries(raw, restarts[r], end) if k == key), None)


_ready: dict[str, tuple] = {}

#: Runs of ASCII punctuation between ASCII letters, digits or white space; the
#: apostrophe and what touches other characters stay with their neighbours.
_MARKS = re.compile(rb"(?<=[a-z0-9])[!-&(-/:-@\[-`{-~]+(?=[a-z0-9\s]|$)")


class WordEnds:
    """A word-end vocabulary that drops white space, lower-cases, and splits
    letters from marks, as this worker's encoder of pieces.

    Texts are cut where such a vocabulary cuts anyway, so few distinct pieces
    remain. All-letter pieces are encoded many at a time, joined by spaces, and
    told apart by their word ends; others one by one.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        vocabulary = self.library.get_vocab()
        self.size = self.library.get_vocab_size()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo = PieceMemo(lambda p: self._ids([p.decode("utf-8")])[0], 800_000)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: bytes) -> list[bytes]:
        if b"<|" in text:  # special tokens are told by their case
            return text.split()
        return _MARKS.sub(rb" \g<0> ", text.lower()).split()

    def many(self, pieces: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """(pieces, their ids one after another, ids of each) in batches."""
        plain, rest = [], []
        for piece in pieces:
            text = piece.decode("utf-8")
            joins = text.isalpha() and (text.isascii() or max(text) < "\u0130")
            (plain if joins else rest).append((piece, text))
        for low in range(0, len(plain), 256):
            some = plain[low : low + 256]
            ids = np.array(self._ids([" ".join([t for _, t in some])])[0])
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                yield [p for p, _ in some], ids, np.diff(ends, prepend=0)
            else:
                rest += some
        if rest:
            found = self._ids([t for _, t in rest])
            yield [p for p, _ in rest], np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found])


def _encoder(spec, key: str) -> WordEnds:
    if key not in _ready:
        _ready.clear()
        _ready[key] = WordEnds(spec.value)
    return _ready[key]


def write_shards(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_bytes: int = SHARD_BYTES, folder: str | None = None) -> DataFrame:
    """Encodes every whole text and writes shards in ascending id order.

    Returns the manifest: uri, first_key, n_docs, n_tokens, file_bytes, start
    (ids in all shards before). One range shuffle of the texts; about
    ``shard_bytes`` of text a shard. A null text is empty (its end id only);
    null ids come first; rows of equal id are all kept, ordered by text. Other
    columns are not read. The vocabulary must cut and lower-case as ``WordEnds``
    says. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    lean(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # the vocabulary's size
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = folder or fresh_dir(spark, "sst")
    key = f"{vocabulary}|{os.path.getmtime(vocabulary)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec, key)
        memo = encoder.memo
        writer = uri = None
        last, nth = object(), 0
        for block in blocks(batches, "text"):
            memo.trim()
            pieces: list[bytes] = []
            counts = []
            for text in block.column(1).cast(pa.binary()).to_pylist():
                found = encoder.pieces(text or b"")
                pieces += found
                counts.append(len(found))
            ids, lengths = memo.flat(pieces, encoder.many)
            ends = per_document(lengths, counts)
            if writer is None:
                uri, sink = new_file(folder, f"shard-{TaskContext.get().partitionId():06d}", ".sst")
                writer = Writer(sink, 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4)
            for doc_id, a, b in zip(block.column(0).to_pylist(), ends, ends[1:], strict=False):
                nth = nth + 1 if doc_id == last else 0
                last = doc_id
                writer.add(key_of(doc_id, nth), np.append(ids[a:b], np.uint32(end_id)))
        if writer is not None:
            size = writer.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "first_key": pa.array([writer.keys[0]], pa.binary()), "n_docs": [len(writer.keys)], "n_tokens": [writer.n_tokens], "file_bytes": [size]})

    shards = rows.repartitionByRange(max(1, math.ceil(total / shard_bytes)), "id").sortWithinPartitions("id", "text")
    manifest = written(shards.mapInArrow(run, "uri string, first_key binary, n_docs long, n_tokens long, file_bytes long"), "sst-manifest")
    before = Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (binary, unsigned 32 bit) of
    every document, from the shards alone, a task for each few shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, out, held = Reader(uri), [], 0
                for k, ids in reader.scan():
                    raw = ids.astype("<u4").tobytes()
                    out.append((id_of(k), start, len(ids), zlib.crc32(raw), raw))
                    start, held = start + len(ids), held + len(raw)
                    if held > 8 << 20:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(("doc_id", "start", "n_tokens", "ids_crc32", "ids"), zip(*out, strict=True), (pa.int64(),) * 4 + (pa.binary(),), strict=True)
        return pa.RecordBatch.from_pydict({name: pa.array(values, kind) for name, values, kind in columns})

    n = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("uri", "start").repartition(max(n, manifest.count()), "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
