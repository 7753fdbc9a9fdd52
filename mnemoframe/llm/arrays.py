"""Arrow/NumPy plumbing shared by the operators that run in Python workers.

Everything here works on bounded blocks: a record batch is cut into pieces of
about ``BLOCK_BYTES`` of text (a single longer document forms its own piece),
so a worker's memory follows the block size and never the partition size.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

BLOCK_BYTES = 2 << 20

# Large arrays go back to the system when freed (M_MMAP_THRESHOLD), as workers
# are reused and several share an executor's memory.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL(None).mallopt(-3, 4 << 20)

#: White space of the word definitions: space and the controls 09 to 0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTER_BASE = np.uint64(0xD1342543DE82EF95)
WORD_BASE = np.uint64(0xF1357AEA2E62A9C5)
OTHER_BASE = np.uint64(0xAF251AF3B0F025B5)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls become empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, body = column.buffers()
    places = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if places is not None else np.zeros(1)
    places = places.astype(np.int64)
    body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return places - places[0], body[places[0] : places[-1]]


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of ``text`` each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = utf8(batch.column(batch.schema.get_field_index(text)))[0]
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(ends, ends[low] + limit, "right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            yield batch.slice(low, high - low)
            low = high


def longs(column: pa.Array) -> np.ndarray:
    """int64 values; null is the smallest long, so it sorts before every other."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def word_spans(offsets: np.ndarray, body: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, firsts) of the maximal runs of bytes outside ``gap``.

    No word crosses a document's end. Document d has the words
    ``firsts[d]:firsts[d + 1]``.
    """
    if not len(body):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~gap[body]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(body))]
    begins[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n (grown on demand)."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        made = []
        for b in (base, inverse):
            run = np.full(n, b, np.uint64)
            run[0] = 1
            made.append(np.cumprod(run, dtype=np.uint64))
        have = _powers[int(base)] = (made[0], made[1])
    return have


def _sums(values: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, from one running sum over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = _sums(_LETTERS[body], _LETTER_BASE)
    h = (sums[ends] - sums[starts]) * powers(_LETTER_BASE, len(body) + 1)[1][starts]
    return mixed(h + (ends - starts).astype(np.uint64) * _ODD)


def window_hashes(words: np.ndarray, size: int, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``size`` words of the block (also those
    that cross documents; callers mask these out)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = _sums(words, base)
    return mixed((sums[size:] - sums[:n]) * powers(base, len(words) + 1)[1][:n])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[0], starts[0]+1, ... of all given runs, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (ends - lengths), lengths)
    return out


def pack(*columns: np.ndarray) -> bytes:
    """Arrays as one compressed blob; ``unpack`` needs their types again."""
    head = np.array([len(c) for c in columns], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    counts, at, out = np.frombuffer(raw, np.int64, len(types)), 8 * len(types), []
    for kind, n in zip(types, counts, strict=True):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def slices_by(groups: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): group g's members are order[bounds[g]:bounds[g + 1]], in their old order."""
    small = groups.astype(np.uint16) if n <= 1 << 16 else groups
    return np.argsort(small, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(groups.astype(np.int64), minlength=n))))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours (of all keys together)."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    change = np.ones(n, bool)
    change[1:] = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _nullable(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(_nullable(kind.value_type))
    if pa.types.is_map(kind):
        return pa.map_(_nullable(kind.key_type), _nullable(kind.item_type))
    return kind


def passed_on(column: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    """A column handed through a worker: Spark wants nullable fields back."""
    return column.cast(_nullable(column.type))
