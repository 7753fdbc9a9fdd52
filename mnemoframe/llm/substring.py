"""Exact substring deduplication by Rabin-Karp window hashes.

Every window of ``size`` words of every document is hashed; a window whose
words also start earlier (smaller id, or same document further left) is
repeated, and the union of the repeated windows of a document is cut as maximal
intervals.

Plan. (1) A worker hashes a block of whole documents with running sums, drops
all but the first window of each hash in the block (so a passage that a third
of the corpus shares leaves a block once), and sends the rest to hash buckets
as packed columns: per document one id, per window its start's delta and its
hash. (2) A bucket, sized to fit a worker, counts its hashes and emits the
starts of all windows but the first of each. (3) Documents and their repeated
starts meet by groups of ids, and the intervals are cut. The texts are shuffled
once, after the windows' shuffle files are released.

Two windows count as equal if their 64-bit hashes are, and their bucket, which
comes from a second hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import OTHER_BASE, SPACES, blocks, longs, pack, passed_on, ragged, runs, slices_by, unpack, utf8, window_hashes, word_hashes, word_spans
from .storage import lean, release, written

BUCKET_BYTES, GROUP_BYTES = 8 << 20, 3 << 20


def _groups_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (ids ^ (ids >> 16)) % n


def _packed_places(ids: np.ndarray, texts: np.ndarray, starts: np.ndarray, *more: np.ndarray) -> bytes:
    """Window places ordered by document, then start, as one blob."""
    first = runs(ids, texts)
    deltas = np.diff(starts, prepend=0)
    deltas[first] = starts[first]
    counts = np.diff(np.append(first, len(ids)))
    return pack(ids[first], texts[first], counts.astype(np.uint32), deltas.astype(np.uint32), *more)


def _places(blob: bytes, *more: type) -> list[np.ndarray]:
    ids, texts, counts, deltas, *rest = unpack(blob, np.int64, np.uint32, np.uint32, np.uint32, *more)
    counts = counts.astype(np.int64)
    total = np.cumsum(deltas.astype(np.int64))
    ends = np.cumsum(counts)
    base = np.concatenate(([0], total[ends[:-1] - 1])) if len(ends) else total
    return [np.repeat(ids, counts), np.repeat(texts, counts), total - np.repeat(base, counts), *rest]


def _windows(n_buckets: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            ids, texts = longs(block.column(0)), block.column(1).to_numpy().astype(np.int64).astype(np.uint32)
            order = np.lexsort((texts, ids))
            first = runs(ids[order], texts[order])  # of identical rows, one stands for all
            block, ids, texts = block.take(pa.array(order[first])), ids[order[first]], texts[order[first]]
            offsets, body = utf8(block.column(2))
            starts, ends, firsts = word_spans(offsets, body, SPACES)
            words = word_hashes(body, starts, ends)
            counts = np.maximum(np.diff(firsts) - size + 1, 0)
            if not counts.sum():
                continue
            at = ragged(firsts[:-1], counts)
            doc = np.repeat(np.arange(len(ids)), counts)
            start = at - firsts[doc]
            h = window_hashes(words, size)[at]
            bucket = (window_hashes(words, size, OTHER_BASE)[at] % np.uint64(n_buckets)).astype(np.int64)
            if len(ids) == len(runs(ids)):
                by_hash = np.argsort(h, kind="stable")
            else:  # different texts under one id: their starts interleave
                by_hash = np.lexsort((start, ids[doc], h))
            group = runs(h[by_hash])
            lead = np.repeat(by_hash[group], np.diff(np.append(group, len(h))))
            repeated = np.zeros(len(h), bool)
            repeated[by_hash] = (ids[doc[by_hash]] != ids[doc[lead]]) | (start[by_hash] != start[lead])
            out: dict[str, list] = {"bucket": [], "counted": [], "blob": []}
            if repeated.any():
                d = doc[repeated]
                out["bucket"].append(int(h[0] % np.uint64(n_buckets)))
                out["counted"].append(True)
                out["blob"].append(_packed_places(ids[d], texts[d], start[repeated]))
            sent = np.flatnonzero(~repeated)
            order, bounds = slices_by(bucket[sent], n_buckets)
            for b in np.flatnonzero(np.diff(bounds)):
                own = sent[order[bounds[b] : bounds[b + 1]]]
                d = doc[own]
                out["bucket"].append(int(b))
                out["counted"].append(False)
                out["blob"].append(_packed_places(ids[d], texts[d], start[own], h[own]))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(out["bucket"], pa.int32()), "counted": pa.array(out["counted"], pa.bool_()), "blob": pa.array(out["blob"], pa.binary())})

    return run


def _repeats(n_groups: int):
    def run(bucket: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = []
        seen: list[list[np.ndarray]] = []
        for counted, blob in zip(bucket.column("counted").to_pylist(), bucket.column("blob"), strict=True):
            if counted:
                parts.append(_places(blob.as_buffer().to_pybytes()))
            else:
                seen.append(_places(blob.as_buffer().to_pybytes(), np.uint64))
        if seen:
            ids, texts, starts, h = (np.concatenate(c) for c in zip(*seen, strict=True))
            seen.clear()
            order = np.argsort(h)
            same = h[order[1:]] == h[order[:-1]]
            own = order[np.append(same, False) | np.insert(same, 0, False)] if len(same) else order[:0]
            own = own[np.lexsort((starts[own], ids[own], h[own]))]
            group = runs(h[own])
            lead = np.repeat(own[group], np.diff(np.append(group, len(own))))
            own = own[(ids[own] != ids[lead]) | (starts[own] != starts[lead])]
            parts.append([ids[own], texts[own], starts[own]])
        ids, texts, starts = (np.concatenate(c) for c in zip(*parts, strict=True))
        group = _groups_of(ids, n_groups)
        order = np.lexsort((starts, texts, ids, group))
        ids, texts, starts = ids[order], texts[order], starts[order]
        bounds = np.searchsorted(group[order], np.arange(n_groups + 1))
        full = np.flatnonzero(np.diff(bounds))
        blobs = [_packed_places(ids[a:b], texts[a:b], starts[a:b]) for a, b in zip(bounds[full], bounds[full + 1], strict=True)]
        return pa.table({"grp": pa.array(full.astype(np.int64)), "blob": pa.array(blobs, pa.binary())})

    return run


def _cut(size: int, keep_text: bool):
    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        ids = longs(docs.column("id").combine_chunks())
        texts = docs.column("hash").to_numpy().astype(np.int64).astype(np.uint32)
        offsets, body = utf8(docs.column("text"))
        starts, ends, firsts = word_spans(offsets, body, SPACES)
        marks = np.zeros(len(starts) + 1, bool)
        order = np.lexsort((texts, ids))
        key = runs(ids[order], texts[order])
        rows = {(int(ids[order[a]]), int(texts[order[a]])): order[a:b] for a, b in zip(key, np.append(key[1:], len(order)), strict=True)}
        for blob in repeats.column("blob"):
            i, t, s = _places(blob.as_buffer().to_pybytes())
            run_at = runs(i, t)
            for a, b in zip(run_at, np.append(run_at[1:], len(i)), strict=True):
                for row in rows.get((int(i[a]), int(t[a])), ()):
                    marks[firsts[row] + s[a:b]] = True
        seen = np.concatenate((np.zeros(size, np.int64), np.cumsum(marks[:-1])))
        gone = seen[size:] > seen[: len(starts)] if len(starts) else np.zeros(0, bool)
        n_words = np.diff(firsts)
        removed = np.concatenate(([0], np.cumsum(gone)))[firsts]
        kept = np.flatnonzero(~gone)
        sizes = ends[kept] - starts[kept]
        # the kept words with one space after each; a document's last space is left out of its slice
        put = np.concatenate(([0], np.cumsum(sizes + 1)))
        text = np.full(int(put[-1]), 0x20, np.uint8)
        text[ragged(put[:-1], sizes)] = body[ragged(starts[kept], sizes)]
        text = text.tobytes()
        cuts = put[np.searchsorted(kept, firsts)]
        hashes = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        # intervals end at their document's end too
        spans: list[list[dict]] = [[] for _ in ids]
        doc_of = np.searchsorted(firsts, np.arange(len(starts)), "right") - 1
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            while a < b:
                d = int(doc_of[a])
                end = min(int(b), int(firsts[d + 1]))
                spans[d].append({"start": int(a - firsts[d]), "end": int(end - firsts[d])})
                a = end
        columns = {
            "doc": passed_on(docs.column("doc")),
            "n_words": pa.array(n_words.astype(np.int64)),
            "n_removed": pa.array(np.diff(removed).astype(np.int64)),
            "kept_sha256": pa.array(hashes, pa.string()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }
        if keep_text:
            # a cut word takes along what separates it from the next, or from the document's end
            after = np.append(starts[1:], 0)
            last = np.flatnonzero(np.diff(firsts)) + 1
            after[firsts[last] - 1] = offsets[last]
            step = np.zeros(len(body) + 1, np.int8)
            step[starts[gone]] += 1
            step[after[gone]] -= 1
            stays = np.cumsum(step[:-1], dtype=np.int8) == 0
            length = np.concatenate(([0], np.cumsum(stays)))[offsets]
            rest = body[stays].tobytes()
            texts_out = pa.array([rest[a:b] for a, b in zip(length, length[1:], strict=False)], pa.binary()).cast(pa.string())
            columns["kept_text"] = pa.chunked_array([pc.if_else(pc.is_null(docs.column("text").combine_chunks()), None, texts_out)])
        return pa.table(columns)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20, keep_text: bool = True) -> DataFrame:
    """Cuts every word that a repeated window of ``size`` words covers.

    Words are the maximal runs of bytes other than space and 09-0D. Returns per
    row: doc (struct of all columns but the text, whatever their names),
    n_words, n_removed, kept_sha256, removed (maximal word intervals, end
    exclusive) and, if ``keep_text``, kept_text: the text without the removed
    words and what separates each from the next, so a text that loses nothing
    stays as it is. ``kept_sha256`` is of the kept words with one space
    between. A null or empty text has no words and stays. A null id sorts before all others. Rows of equal id keep what neither an earlier
    start nor a smaller id repeats, so identical rows get identical results. A
    text of any length is one block. An empty table gives no rows.
    """
    spark = docs.sparkSession
    lean(spark)
    text = F.col(text_col).cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_buckets, n_groups = max(1, math.ceil(total / BUCKET_BYTES)), max(1, math.ceil(total / GROUP_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    windows = rows.mapInArrow(_windows(n_buckets, size), "bucket int, counted boolean, blob binary")
    repeats = written(windows.groupBy("bucket").applyInArrow(_repeats(n_groups), "grp long, blob binary"), "repeated-windows")
    del windows
    release(spark)
    others = [c for c in docs.columns if c != text_col]
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    spot = F.coalesce("id", F.lit(-(1 << 63)))
    left = left.withColumn("grp", F.pmod(spot.bitwiseXOR(F.shiftright(spot, 16)), F.lit(n_groups)))
    doc_type = left.schema["doc"].dataType.simpleString()
    schema = f"doc {doc_type}, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>" + ", kept_text string" * keep_text
    return left.groupBy("grp").cogroup(repeats.groupBy("grp")).applyInArrow(_cut(size, keep_text), schema)
