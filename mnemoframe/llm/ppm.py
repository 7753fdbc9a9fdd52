"""Language identification by prediction by partial matching.

Each language has a context tree over bytes up to ``ORDER`` bytes deep. A byte
costs the negative log of its share in the longest known context in which the
language has seen it, plus an escape (method C: distinct over total plus
distinct, without exclusions) for each longer known context; below order 0
stands the uniform byte. Statistics are frozen after learning, so code lengths
are exact and do not depend on the order of the texts. The language with the
shortest code wins.

The trees of all languages share one trie, whose rows hold the resolved cost
(or escape) for every language: a text's bytes walk it together, one gather a
level, and only the bytes that the union has not seen fall back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, passed_on, utf8
from .storage import lean

ORDER = 3
UNDETERMINED = "und"


def separated(offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with a -1 after each document, starts of the documents there)."""
    n = len(offsets) - 1
    starts = offsets[:-1] + np.arange(n)
    out = np.full(len(body) + n, -1, np.int16)
    out[np.arange(len(body)) + np.repeat(np.arange(n), np.diff(offsets))] = body
    return out, starts


def gram_counts(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-byte grams within documents, as integers, and counts."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, ok = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(size):
        part = codes[j : j + n]
        ok &= part >= 0
        key = key << 8 | part
    return np.unique(key[ok], return_counts=True)


class ContextTrees:
    """Frozen trees of several languages. ``counts[m][language]``: (keys, counts)
    of the grams of m + 1 bytes."""

    def __init__(self, languages: list[str], counts: list[dict[str, tuple[np.ndarray, np.ndarray]]]):
        self.languages = sorted(languages)
        width = len(self.languages)
        seen = np.unique(np.concatenate([counts[0][x][0] for x in self.languages])) if width else np.zeros(0, np.int64)
        self.alphabet = len(seen) + 1
        self.code = np.zeros(257, np.int32)  # 0: unknown, and the separator at -1
        self.code[seen] = np.arange(1, len(seen) + 1)
        keys_before, costs_before = np.zeros(1, np.int64), np.full((1, width), 8.0)
        self.steps, self.costs, self.escapes = [], [], []
        for m, by_language in enumerate(counts):
            keys = np.unique(np.concatenate([by_language[x][0] for x in self.languages])) if width else np.zeros(0, np.int64)
            held = np.zeros((len(keys), width))
            for j, x in enumerate(self.languages):
                held[np.searchsorted(keys, by_language[x][0]), j] = by_language[x][1]
            context = np.searchsorted(keys_before, keys >> 8)
            total, distinct = np.zeros((len(keys_before), width)), np.zeros((len(keys_before), width))
            np.add.at(total, context, held)
            np.add.at(distinct, context, held > 0)
            known = total > 0
            escape = np.where(known, -np.log2(np.where(known, distinct, 1) / np.where(known, total + distinct, 1)), 0.0)
            suffix = np.searchsorted(keys_before, keys & ((1 << 8 * m) - 1)) if m else np.zeros(len(keys), np.int64)
            own = held > 0
            cost = np.where(own, -np.log2(np.where(own, held, 1) / np.where(own, (total + distinct)[context], 1)), escape[context] + costs_before[suffix])
            step = np.full((len(keys_before) + 1, self.alphabet), -1, np.int32)  # the last row leads nowhere
            step[context, self.code[keys & 255]] = np.arange(len(keys))
            self.steps.append(step)
            self.costs.append(cost.astype(np.float32))
            self.escapes.append(np.vstack((escape, np.zeros((1, width)))).astype(np.float32))
            keys_before, costs_before = keys, cost

    def code_lengths(self, offsets: np.ndarray, body: np.ndarray) -> np.ndarray:
        """Bits of every document (row) under every language (column)."""
        codes, starts = separated(offsets, body)
        symbols = self.code[codes]
        depth, n = len(self.steps), len(codes)
        # nodes[m][i]: node of the m + 1 symbols that start at i, or -1
        nodes = []
        for m, step in enumerate(self.steps):
            before = nodes[-1][: n - m] if m else np.zeros(n, np.int32)
            node = np.full(n, -1, np.int32)
            node[: max(n - m, 0)] = step[before, symbols[m:]]  # -1 is the last row
            nodes.append(node)
        ending = lambda m, at: np.where(at >= m, nodes[m][np.maximum(at - m, 0)], -1)

        out = np.zeros((len(starts), len(self.languages)))
        for low in range(0, n, 1 << 18):
            at = np.arange(low, min(n, low + (1 << 18)))
            bits = np.zeros((len(at), len(self.languages)), np.float32)
            left = np.flatnonzero(codes[at] >= 0)
            for m in range(depth - 1, -1, -1):
                node = ending(m, at[left])
                met = node >= 0
                bits[left[met]] += self.costs[m][node[met]]
                left = left[~met]
                if not len(left):
                    break
                context = ending(m - 1, at[left] - 1) if m else np.zeros(len(left), np.int32)
                bits[left] += self.escapes[m][context]
            bits[left] += 8.0
            doc = np.searchsorted(starts, at, "right") - 1
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            out[doc[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64)
        return out


def learn(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int = 500) -> ContextTrees:
    """Trees from about ``per_language`` rows of each language (all, if fewer),
    taken by a hash of their ids. Grams are counted in Spark; the driver gets
    the distinct grams of the sample, at most 2**32 whatever the corpus."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id")).filter("lang is not null and text is not null and id is not null")
    lean(labelled.sparkSession)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return ContextTrees([], [{} for _ in range(ORDER + 1)])
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    sample = rows.filter((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            langs = np.array(block.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                codes, _ = separated(*utf8(block.column(1).take(pa.array(np.flatnonzero(langs == lang)))))
                for m in range(ORDER + 1):
                    keys, counts = gram_counts(codes, m + 1)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "m": pa.array(np.full(len(keys), m, np.int32)), "key": keys, "n": counts.astype(np.int64)})

    grams = sample.select("lang", "text").mapInArrow(run, "lang string, m int, key long, n long").groupBy("lang", "m", "key").agg(F.sum("n").alias("n"))
    found = grams.toArrow()
    lang, m, key, n = (found.column(c).to_numpy() for c in ("lang", "m", "key", "n"))
    counts: list[dict] = [{x: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for x in sizes} for _ in range(ORDER + 1)]
    for x in sizes:
        for depth in range(ORDER + 1):
            own = (lang == x) & (m == depth)
            order = np.argsort(key[own])
            counts[depth][x] = key[own][order], n[own][order]
    known = [x for x in sizes if len(counts[0][x][0])]
    return ContextTrees(known, counts)


def identify(docs: DataFrame, trees: ContextTrees, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Language of every whole text.

    Returns doc (struct of all other columns, whatever their names), text (if
    ``keep_text``; it passes through the worker once), lang_pred, score (share of the winner if each language were as likely before; 0 to 1),
    bits_per_byte (the winner's). A null text, one without a letter, or no
    learned language: ``und``, score 0, bits null. Equal codes: the language
    first in order. A text of any length is one block; one pass, no shuffle.
    """
    lean(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ContextTrees = shipped.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for block in blocks(batches, "text", 1 << 20):
            has_letter = block.column(2).to_numpy(zero_copy_only=False)
            offsets, body = utf8(block.column(1))
            best, score, per_byte = np.full(len(has_letter), len(names) - 1), np.zeros(len(has_letter)), np.full(len(has_letter), np.nan)
            if model.languages:
                bits = model.code_lengths(offsets, body)
                top = bits.argmin(axis=1)
                least = bits.min(axis=1)
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                best, score = np.where(has_letter, top, best), np.where(has_letter, share, 0.0)
                per_byte = np.where(has_letter, least / np.maximum(np.diff(offsets), 1), np.nan)
            kept = {"text": block.column(1)} if keep_text else {}
            yield pa.RecordBatch.from_pydict({"doc": passed_on(block.column(0)), **kept, "lang_pred": pa.array(names[best].tolist(), pa.string()), "score": score, "bits_per_byte": pa.array(per_byte, from_pandas=True)})

    text = F.col(text_col).cast("string")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("doc"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, " + "text string, " * keep_text + "lang_pred string, score double, bits_per_byte double")


def held_out(id_col: str = "doc_id"):
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **more) -> ContextTrees:
    """Trees from the rows outside the held-out fold."""
    return learn(docs.filter(~held_out(id_col)), text_col, lang_col, id_col, **more)
