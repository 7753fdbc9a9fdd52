"""Places where a model may answer, each with an offline default.

A stage takes a DataFrame and returns one, so a hosted model, an Arrow function
or a rule fit alike; failures belong into an ``error`` column, not exceptions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


def sentences(episodes: DataFrame) -> DataFrame:
    """Rule-based extraction: one event for each sentence of an episode."""
    cut = F.filter(F.transform(F.split("content", r"(?<=[.!?。！？])\s*"), lambda s: F.trim(s)), lambda s: s != "")
    return episodes.select("*", F.posexplode(cut).alias("event_index", "summary")).withColumns({"action": F.lit(""), "causality": F.lit("")})


def hashed_vector(text: str, dim: int = 64) -> list[float]:
    """A repeatable bag-of-words vector, for tests and offline runs."""
    out = np.zeros(dim)
    for word in re.findall(r"\w+", (text or "").lower()):
        h = int.from_bytes(word.encode()[:16].ljust(16, b"\0"), "little") * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        out[h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(out)
    return (out / n if n else out).tolist()


def embedded(rows: DataFrame, text_col: str, embed: Callable[[list[str]], list[list[float] | None]] | None = None, batch: int = 25) -> DataFrame:
    """``rows`` with ``embedding`` and ``error``: texts in batches, a failed batch again one by one."""
    call = embed or (lambda texts: [hashed_vector(t) for t in texts])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors: list = []
            errors: list = []
            texts = part[text_col].fillna("").tolist()
            for low in range(0, len(texts), batch):
                some = texts[low : low + batch]
                try:
                    got, bad = call(some), [None] * len(some)
                except Exception:
                    got, bad = [], []
                    for t in some:
                        try:
                            got.append(call([t])[0])
                            bad.append(None)
                        except Exception as e:
                            got.append(None)
                            bad.append(str(e)[:200])
                vectors += got
                errors += bad
            yield part.assign(embedding=vectors, error=errors)

    kept = rows.drop("embedding", "error")
    return kept.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", embedding array<double>, error string")
