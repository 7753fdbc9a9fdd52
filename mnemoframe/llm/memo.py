"""Text to token ids through a bounded memo of pieces.

Natural text repeats its pieces, so a worker encodes each distinct piece once
and then only gathers. The memo is emptied when it is full: that costs time,
never results.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np

from .arrays import ragged


class PieceMemo(dict):
    """piece -> place of its ids; missing pieces go through ``encode``."""

    def __init__(self, encode: Callable[[str], Iterable[int]], limit: int = 300_000):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.ids, self.ends = array("I"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        self.ids.extend(self.encode(piece))
        self.ends.append(len(self.ids))
        self[piece] = place = len(self.ends) - 2
        return place

    def trim(self) -> None:
        """Called between blocks."""
        if len(self) > self.limit:
            self.clear()
            self.ids, self.ends = array("I"), array("q", [0])

    def learn(self, pieces: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Adds new pieces with their ids, given one after another."""
        base, end = len(self.ends) - 1, len(self.ids)
        self.ids.frombytes(ids.astype(np.uint32).tobytes())
        self.ends.frombytes((end + np.cumsum(lengths, dtype=np.int64)).tobytes())
        self.update(zip(pieces, range(base, base + len(pieces)), strict=True))

    def flat(self, pieces: list, many: Callable[[list], Iterable[tuple]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each piece).

        ``many`` encodes the block's missing pieces together, as batches for ``learn``.
        """
        if many is None:
            at = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        else:
            at = np.fromiter(map(self.get, pieces, repeat(-1)), np.int64, len(pieces))
            gaps = np.flatnonzero(at < 0).tolist()
            missing = [pieces[i] for i in gaps]
            for batch in many(list(set(missing))):
                self.learn(*batch)
            at[gaps] = [self[p] for p in missing]
        ends = np.frombuffer(self.ends, np.int64)
        lengths = ends[at + 1] - ends[at]
        ids = np.frombuffer(self.ids, np.uint32)[ragged(ends[at], lengths)] if len(self.ids) else np.zeros(0, np.uint32)
        return ids, lengths


def per_document(lengths: np.ndarray, counts: list[int]) -> np.ndarray:
    """Ends of the documents' ids, from ids per piece and pieces per document."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    return ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
