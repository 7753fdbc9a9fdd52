"""The items of JSON arrays of any size, read by byte ranges.

Spark cuts a file into blocks at closing braces, wherever these stand, so blocks
of one array are read side by side and no line or file has to fit a task. A first
scan sums each block up: for either state it may begin in (inside a string or
not), the state it ends in, how the depth changes, and the commas at each depth.
Folding these in order tells where each block begins; a second scan then cuts
the items, and those that cross blocks are put together from their fragments.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKS = re.compile(r'\\.|["\[\]{},]', re.DOTALL)
ROWS = 500


class Block:
    """What a block does to a scan that begins inside a string (1) or outside (0)."""

    def __init__(self) -> None:
        self.quoted = [False, True]
        self.depth = [0, 0]
        self.commas: list[Counter] = [Counter(), Counter()]
        self.first = ""

    def add(self, piece: str) -> None:
        self.first = self.first or piece.lstrip("\ufeff \t\r\n")[:1]
        for mark in _MARKS.findall(piece):
            if mark == '"':
                self.quoted = [not q for q in self.quoted]
                continue
            side = 0 if not self.quoted[0] else 1  # one of the two is outside
            if mark in "[{":
                self.depth[side] += 1
            elif mark in "]}":
                self.depth[side] -= 1
            elif mark == ",":
                self.commas[side][self.depth[side]] += 1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    # every piece but a file's last ended with the brace; one more after the array's end does no harm
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.concat("value", F.lit("}")).alias("piece"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        yield from zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True)


_SUM = "file string, block long, first string, quoted array<boolean>, depth array<int>, at array<array<int>>, commas array<array<long>>"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], Block] = {}
    for key, piece in _blocks(batches):
        found.setdefault(key, Block()).add(piece)
    rows = [{"file": f, "block": b, "first": s.first, "quoted": s.quoted, "depth": s.depth, "at": [list(c) for c in s.commas], "commas": [list(c.values()) for c in s.commas]} for (f, b), s in found.items()]
    kind = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.string()), ("quoted", pa.list_(pa.bool_())), ("depth", pa.list_(pa.int32())), ("at", pa.list_(pa.list_(pa.int32()))), ("commas", pa.list_(pa.list_(pa.int64())))])
    if rows:
        yield from pa.Table.from_pylist(rows, kind).to_batches()


def starts_of(blocks: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(inside a string, depth, items before) at the start of each block of a file that holds an array."""
    out: dict[tuple[str, int], tuple[bool, int, int]] = {}
    file, state = None, (False, 0, 0)
    for b in sorted(blocks, key=lambda b: (b["file"], b["block"])):
        if b["file"] != file:
            file, state, array = b["file"], (False, 0, 0), None
        array = b["first"] == "[" if array is None and b["first"] else array
        if array is False:
            continue
        quoted, depth, items = state
        out[b["file"], b["block"]] = state
        side = int(quoted)
        items += sum(n for at, n in zip(b["at"][side], b["commas"][side], strict=True) if depth + at == 1)
        state = (b["quoted"][side], depth + b["depth"][side], items)
    return out


def cut(pieces: Iterator[str], state: tuple[bool, int, int]) -> Iterator[tuple[int, bool, bool, str]]:
    """(index, begun before, goes on after, text) of the items and fragments of one block."""
    quoted, depth, index = state
    before, held, over = depth > 0, [], False
    for piece in pieces:
        if over:
            continue
        start = 0
        for m in _MARKS.finditer(piece):
            mark = m[0]
            if mark == '"':
                quoted = not quoted
            elif quoted:
                continue
            elif mark in "[{":
                depth += 1
                if depth == 1:
                    start = m.end()
            elif mark == "," and depth == 1:
                held.append(piece[start : m.start()])
                yield index, before, False, "".join(held)
                held, before, index, start = [], False, index + 1, m.end()
            elif mark in "]}":
                depth -= 1
                if depth == 0:
                    held.append(piece[start : m.start()])
                    yield index, before, False, "".join(held)
                    over = True
                    break
        if not over and depth > 0:
            held.append(piece[start:])
    if not over and depth > 0:
        yield index, before, True, "".join(held)


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, item_index, text) of every item of the arrays in the files; texts as they stand there.

    Files that hold no array give nothing, empty ones neither; the last array of
    a broken file gives what is left of it. Each item must fit a task, a file
    need not. Compressed files are one block.
    """
    pieces = _pieces(spark, path)
    blocks = [r.asDict() for r in pieces.mapInArrow(_summed, _SUM).collect()]  # a row a block
    shipped = spark.sparkContext.broadcast(starts_of(blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, rows = shipped.value, _blocks(batches)
        names = ["file", "block", "item_index", "before", "after", "text"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        out: list[tuple] = []
        following = next(rows, None)
        while following is not None:
            key = following[0]

            def own(key: tuple[str, int] = key) -> Iterator[str]:
                nonlocal following
                while following is not None and following[0] == key:
                    yield following[1]
                    following = next(rows, None)

            if key in starts:
                for index, before, after, said in cut(own(), starts[key]):
                    out.append((*key, index, before, after, said))
                    if len(out) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
            for _ in own():  # what follows an array, or a file without one
                pass
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = pieces.mapInArrow(run, "file string, block long, item_index long, before boolean, after boolean, text string")
    crossing = F.col("before") | F.col("after")
    whole = rows.filter(~crossing).select("file", "item_index", "text")
    # fragments of one item, which fits a task
    parts = rows.filter(crossing).groupBy("file", "item_index").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    joined = parts.select("file", "item_index", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    return whole.unionByName(joined).filter(F.trim(F.translate("text", "\t\r\n", "   ")) != "")
