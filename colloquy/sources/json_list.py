"""Files that hold one JSON list each, read by many tasks.

Spark cuts the text at commas, so any block of a file can be read by itself, from any file system. What a
block needs to know is whether it begins inside a string and how many brackets are open there. A first pass
reads every block under both assumptions, outside and inside a string, and keeps three numbers: the parity of
its quotes, and the brackets it leaves open under either. Composed in file order they give each block's start. A second
pass emits the elements that lie within a block; an element that crosses blocks comes as fragments, two a block,
which are put together in a shuffle of their own.

Escapes never cross blocks: a comma can't be escaped in JSON.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.session import Files

_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_QUOTE, _COMMA, _OPEN, _CLOSE, _OPEN_OBJECT, _CLOSE_OBJECT = b'",[]{}'
_PIECES = "file string, block long"
#: What begins or ends an element: a comma, or the list's own bracket; 0 where that lies in another block.
_BY_COMMA, _BRACKET = 1, 2


class NotAList(ValueError):
    """A file is not one JSON list."""


@dataclass(frozen=True)
class Start:
    """How a block begins: within a string or not, and the brackets open there."""

    inside: bool
    depth: int


def first_character(spark: SparkSession, path: str) -> str:
    """The first character of a file (of the first file in a folder) that is not blank; '' for an empty one."""
    files = Files(spark, path)
    if files.is_folder(path):
        names = [n for n in files.children(path) if not n.startswith(("_", "."))]
        return first_character(spark, f"{path.rstrip('/')}/{names[0]}") if names else ""
    return files.read_start(path, 4096).decode("utf-8", "replace").lstrip("﻿ \t\r\n")[:1]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between commas, with the file and the start of the block it was read from."""
    text = spark.read.option("lineSep", ",").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """Bytes of the blocks in order, commas put back: ((file, block), some of its bytes)."""
    for batch in batches:
        file, block = (batch.column(i).to_pylist() for i in range(2))
        value = batch.column(2).cast(pa.binary()).to_pylist()
        start = 0
        for i in range(1, len(value) + 1):
            if i == len(value) or (block[i], file[i]) != (block[start], file[start]):
                yield (file[start], block[start]), b",".join(value[start:i]) + b","
                start = i


def _marks(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(characters, which of them are outside strings, whether the end is inside one)."""
    seen = np.frombuffer(_ESCAPE.sub(b"__", data), np.uint8)
    within = (np.cumsum(seen == _QUOTE) + inside) & 1
    return seen, within == 0, bool(within[-1])


def _opened(seen: np.ndarray) -> np.ndarray:
    """+1 for a bracket or brace that opens, -1 for one that closes."""
    up = (seen == _OPEN) | (seen == _OPEN_OBJECT)
    return up.astype(np.int64) - ((seen == _CLOSE) | (seen == _CLOSE_OBJECT))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, odd, outside, inside)`` per block: parity of its quotes, brackets left open if it starts outside or inside a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd, left = None, False, [0, 0]

        def out() -> pa.RecordBatch:
            values = [[now[0]], [now[1]], [odd], [left[0]], [left[1]]]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["file", "block", "odd", "outside", "inside"])

        for key, data in _runs(batches):
            if key != now:
                if now:
                    yield out()
                now, odd, left = key, False, [0, 0]
            seen, free, odd = _marks(data, odd)
            opened = _opened(seen)
            left[0] += int(opened[free].sum())
            left[1] += int(opened[~free].sum())
        if now:
            yield out()

    return _pieces(spark, path).mapInArrow(run, f"{_PIECES}, odd boolean, outside long, inside long")


def starts(spark: SparkSession, path: str) -> dict[tuple[str, int], Start]:
    """How every block begins. One entry a block, which is as large as ``spark.sql.files.maxPartitionBytes``."""
    blocks = defaultdict(list)
    for r in summaries(spark, path).collect():
        blocks[r["file"]].append(r)
    found = {}
    for file, own in blocks.items():
        now = Start(False, 0)
        for r in sorted(own, key=lambda r: r["block"]):
            found[file, r["block"]] = now
            now = Start(now.inside != r["odd"], now.depth + (r["inside"] if now.inside else r["outside"]))
        if now != Start(False, 0):
            raise NotAList(f"{file} is not a whole JSON list: {'a string' if now.inside else 'a bracket'} is left open, or closed too often")
    return found


def elements(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, seq, value)``: the elements of all lists as JSON text.

    ``(file, block, seq)`` orders them as they lie in the files; an element has the block where it begins. An empty
    list has none. A file that isn't one list raises, whichever task meets it.
    """
    known = spark.sparkContext.broadcast({k: (s.inside, s.depth) for k, s in starts(spark, path).items()})
    names = ["file", "block", "seq", "value", "opens", "closes"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for key, data in _runs(batches):
            if reader is None or key != reader.key:
                if reader:
                    yield from batch(reader.end())
                if key not in known.value:
                    raise RuntimeError("the files, or how they are cut, have changed since they were planned")
                reader = _Block(key, Start(*known.value[key]))
            yield from batch(reader.take(data))
        if reader:
            yield from batch(reader.end())

    def batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    read = _pieces(spark, path).mapInArrow(run, f"{_PIECES}, seq long, value binary, opens int, closes int").withColumn("value", F.col("value").cast("string"))
    place = ["file", "block", "seq"]
    whole = read.filter("opens > 0 and closes > 0")
    # fragments: at most two a block, cut at commas
    order = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = read.filter("opens = 0 or closes = 0").withColumn("element", F.sum(F.signum("opens")).over(order))
    listed = F.array_sort(F.collect_list(F.struct("block", "seq", "value")))
    put = parts.groupBy("file", "element").agg(listed.alias("parts"), F.max("opens").alias("opens"), F.max("closes").alias("closes"))
    first = [F.col("parts")[0][x].alias(x) for x in ("block", "seq")]
    stitched = put.select("file", *first, F.array_join("parts.value", "").alias("value"), "opens", "closes")
    found = whole.unionByName(stitched).withColumn("value", F.btrim("value", F.lit(" \t\r\n")))
    missing = F.raise_error(F.concat("file", F.lit(" has an empty list element")))
    value = F.when(F.col("value") != "", F.col("value")).otherwise(missing).alias("value")
    return found.filter(f"value != '' or opens != {_BRACKET} or closes != {_BRACKET}").select(*place, value)


class _Block:
    """One block read in order, from a known start."""

    def __init__(self, key: tuple[str, int], start: Start):
        self.key, self.inside, self.depth = key, start.inside, start.depth
        self.held: list[bytes] = []  # the element that is being read
        self.opens = 0  # what began it in this block, if anything did
        self.seq = 0
        self.done = start.depth == 0 and key[1] > 0  # the list ended in a block before

    def take(self, data: bytes) -> list[tuple]:
        seen, free, inside = _marks(data, self.inside)
        opened = np.where(free, _opened(seen), 0)
        depth = self.depth + np.cumsum(opened)
        self.inside, rows, at = inside, [], 0
        cut = free & (((depth == 1) & ((seen == _COMMA) | (opened == 1))) | ((depth == 0) & (opened == -1)))
        for end in np.flatnonzero(cut):
            piece, mark = data[at:end], seen[end]
            at = end + 1
            if opened[end] == 1:  # the list begins
                if mark != _OPEN or self.done or b"".join([*self.held, piece]).strip(b"\xef\xbb\xbf \t\r\n"):
                    raise NotAList(f"{self.key[0]} is not one JSON list")
                self.held, self.opens = [], _BRACKET
                continue
            self._add(rows, piece, _BRACKET if depth[end] == 0 else _BY_COMMA)
            self.opens, self.done = (0, True) if depth[end] == 0 else (_BY_COMMA, False)
        self.held.append(data[at:])
        self.depth = int(depth[-1])
        return rows

    def _add(self, rows: list[tuple], piece: bytes, closes: int) -> None:
        rows.append((*self.key, self.seq, b"".join([*self.held, piece]), self.opens, closes))
        self.held = []
        self.seq += 1

    def end(self) -> list[tuple]:
        rows: list[tuple] = []
        if self.depth == 0:  # nothing but the comma put back may follow the list
            if b"".join(self.held).strip(b"\xef\xbb\xbf \t\r\n,"):
                raise NotAList(f"{self.key[0]} is not one JSON list")
        else:
            self._add(rows, b"", 0)
        return rows


def count_elements(spark: SparkSession, path: str) -> int:
    """The length of all lists below ``path``; an element that isn't JSON raises."""
    found = elements(spark, path).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.try_parse_json("value").isNull()).alias("broken")).first()
    if found["broken"]:
        raise NotAList(f"{path} is not JSON: {found['broken']} elements can't be read")
    return found["n"]


def dump_lists(rows: DataFrame, path: str) -> None:
    """Write rows as JSON lists, one file a task."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            lines = []
            for text in batch.column(0).to_pylist():
                lines.append(mark + text)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"])], names=["value"])

    text = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    text.mapInArrow(listed, "value string").write.mode("overwrite").text(path)


# Task code travels with its job, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
