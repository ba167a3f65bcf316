"""Exact substring dedup by recompression.

Words are symbols. A round names each maximal run of a symbol, and each pair of neighbouring symbols
of which the left is of one class and the right of the other (a bit of the symbol's hash); runs have the
class of their symbol. Names are hashes, so they are the same everywhere without a table of names,
and whether symbols merge depends on them and their neighbours only: where a passage repeats, the inner
symbols of every round repeat with it. ``ROUNDS`` rounds give a symbol some words, and with the
neighbours it depends on, some more: its context.

A window of ``size`` words is anchored at one of the highest symbols whose whole context it
holds, the one with the smallest hash; equal windows have equal anchors, and one anchor serves several
windows. The contexts' names are counted over all documents; windows whose anchor occurs once can't
repeat. Those left are verified: a 128-bit hash of all their words is grouped, and the first of
each group stays. Both groupings are counts and minima, aggregated before their shuffle, and what goes
back to a document is what is unique or first in it, so a passage that a third of all rows share is a
row a task.

Documents whose text is that of a smaller id are repeats as a whole, and send no windows.

Defined results: null and empty texts have no words; texts shorter than a window lose none; a row
without an id comes after all others; rows with equal ids are not earlier than one another, unless they
hold the same window twice themselves; extra columns stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import by_chunks, stored, table, text_size
from colloquy.llm.hashing import Words, mixed, powers
from colloquy.llm.registry import query

SIZE, ROUNDS = 20, 2
#: Characters of text worked on at once.
CHUNK = 1 << 20
LAST = (1 << 63) - 1

_INVERSE = tuple(pow(int(powers(lane, 2)[1]), -1, 1 << 64) for lane in (0, 1))
_SALT = mixed(np.arange(64, dtype=np.uint64) + np.uint64(4242))


class Spans:
    """Hashes of any stretch of words, in two lanes."""

    def __init__(self, words: Words, lanes: int):
        n = len(words.start)
        self.rise, self.sums = [], []
        for lane in range(lanes):
            fall = np.full(n, _INVERSE[lane], np.uint64)
            fall[:1] = 1
            fall = np.cumprod(fall, dtype=np.uint64)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(words.hash[lane] * fall, dtype=np.uint64, out=total[1:])
            self.sums.append(total)
            self.rise.append(powers(lane, n))

    def hash(self, lane: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words from ``start`` to ``end``, both included."""
        return mixed((self.sums[lane][end + 1] - self.sums[lane][start]) * self.rise[lane][start])


class Level:
    """Symbols of one round: name, first and last word of the context, text they are of."""

    def __init__(self, name, lo, hi, doc):
        self.name, self.lo, self.hi, self.doc = name, lo, hi, doc

    def next(self, salt: np.uint64) -> Level:
        name, doc, n = self.name, self.doc, len(self.name)
        same_doc = doc[1:] == doc[:-1]
        run_start = np.concatenate([[True], (name[1:] != name[:-1]) | ~same_doc]) if n else np.zeros(0, bool)
        first = np.flatnonzero(run_start)
        length = np.diff(np.append(first, n)).astype(np.uint64)
        kind = mixed(name[first] ^ salt)
        left = (kind >> np.uint64(63)) == 0
        run = np.where(length > 1, mixed(name[first] + length * np.uint64(0x632BE59BD9B4E019)), name[first])
        joins = np.zeros(len(first), bool)  # a run with the next one
        if len(first) > 1:
            joins[:-1] = left[:-1] & ~left[1:] & (doc[first[1:]] == doc[first[:-1]])
        begins = np.concatenate([[True], ~joins[:-1]]) if len(first) else joins
        at = np.flatnonzero(begins)
        new = run[at]
        pair = joins[at]
        new[pair] = mixed(run[at[pair]] * np.uint64(0xE7037ED1A0B428DB) + run[at[pair] + 1] ^ salt)
        a = first[at]  # first symbol below, and last
        b = np.append(a[1:], n) - 1
        own = doc[a]
        lo, hi = np.full(len(a), -1, np.int64), np.full(len(a), -1, np.int64)
        inner = (a > 0) & (b < n - 1)
        inner[inner] &= (doc[a[inner] - 1] == own[inner]) & (doc[b[inner] + 1] == own[inner])
        inner[inner] &= (self.lo[a[inner] - 1] >= 0) & (self.hi[b[inner] + 1] >= 0)
        lo[inner], hi[inner] = self.lo[a[inner] - 1], self.hi[b[inner] + 1]
        return Level(new, lo, hi, own)


def _least(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int, most: int) -> np.ndarray:
    """For each of ``n`` places, the least rank of the stretches ``lo`` to ``hi`` (at most ``most`` places) over it."""
    # a stretch is two stretches of 2^level places; then those of a level are halved into the next one's
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    best = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for own in range(most.bit_length() - 1, -1, -1):
        mine = np.flatnonzero(level == own)
        half = (1 << own) >> 1
        np.minimum.at(best, lo[mine], rank[mine])
        np.minimum.at(best, hi[mine] - (1 << own) + 1, rank[mine])
        if half:
            best[half:] = np.minimum(best[half:], best[:-half])
    return best


class Anchors:
    """For each window of the texts: its anchor, as a number within its text; for each anchor, its key."""

    def __init__(self, words: Words, spans: Spans, size: int, rounds: int):
        counts = np.diff(words.first)
        n = int(words.first[-1])
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(n)
        #: words at which a window may start
        self.starts = np.flatnonzero(at + size <= words.first[doc + 1]) if n else at
        open_ = np.zeros(n, bool)
        open_[self.starts] = True
        levels = [Level(words.hash[0], at, at, doc)]
        for r in range(rounds):
            levels.append(levels[-1].next(_SALT[r]))
        anchor = np.full(n, -1, np.int64)
        keys, docs, base = [], [], 0
        for number in range(rounds, -1, -1):
            level = levels[number]
            fit = np.flatnonzero((level.lo >= 0) & (level.hi - level.lo < size))
            bits = np.uint64(max(20, int(n).bit_length()))
            rank = (mixed(level.name[fit] ^ _SALT[32 + number]) >> bits << bits) | fit.astype(np.uint64)
            lo, room, begin = level.lo[fit], size - (level.hi[fit] - level.lo[fit]), words.first[level.doc[fit]]
            best = _least(rank, np.maximum(lo - room + 1, begin), lo, n, size)
            mine = np.flatnonzero(open_ & (best != np.iinfo(np.uint64).max))
            chosen, index = np.unique(best[mine] & ((np.uint64(1) << bits) - np.uint64(1)), return_inverse=True)
            chosen = chosen.astype(np.int64)
            anchor[mine] = base + index
            keys.append(mixed(spans.hash(0, level.lo[chosen], level.hi[chosen]) ^ _SALT[16 + number]))
            docs.append(level.doc[chosen])
            base += len(chosen)
            open_[mine] = False
            if not open_.any():
                break
        self.key, self.doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(self.doc, kind="stable")
        first = np.searchsorted(self.doc[order], np.arange(len(counts)))
        self.number = np.empty(base, np.int64)
        self.number[order] = np.arange(base) - first[self.doc[order]]
        #: anchors of a text, in order of their numbers, and where each text's begin
        self.order, self.first = order, np.append(first, base)
        self.of_window = anchor[self.starts]
        self.doc_of_window = doc[self.starts] if n else self.starts


def _cut(rows: list[dict], size: int, rounds: int, lanes: int):
    words = Words([(r["text"] or "").encode("utf-8", "surrogatepass") for r in rows], lanes)
    spans = Spans(words, lanes)
    return words, spans, Anchors(words, spans, size, rounds)


def anchors(docs: DataFrame, size: int, rounds: int) -> DataFrame:
    """``key, doc, number`` of every anchor."""

    def make(rows: list[dict]) -> dict:
        _, _, found = _cut(rows, size, rounds, 1)
        ids = np.array([r["doc"] for r in rows], np.int64)
        return {"key": found.key.view(np.int64), "doc": ids[found.doc], "number": found.number.astype(np.int32)}

    return by_chunks(docs, make, "key long, doc long, number int", text_size(), CHUNK)


def _open_windows(rows: list[dict], found: Anchors) -> np.ndarray:
    """Which windows have an anchor that is not unique; none of a copy's."""
    unique = np.zeros(len(found.key), bool)
    for d, row in enumerate(rows):
        a, b = found.first[d], found.first[d + 1]
        if row["copy"]:
            unique[found.order[a:b]] = True
        elif row["numbers"]:
            unique[found.order[a + np.array(row["numbers"], np.int64)]] = True
    return ~unique[found.of_window] if len(found.of_window) else np.zeros(0, bool)


def open_windows(texts: DataFrame, size: int, rounds: int) -> DataFrame:
    """``a, b, doc, start`` of the windows to verify: their hash and place, once for each text."""

    def make(rows: list[dict]) -> dict:
        words, spans, found = _cut(rows, size, rounds, 2)
        which = _open_windows(rows, found)
        at, d = found.starts[which], found.doc_of_window[which]
        a, b = spans.hash(0, at, at + size - 1), spans.hash(1, at, at + size - 1)
        order = np.lexsort((at, a, d))  # the first of a text's equal windows
        first = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (d[order][1:] != d[order][:-1])]) if len(at) else order
        kept = np.sort(order[first]) if len(at) else order
        ids = np.array([r["doc"] for r in rows], np.int64)
        start = (at - words.first[d]).astype(np.int32)
        return {"a": a[kept].view(np.int64), "b": b[kept].view(np.int64), "doc": ids[d[kept]], "start": start[kept]}

    return by_chunks(texts, make, "a long, b long, doc long, start int", text_size(), CHUNK)


def removed(docs: DataFrame, doc_id: str, text: str, schema: str, row: Callable, size: int = SIZE, rounds: int = ROUNDS) -> DataFrame:
    """Rows of ``row(n_words, n_removed, kept)`` with ``doc_id`` and the columns ``schema``.

    ``kept`` is the kept words joined by one space, in UTF-8; ``row`` runs in the tasks.
    """
    ordinal = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    base = docs.select(F.col(doc_id).alias("id"), ordinal.alias("doc"), F.col(text).alias("text"))
    once = anchors(base.select("doc", "text"), size, rounds).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"), F.min("number").alias("number")
    )
    unique = once.filter("n = 1").groupBy("doc").agg(F.collect_list("number").alias("numbers"))  # at most a text's anchors
    marked = base.select("doc", F.md5(F.col("text").cast("binary")).alias("mark")).filter("mark is not null")
    groups = marked.groupBy("mark").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = marked.join(groups, "mark").filter(F.col("doc") > F.col("least")).select("doc", "mark").distinct()
    lists = stored(unique, "unique-anchors")
    copied = stored(copies.groupBy("doc").agg(F.collect_set("mark").alias("marks")), "copies")
    told = base.join(lists, "doc", "left").join(copied, "doc", "left").select(
        "id", "doc", "text", "numbers", F.coalesce(F.array_contains("marks", F.md5(F.col("text").cast("binary"))), F.lit(False)).alias("copy")
    )
    first = open_windows(told.select("doc", "text", "numbers", "copy"), size, rounds).groupBy("a", "b").agg(
        F.min_by("start", "doc").alias("start"), F.min("doc").alias("doc")
    )
    firsts = first.groupBy("doc").agg(F.collect_list("start").alias("firsts"))  # at most a text's windows
    met = told.join(firsts, "doc", "left")
    own = T.StructField("doc_id", docs.schema[doc_id].dataType)
    fields = T.StructType([own, *T.StructType.fromDDL(schema).fields])

    def make(rows: list[dict]) -> dict:
        words, _, found = _cut(rows, size, rounds, 1)
        again = _open_windows(rows, found)
        out = []
        for d, r in enumerate(rows):
            a, b = words.first[d], words.first[d + 1]
            lo, hi = np.searchsorted(found.doc_of_window, (d, d + 1))
            start = found.starts[lo:hi] - a
            gone = np.full(hi - lo, True) if r["copy"] else again[lo:hi].copy()
            if r["firsts"] and not r["copy"]:
                gone[np.isin(start, r["firsts"])] = False
            cover = np.zeros(b - a + 1, np.int64)
            cover[start[gone]] += 1
            np.subtract.at(cover, start[gone] + size, 1)
            keep = np.cumsum(cover)[:-1] == 0
            data = (r["text"] or "").encode("utf-8", "surrogatepass").split()
            kept = data if keep.all() else [w for w, k in zip(data, keep.tolist()) if k]
            out.append((r["id"], *row(int(b - a), int((~keep).sum()), b" ".join(kept))))
        return {f.name: [o[i] for o in out] for i, f in enumerate(fields)}

    return by_chunks(met, make, fields, text_size(), CHUNK)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` with the words that no earlier window holds."""
    schema = "n_words long, n_removed long, text string"
    return removed(docs, doc_id, text, schema, lambda n, gone, kept: (n, gone, kept.decode("utf-8", "replace")), size)


@query("op2_recompression")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    schema = "n_words long, n_removed long, kept_sha256 string"
    digest = lambda n, gone, kept: (n, gone, hashlib.sha256(kept).hexdigest())
    return removed(table(spark, folder, "documents"), "doc_id", "text", schema, digest)
