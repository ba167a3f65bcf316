"""Document fingerprints: SimHash over weighted terms, and search by permuted block tables.

A text's terms are its pairs of neighbouring words (a single word is a term). Texts of fewer than ``SHORT`` words
are also cut into runs of four characters, and their pairs weigh four times as much. A term that occurs n times weighs
1 + floor(log2(n)), so a line repeated hundreds of times can't outvote the text. Each bit of a term's hash votes for
or against the fingerprint's bit with the term's weight; the fingerprint has a bit where the votes for it win.

Likeness of two fingerprints estimates the cosine of the weighted terms: max(0, cos(pi * h / BITS)) with h differing bits.

``within`` finds all pairs of fingerprints at most ``radius`` bits apart: bits are cut into radius + 2 blocks, so a
pair within the radius agrees in two blocks at least; for every choice of two blocks there is a table keyed by them.
A pair is taken from the first table where it meets only, and equal fingerprints travel once.

Documents meet the next one in id order in one shuffle: ids are cut into ranges at approximate percentiles, and the rows
that begin a range go to the one before as well.

Defined results: null is an empty text; a text without terms has the fingerprint 0. Ids ascend, null first; rows of one
id follow each other by text. A row after the last is the first one, so a single row is followed by itself. Repeated
rows are documents of their own. An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import table
from colloquy.llm.hashing import Words, mixed
from colloquy.llm.registry import query

BITS = 256
LANES = BITS // 64
#: Texts of fewer words are also cut into characters.
SHORT = 32
GRAM = 4
PAIR_WEIGHT = 4
#: Characters of text in one chunk of a task.
CHUNK = 1 << 19
#: Bytes of text in one range of ids, and ranges in one task; at most so many ranges.
RANGE_BYTES, RANGES_A_TASK, MOST_RANGES = 4 << 20, 8, 1 << 14

_TERM = 44  # bits of a term; the upper ones number the text
_MASK = np.uint64((1 << _TERM) - 1)
#: Eight counters of a byte each in one number: counter i is bit i of the byte looked up.
_SPREAD = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)
_FULL = 255


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of ``LANES`` 64-bit numbers a text."""
    terms, weights = _terms(texts)
    text = (terms >> np.uint64(_TERM)).astype(np.int64)
    votes = np.repeat(np.arange(len(terms)), weights)
    votes_of = np.bincount(text, weights, len(texts)).astype(np.int64)
    term = (terms & _MASK)[:, None] * np.uint64(2 * LANES + 1) + np.arange(LANES, dtype=np.uint64)
    hashes = np.ascontiguousarray(mixed(mixed(term)))
    octets = hashes.view(np.uint8).reshape(len(terms), LANES * 8)
    # runs of at most 255 votes of one text fill counters of one byte
    runs = -(-votes_of // _FULL)
    owner = np.repeat(np.arange(len(texts)), runs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    start = (np.cumsum(votes_of) - votes_of)[owner] + nth * _FULL
    size = np.minimum(votes_of[owner] - nth * _FULL, _FULL)
    sums = np.zeros((len(owner), LANES * 8), np.uint64)
    live = np.arange(len(owner))
    for i in range(int(size.max(initial=0))):
        live = live[size[live] > i]
        sums[live] += _SPREAD[octets[votes[start[live] + i]]]
    ones = np.zeros((len(texts), BITS), np.int64)
    if len(owner):
        ones[runs > 0] = np.add.reduceat(sums.view(np.uint8).reshape(-1, BITS), np.flatnonzero(nth == 0), axis=0, dtype=np.int64)
    won = 2 * ones > votes_of[:, None]
    return np.packbits(won, axis=1, bitorder="little").view(np.uint64)


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number and term, sorted and distinct; weights)."""
    words = Words([t.encode("utf-8", "surrogatepass") for t in texts])
    word, count = words.hash[0], np.diff(words.first)
    number = np.repeat(np.arange(len(texts)), count)
    pairs = mixed(mixed(word[:-1]) * np.uint64(0xA0761D6478BD642F) + word[1:]) if len(word) else word
    inside = number[:-1] == number[1:]
    alone = count[number] == 1
    short = np.flatnonzero(count < SHORT)
    grams = [_grams(texts[i]) for i in short]
    owner = np.concatenate([number[:-1][inside], number[alone], np.repeat(short, [len(g) for g in grams])]).astype(np.uint64)
    value = np.concatenate([pairs[inside], mixed(word[alone]), *grams]) if len(owner) else word[:0]
    is_pair = np.concatenate([np.ones(inside.sum() + alone.sum(), bool), np.zeros(sum(map(len, grams)), bool)])
    # the lowest bit of a term tells pairs from runs of characters
    term = (value >> np.uint64(65 - _TERM)) << np.uint64(1) | is_pair.astype(np.uint64)
    terms, often = np.unique(owner << np.uint64(_TERM) | term, return_counts=True)
    weights = 1 + np.log2(often).astype(np.int64)
    heavy = (terms & np.uint64(1)).astype(bool) & (count < SHORT)[(terms >> np.uint64(_TERM)).astype(np.int64)]
    return terms, weights * np.where(heavy, PAIR_WEIGHT, 1)


def _grams(text: str) -> np.ndarray:
    """Hashes of all runs of four characters; a shorter text is one run."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = min(GRAM, len(points))
    if not size:
        return points
    total = np.full(len(points) - size + 1, size, np.uint64)
    for i in range(size):
        total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + points[i : len(points) - size + 1 + i])
    return total


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated cosine of the terms of two texts, from their fingerprints; 0 to 1."""
    apart = np.bitwise_count(a ^ b).sum(axis=1)
    return np.maximum(0.0, np.cos(np.pi * apart / BITS))


def written(marks: np.ndarray) -> list[str]:
    """Fingerprints as 64 hexadecimal digits."""
    return [m.astype(">u8").tobytes().hex() for m in marks]


def with_fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` of every document; the fingerprint in hexadecimal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(written(fingerprints(texts)), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, about ``CHUNK`` characters at a time."""
    ids, texts, size = [], [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            batch = whole.slice(at, 128)
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or "")
                size += 64 + len(texts[-1])
                if size >= CHUNK:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def next_to_each_other(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(range, wrap, guest, doc_id, text, mark)``: documents dealt by ranges of ids, in order within them.

    The rows that begin a range also end the one before, as guests; those that begin all end the last. ``mark``
    holds the fingerprint's bytes.
    """
    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = cut.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n = min(MOST_RANGES, 1 + ((total[0] or 0) + 64 * total[1]) // RANGE_BYTES)
    splits = np.empty(0, np.int64)
    if n > 1:
        shares = [i / n for i in range(1, n)]
        found = cut.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * n))).first()[0]
        splits = np.unique(np.array(found or [], np.int64))
    ranges = F.lit(0)
    if len(splits):  # the first id of each range, from the narrow column alone
        ranges = _range_of(cut.select("doc_id"), splits).groupBy("range").agg(F.min("doc_id").alias("first"))
        firsts = sorted((r["range"], r["first"]) for r in ranges.collect() if r["first"] is not None)
    else:
        firsts = [(0, r[0]) for r in cut.agg(F.min("doc_id")).collect() if r[0] is not None]
    no_id = bool(cut.filter("doc_id is null").take(1))
    there = sorted({r for r, _ in firsts} | ({0} if no_id else set()))
    start = None if no_id else firsts[0][1] if firsts else None  # the id that begins all
    before = {i: there[there.index(r) - 1] for r, i in firsts if r != there[0]}
    last = there[-1] if there else 0
    shared = docs.sparkSession.sparkContext.broadcast((splits, before, start, last))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, before, start, last = shared.value
        for ids, texts in _chunks(batches):
            marks = fingerprints(texts).view(np.uint8)
            rows = []
            for k, i in enumerate(ids):
                rows.append((0 if i is None else int(np.searchsorted(splits, i, "right")), False, False, k))
                if i in before:
                    rows.append((before[i], False, True, k))
                if i == start:
                    rows.append((last, True, True, k))
            which = [r[3] for r in rows]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.bool_(), pa.bool_()))]
            columns += [pa.array([ids[k] for k in which], pa.int64()), pa.array([texts[k] for k in which], pa.string()), pa.array([marks[k].tobytes() for k in which], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "wrap", "guest", "doc_id", "text", "mark"])

    dealt = cut.mapInArrow(deal, "range int, wrap boolean, guest boolean, doc_id long, text string, mark binary")
    tasks = -(-(len(splits) + 1) // RANGES_A_TASK)
    return dealt.repartition(tasks, "range").sortWithinPartitions("range", "wrap", F.col("doc_id").asc_nulls_first(), "text")


def _range_of(ids: DataFrame, splits: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            place = np.searchsorted(splits, column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), column], names=["range", "doc_id"])

    return ids.mapInArrow(run, "range int, doc_id long")


def edited(own: str, following: str) -> str:
    """The last half of a text replaced by as many characters from the start of another."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


def compared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every document's fingerprint, that of its text edited by the next document, and their likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # rows in order; the last one waits for the next

        def done(rows: list[tuple]) -> pa.RecordBatch:
            ours = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
            changed = [edited(a[3], b[3]) for a, b in ours]
            own, other = (np.frombuffer(b"".join(x[4] for x in side), np.uint64).reshape(-1, LANES) for side in (zip(*ours) if ours else ([], [])))
            new = fingerprints(changed)
            columns = [
                pa.array([a[2] for a, _ in ours], pa.int64()), pa.array([len(a[3]) for a, _ in ours], pa.int64()),
                pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                pa.array(written(own), pa.string()), pa.array(written(new), pa.string()),
                pa.array(likeness(own, new), pa.float64()), pa.array(likeness(own, other), pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                for row in zip(*(b.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text", "mark"))):
                    held.append(row)
                    size += 64 + len(row[3])
                    if size >= CHUNK:
                        yield done(held)
                        held, size = held[-1:], 0
        if held:
            yield done(held)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return next_to_each_other(docs, doc_id, text).mapInArrow(run, schema)


def _blocks(mark: Column, radius: int) -> Column:
    """The digits of a fingerprint cut into radius + 2 runs, as even as they come."""
    digits, n = BITS // 4, radius + 2
    cuts = [digits * i // n for i in range(n + 1)]
    return F.array(*[F.substring(mark, a + 1, b - a) for a, b in zip(cuts, cuts[1:])])


def _apart(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints in hexadecimal."""
    lanes = [F.bit_count(_number(a, i).bitwiseXOR(_number(b, i))) for i in range(0, BITS // 4, 8)]
    return sum(lanes[1:], lanes[0])


def _number(mark: Column, at: int) -> Column:
    return F.conv(F.substring(mark, at + 1, 8), 16, 10).cast("long")


def classes(marks: DataFrame) -> DataFrame:
    """``(fingerprint, class_id, n_docs)`` from ``(doc_id, fingerprint)``: the smallest id and the number of documents of each."""
    return marks.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_docs"))


def within(queries: DataFrame, marks: DataFrame, radius: int) -> DataFrame:
    """``(query, fingerprint, distance)``: all pairs of a fingerprint of ``queries`` with one of ``marks`` at most ``radius`` bits apart.

    Both have a column ``fingerprint``; each distinct one counts once, and one is not its own neighbour.
    """
    if not 0 <= radius <= BITS // 4 - 2:
        raise ValueError(f"a radius of 0 to {BITS // 4 - 2} bits, not {radius}")
    choices = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in combinations(range(radius + 2), 2)])

    def tables(df: DataFrame, name: str) -> DataFrame:
        cut = df.select(F.col("fingerprint").alias(name)).distinct().withColumn("blocks", _blocks(F.col(name), radius))
        cut = cut.select(name, F.col("blocks").alias(f"{name}_blocks"), F.explode(choices).alias("t"))
        key = [F.element_at(f"{name}_blocks", F.col(f"t.{x}") + 1) for x in "ab"]
        return cut.select(name, f"{name}_blocks", "t", F.concat(*key).alias("key"))

    met = tables(queries, "query").join(tables(marks, "mark"), ["t", "key"])
    equal = F.expr("filter(sequence(0, size(query_blocks) - 1), i -> query_blocks[i] = mark_blocks[i])")
    first = met.filter((equal[0] == F.col("t.a")) & (equal[1] == F.col("t.b")) & (F.col("query") != F.col("mark")))
    apart = first.select("query", F.col("mark").alias("fingerprint"), _apart(F.col("query"), F.col("mark")).cast("int").alias("distance"))
    return apart.filter(F.col("distance") <= radius)


@query("op11_fingerprints")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return compared(table(spark, folder, "documents"), "doc_id", "text")
