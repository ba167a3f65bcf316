"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Each of ``M`` registers holds the set's smallest
exponential variate, on an exponential scale (floor(1 - log_B x), cut to ``Q`` + 2 values). Registers of
a union are the maxima of its parts' registers, and two sets agree in a register about as often
as their Jaccard similarity, so groups of ``ROWS`` registers are bands: documents that share a band
are candidates. A candidate pair's similarity is estimated from its registers and set sizes by
maximum likelihood; beside the registers lies a histogram of the set's hashes in ``BINS`` bins, and the difference of two histograms
bounds their sets' difference from below, which refuses without error what the estimate can't. Pairs that come near the threshold
are confirmed on the full sets.

Documents with equal sets are one class, held by its smallest id, before anything is paired. In a
bucket of a band no pairs are listed: every document is held against the most shared member of each of
its buckets, which joins a group of near copies for a few pairs a member, and the bucket is done where all
other members are one component. What the rest still holds is nearly all below the threshold, and is not held
against each other one by one: its shingles are put in one order, rare ones first, and only documents of
different components that share a shingle among their first ones, early enough that the rest can still reach the
threshold, are pairs (an exact prefix filter). So every pair of a bucket is confirmed, refused or already joined in the end. A pair at the
threshold of 0.8 shares no band with a chance of about 1e-7 (40 bands of 5).

Shingles are compared by 64-bit hashes.

Defined results: a document without words, or a null text, is an empty set, linked with nothing; one
with fewer words than a shingle is a set of its whole sequence; a row without an id is linked with
nothing, has no component and is kept; rows that repeat an id with the same text get the same answer,
and ``deduplicated`` keeps one of them, and all different texts of an id; extra columns stay out of ``near_duplicates``
and are kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.common import by_chunks, stored, table, text_size
from colloquy.llm.graph import components
from colloquy.llm.hashing import Words, mixed, shingles
from colloquy.llm.registry import query

#: Registers, base and rate of their scale, and largest value; registers of a band.
M, B, A, Q = 200, 1.001, 20.0, (1 << 16) - 2
ROWS = 5
#: Bins of the histogram beside the registers; counts end at 255, which leaves the bound a bound.
BINS = 256
#: Bits of a shingle's hash by which its documents are counted, for the order of shingles.
SLOTS = 20
#: Standard errors below the threshold from which an estimate refuses a pair.
MARGIN = 5.0
#: Characters of text worked on at once.
CHUNK = 1 << 20

_SEEDS = mixed(np.arange(M, dtype=np.uint64) + np.uint64(77))
_ODD = mixed(np.arange(M, dtype=np.uint64) + np.uint64(7777)) | np.uint64(1)


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def registers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (set x M) of sets given by their hashes; 0 for empty sets."""
    out = np.zeros((len(bounds) - 1, M), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    least = np.empty((M, len(full)), np.uint64)
    # in pieces that stay in the processor's cache
    groups = np.unique(np.searchsorted(bounds[full], np.arange(0, bounds[-1], 1 << 15)))
    groups = groups[groups < len(full)]
    for a, b in zip(groups, np.append(groups[1:], len(full))):
        lo, hi = bounds[full[a]], bounds[full[b - 1] + 1]
        some, cuts = hashes[lo:hi], bounds[full[a:b]] - lo
        x = np.empty_like(some)
        for i in range(M):
            np.bitwise_xor(some, _SEEDS[i], out=x)
            np.multiply(x, _ODD[i], out=x)
            least[i, a:b] = np.minimum.reduceat(x, cuts)
    share = (least.T.astype(np.float64) + 1.0) / 2.0**64
    variate = -np.log1p(-np.minimum(share, 1 - 2.0**-53)) / A
    out[full] = np.clip(np.floor(1 - np.log(variate) / np.log(B)), 0, Q + 1)
    return out


def histograms(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many hashes of each set fall into each bin (set x BINS)."""
    sets = len(bounds) - 1
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    counts = np.bincount(owner * BINS + (mixed(hashes) >> np.uint64(56)).astype(np.int64), minlength=sets * BINS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(sets, BINS)


def parts(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Registers and histograms of stored sketches."""
    whole = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, 2 * M + BINS)
    return np.ascontiguousarray(whole[:, : 2 * M]).view(np.uint16), whole[:, 2 * M :]


def bands(register: np.ndarray) -> np.ndarray:
    """Keys (set x band) of whole bands."""
    own = register.reshape(len(register), M // ROWS, ROWS).astype(np.uint64)
    key = np.zeros(own.shape[:2], np.uint64)
    for i in range(ROWS):
        key = mixed(key ^ own[:, :, i])
    return mixed(key ^ np.arange(M // ROWS, dtype=np.uint64))


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sets, from their registers and sizes."""
    u, v = n_left / (n_left + n_right), n_right / (n_left + n_right)
    more, less = (left > right).sum(1), (left < right).sum(1)
    same = M - more - less

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def fit(j):
        a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = fit(a) < fit(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def sketches(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """``doc_id, n_shingles, mark_a, mark_b, registers`` (and histogram) of every row; marks tell sets apart."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def make(rows: list[dict]) -> dict:
        hashes, bounds = shingles(Words([lowered(r["text"]) for r in rows]), n)
        sums = []
        for seed in (1, 2):
            total = np.concatenate([[0], np.cumsum(mixed(hashes ^ np.uint64(seed * 0x51ED270B)), dtype=np.uint64)]).astype(np.uint64)
            sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
        return {
            "doc_id": [r["doc_id"] for r in rows],
            "n_shingles": np.diff(bounds),
            "mark_a": sums[0],
            "mark_b": sums[1],
            "registers": [r.tobytes() + h.tobytes() for r, h in zip(registers(hashes, bounds), histograms(hashes, bounds))],
        }

    return by_chunks(narrow, make, "doc_id long, n_shingles long, mark_a long, mark_b long, registers binary", text_size(), CHUNK)


def buckets(classes: DataFrame) -> DataFrame:
    """``key, doc, n`` of every band that more than one class shares, with ``pop``: the sizes of a class's bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = bands(parts(part.column("registers").to_pylist())[0])
                own = [pa.array(np.repeat(part.column(c).to_numpy(), keys.shape[1])) for c in ("doc", "n_shingles")]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *own], names=["key", "doc", "n"])

    flat = classes.select("doc", "n_shingles", "registers").mapInArrow(run, "key long, doc long, n long")
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(flat.join(shared, "key"), "buckets")
    popular = members.groupBy("doc").agg(F.sum("size").alias("pop"))
    return members.join(popular, "doc").select("key", "doc", "n", "pop")


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` that may reach the threshold: by the estimate, and by the difference of their histograms."""
    own = classes.select("doc", "n_shingles", "registers")
    side = lambda c: own.select(F.col("doc").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in own.columns[1:]])
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    least = threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / M)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                (left, left_bins), (right, right_bins) = (parts(part.column(f"registers_{c}").to_pylist()) for c in "ab")
                n, m = (part.column(f"n_shingles_{c}").to_numpy().astype(float) for c in "ab")
                apart = np.abs(left_bins.astype(np.int16) - right_bins).sum(axis=1, dtype=np.int64)
                common = (n + m - apart) / 2  # at most
                near = pa.array((estimate(left, right, n, m) >= least) & (common >= threshold * (n + m - common) - 1e-6))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(near) for c in "ab"], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def shingle_sets(texts: DataFrame, n: int) -> DataFrame:
    """``doc, set`` with ``also`` kept, of rows ``doc, text, also``."""

    def make(rows: list[dict]) -> dict:
        hashes, bounds = shingles(Words([lowered(r["text"]) for r in rows]), n)
        sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
        return {"doc": [r["doc"] for r in rows], "also": [r["also"] for r in rows], "set": sets}

    return by_chunks(texts.select("doc", "also", "text"), make, "doc long, also array<long>, set array<long>", text_size(), CHUNK)


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, per_cent: int) -> DataFrame:
    """The pairs ``a, b`` (b the pivot) whose full sets are similar enough; texts without a pair stay out."""
    pivots = pairs.groupBy("a").agg(F.collect_set("b").alias("also"))  # at most the bands of a times the round's pivots
    named = pairs.select(F.col("b").alias("doc"), F.array().cast("array<long>").alias("also")).distinct()
    members = shingle_sets(texts.join(pivots.withColumnRenamed("a", "doc"), "doc"), n)
    of_pivots = shingle_sets(texts.join(named, "doc"), n).select(F.col("doc").alias("b"), F.col("set").alias("set_b"))
    met = members.select(F.col("doc").alias("a"), "set", F.explode("also").alias("b")).join(of_pivots, "b")
    common = F.size(F.array_intersect("set", "set_b"))
    union = F.size("set") + F.size("set_b") - F.col("common")
    return met.withColumn("common", common).filter(100 * F.col("common") >= per_cent * union).select("a", "b")


def levels(texts: DataFrame, n: int) -> np.ndarray:
    """How many documents hold a shingle of each slot, on a logarithmic scale."""

    def make(rows: list[dict]) -> dict:
        hashes, _ = shingles(Words([lowered(r["text"]) for r in rows]), n)
        slot, count = np.unique(hashes >> np.uint64(64 - SLOTS), return_counts=True)
        return {"slot": slot.astype(np.int32), "n": count}

    counts = by_chunks(texts.select("text"), make, "slot int, n long", text_size(), CHUNK).groupBy("slot").agg(F.sum("n").alias("n"))
    got = counts.select("slot", F.least(F.floor(8 * F.log2("n")), F.lit(254)).cast("short").alias("level")).toArrow()  # at most all slots
    out = np.zeros(1 << SLOTS, np.uint8)
    out[got.column("slot").to_numpy()] = got.column("level").to_numpy() + 1
    return out


def heads(texts: DataFrame, n: int, per_cent: int) -> DataFrame:
    """``token, doc, root, n, place``: the first shingles of every text ``doc, root, text``, rare ones first.

    Sets that reach the threshold share one of them: as many are left out as both must have in common, but one.
    """
    shared = texts.sparkSession.sparkContext.broadcast(levels(texts, n))

    def make(rows: list[dict]) -> dict:
        hashes, bounds = shingles(Words([lowered(r["text"]) for r in rows]), n)
        size = np.diff(bounds)
        owner = np.repeat(np.arange(len(rows)), size)
        order = np.lexsort((hashes, shared.value[hashes >> np.uint64(64 - SLOTS)], owner))
        place = np.arange(len(hashes)) - bounds[owner]
        first = np.flatnonzero(place < (size - -(-per_cent * size // 100) + 1)[owner])
        whose = owner[first]
        out = {c: np.array([r[c] for r in rows], np.int64)[whose] for c in ("doc", "root")}
        return out | {"token": hashes[order[first]].view(np.int64), "n": size[whose], "place": place[first]}

    return by_chunks(texts.select("doc", "root", "text"), make, "token long, doc long, root long, n long, place long", text_size(), CHUNK)


def near_heads(first: DataFrame, per_cent: int) -> DataFrame:
    """The pairs ``a, b`` of different components that share a head early enough to reach the threshold."""
    # a shared shingle that is the first: what follows it, in the shorter of both rests, is all that may be common
    other = first.select("token", *[F.col(c).alias(f"{c}_b") for c in ("doc", "root", "n", "place")])
    smaller = first.filter(100 * (F.col("n") - F.col("place")) >= per_cent * (F.col("n") + F.col("place")))
    met = smaller.join(other.hint("merge"), "token").filter(
        ((F.col("n") < F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("doc") < F.col("doc_b"))))
        & (F.col("root") != F.col("root_b"))
        & ((100 + per_cent) * F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) >= per_cent * (F.col("n") + F.col("n_b")))
    )
    return met.select(F.col("doc").alias("a"), F.col("doc_b").alias("b")).distinct()


def joined(classes: DataFrame, texts: DataFrame, n: int, per_cent: int) -> DataFrame:
    """``doc, root`` of the classes that share a bucket with another."""
    members = stored(buckets(classes), "members")
    roots = stored(members.select("doc", F.col("doc").alias("root")).distinct(), "roots")
    classes = stored(classes.join(roots.select("doc"), "doc", "left_semi"), "candidates")
    texts = stored(texts.hint("merge").join(roots.select("doc"), "doc", "left_semi"), "candidate-texts")
    first = Window.partitionBy("key").orderBy(F.desc("pop"), "doc")
    placed = members.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= 1)
    pivots = stored(placed.select("key", F.col("doc").alias("doc_b"), F.col("n").alias("n_b")), "pivots")
    met = members.join(pivots, "key").filter(F.col("doc") != F.col("doc_b"))
    met = met.filter(100 * F.least("n", "n_b") >= per_cent * F.greatest("n", "n_b"))  # else the sizes alone refuse
    # a pair that meets in several buckets, or as pivots of each other, is asked once
    pair = F.min(F.struct(F.col("doc").alias("a"), F.col("doc_b").alias("b"))).alias("pair")
    asked = met.groupBy(F.least("doc", "doc_b").alias("lo"), F.greatest("doc", "doc_b").alias("hi")).agg(pair).select("pair.a", "pair.b")
    pairs = stored(likely(asked, classes, per_cent / 100), "pairs")
    roots = _united(roots, stored(confirmed(pairs, texts, n, per_cent), "confirmed"))
    # where all but the pivot are its component or alone with it, the bucket is done
    left = members.select("key", "doc").join(pivots, "key").filter(F.col("doc") != F.col("doc_b")).join(roots, "doc").select("key", "doc", "root")
    open_ = left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    held = stored(left.join(open_, "key").select("doc", "root").distinct(), "open")
    early = stored(heads(texts.join(held, "doc"), n, per_cent), "heads")
    pairs = stored(likely(near_heads(early, per_cent), classes, per_cent / 100), "pairs")
    return _united(roots, confirmed(pairs, texts, n, per_cent))


def _united(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``doc, root`` after the links ``a, b``."""
    own = roots.select(F.col("doc").alias("d"), F.col("root").alias("r"))
    between = links.join(own.toDF("a", "root_a"), "a").join(own.toDF("b", "root_b"), "b")
    found = components(between.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    new = found.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return stored(roots.join(new, "root", "left").select("doc", F.coalesce("new", "root").alias("root")), "roots")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, per_cent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    sketched = stored(sketches(docs, doc_id, text, n), "sketches")
    sets = sketched.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(
        sets.groupBy("mark_a", "mark_b", "n_shingles").agg(F.min("doc_id").alias("doc"), F.first("registers").alias("registers")), "classes"
    )
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    roots = joined(classes, texts, n, per_cent)
    marks = ["mark_a", "mark_b", "n_shingles"]
    named = classes.join(roots, "doc", "left").select(*marks, F.coalesce("root", "doc").alias("component_id"))
    copies = named.join(sets.groupBy(*marks).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), marks, "left_semi")
    alone = sketched.join(roots.select(F.col("doc").alias("doc_id"), "root"), "doc_id", "left")
    component = F.coalesce("component_id", "root", "doc_id")
    out = alone.join(copies, marks, "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, per_cent: int = 80) -> DataFrame:
    """``docs`` without those that are not their component's smallest; rows that repeat an id and its text become one.

    Different texts under one id are different documents: all but one of them (the least by hash) get a key of their own
    above all ids, so they stay unless they are near duplicates themselves.
    """
    hashed = docs.select(F.col(doc_id).alias("__dedup_id"), F.xxhash64(text).alias("__dedup_hash"))
    again = hashed.groupBy("__dedup_id").agg(F.count(F.lit(1)).alias("__dedup_n"), F.min("__dedup_hash").alias("__dedup_first")).filter("__dedup_n > 1 and __dedup_id is not null")
    again = stored(again.select("__dedup_id", "__dedup_first"), "repeated")
    repeats, own = F.col(doc_id) == F.col("__dedup_id"), F.col(doc_id).cast("long")
    single = docs.join(again, repeats, "left_anti").withColumn("__dedup_key", own)
    several = docs.join(again, repeats).withColumn("__dedup_hash", F.xxhash64(text)).dropDuplicates([doc_id, "__dedup_hash"])
    other = F.xxhash64(F.col(doc_id), F.col("__dedup_hash")).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    several = several.withColumn("__dedup_key", F.when(F.col("__dedup_hash") == F.col("__dedup_first"), own).otherwise(other))
    whole = single.unionByName(several.select(*docs.columns, "__dedup_key"))
    gone = near_duplicates(whole, "__dedup_key", text, n, per_cent).filter(~F.col("kept")).select(F.col("doc_id").alias("__dedup_gone")).distinct()
    return whole.join(gone, F.col("__dedup_key") == F.col("__dedup_gone"), "left_anti").select(*docs.columns)


@query("op8_near_duplicates")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), n=2)
