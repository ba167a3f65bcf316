"""Quality classifier by Bradley-Terry pairwise ranking.

A document's worth is a linear function of surface features of its whole text. Every labelled row teaches: the
weights minimise the mean logistic loss of all pairs of a document labelled 1 and one labelled 0, by Newton's method. The loss
of all pairs needs no pairs: worths of each label are counted in ``BINS`` bins, each held at the mean worth of its rows, and
pairs of bins stand for pairs of rows. The score quantile of all labelled rows, at their share of label 0, is the threshold;
scores map to (0, 1) by a logistic curve that is ``CUT`` there, with a slope fitted to the labels.

Features of labelled rows are stored once; every step of the fit is a sum over them, made in the tasks and added up in Spark.
The driver sees such sums only. All rows are scored where they lie.

Defined results: null and empty texts have the features of no words, and a score as any other;
labels that are null or neither 0 nor 1 teach nothing; rows labelled more than once teach once per
label; without rows of both labels every score is 0.5; repeated rows get equal scores; extra
columns stay out of ``score_documents`` and are kept by ``accepted``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.llm.common import stored, table
from colloquy.llm.registry import query

#: Score at the threshold.
CUT = 0.3
#: Steps of the fit at most, weight of the penalty, bins of worths in a step of the fit, and in a search for a quantile.
STEPS, DECAY, BINS, FINE = 40, 1e-3, 512, 1 << 15

FEATURES = (
    "words distinct repeated common length longest upper shouted symbols marked bars digits foreign lines short"
).split()
_MARKED = re.compile(rb"[#$%&*]{2,}(?=[\x09-\x0d\x20]|$)")


def features(text: str | None) -> list[float]:
    """Surface features of a text, all bounded but the logarithms."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words) or 1, len(data) or 1
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    symbols = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) - int(count[[44, 46]].sum())
    lengths = list(map(len, words)) or [0]
    seen = Counter(words)
    return [
        np.log1p(len(words)),
        len(seen) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(seen.values(), default=0) / n,
        min(sum(lengths) / n, 40) / 10,
        np.log1p(max(lengths)),
        upper / (upper + lower or 1),
        int(count[33]) / n,
        symbols / size,
        len(_MARKED.findall(data)) / n,
        int(count[124]) / n,
        int(count[48:58].sum()) / size,
        int(count[128:].sum()) / size,
        int(count[10]) / n,
        1 / n,
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def expanded(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features, bounded, with their squares."""
    z = np.clip((x - mean) / spread, -8, 8)
    return np.hstack([z, z * z])


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        worth = expanded(_matrix(texts), self.mean, self.spread) @ self.weights
        return _logistic(self.slope * (worth - self.threshold) + np.log(CUT / (1 - CUT)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Adds up what a function of features and labels gives for all pieces of the rows.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def fit(x: np.ndarray, y: np.ndarray) -> Ranker | None:
    """A ranker from rows at hand; None without both labels."""
    return fitted(lambda part: part(x, y)) if 0 < np.sum(y == 1) < len(y) else None


def fitted(total: Total) -> Ranker:
    """A ranker from sums over all labelled rows, some of either label."""
    size = total(lambda x, y: np.array([np.sum(y == 0), np.sum(y == 1)], float))
    mean = total(lambda x, y: x.sum(0)) / size.sum()
    spread = np.sqrt(total(lambda x, y: ((x - mean) ** 2).sum(0)) / size.sum()) + 1e-6
    first = total(lambda x, y: expanded(x, mean, spread).sum(0)) / size.sum()
    second = total(lambda x, y: (z := expanded(x, mean, spread) - first).T @ z) / size.sum()
    k, pairs = 2 * len(mean), size[0] * size[1]

    def at(w: np.ndarray) -> tuple:
        """Loss, its slope, and what places a worth in a bin and weighs it there."""
        middle, reach = first @ w, 8 * np.sqrt(max(w @ second @ w, 0)) + 1e-9
        place = lambda s, y: _bins(s, middle - reach, middle + reach, BINS) + BINS * (y == 1)

        def part(x, y):
            z = expanded(x, mean, spread)
            own = place(z @ w, y)
            return np.stack([np.bincount(own, v, 2 * BINS) for v in [np.ones(len(y)), *z.T]])

        sums = total(part)
        n, worth = sums[0], sums[1:].T @ w / np.maximum(sums[0], 1)
        gap = worth[BINS:, None] - worth[None, :BINS]  # good by bad
        both = n[BINS:, None] * n[None, :BINS] / pairs
        miss = 1 - _logistic(gap)
        pull = np.concatenate([(both * miss).sum(0), -(both * miss).sum(1)]) / np.maximum(n, 1)
        bend = both * miss * (1 - miss)
        loss = (both * np.logaddexp(0, -gap)).sum() + DECAY / 2 * w @ w
        return loss, sums[1:] @ pull + DECAY * w, place, bend, sums[1:] / np.maximum(n, 1), n

    w, here = np.zeros(k), at(np.zeros(k))
    for _ in range(STEPS):
        loss, slope, place, bend, centre, n = here
        if np.abs(slope).max() < 1e-5:
            break
        weigh = np.concatenate([bend.sum(0), bend.sum(1)]) / np.maximum(n, 1)

        def curve(x, y):
            z = expanded(x, mean, spread)
            return (z * weigh[place(z @ w, y)][:, None]).T @ z

        cross = centre[:, BINS:] @ bend @ centre[:, :BINS].T
        step = np.linalg.solve(total(curve) - cross - cross.T + DECAY * np.eye(k), slope)
        for half in range(12):
            there = at(w - step / 2**half)
            if there[0] <= loss:
                break
        else:
            break  # as good as the bins can tell
        w, here = w - step / 2**half, there

    worths = lambda x: expanded(x, mean, spread) @ w
    threshold = _cut(total, worths, size)
    return Ranker(mean, spread, w, threshold, _slope(total, worths, threshold))


def _bins(s: np.ndarray, low: float, high: float, n: int) -> np.ndarray:
    return np.clip((s - low) * (n / (high - low)), 0, n - 1).astype(np.int64)


def _cut(total: Total, worths: Callable, size: np.ndarray) -> float:
    """The quantile of all worths at the share of label 0, between its two neighbours among them."""
    at = size[0] / size.sum() * (size.sum() - 1)
    below = int(at)

    def ranked(rank: int) -> float:
        """The worth with ``rank`` smaller ones, in bins that grow finer."""
        low, high = -1e4, 1e4  # beyond all worths: features are bounded, and the penalty bounds the weights
        while high - low > 1e-9:
            width = (high - low) / FINE
            upto = np.cumsum(total(lambda x, y: np.bincount(_bins(worths(x), low, high, FINE), minlength=FINE).astype(float)))
            i = int(np.searchsorted(upto, rank, "right"))
            low, high = low + i * width - 1e-3 * width, low + (i + 1) * width + 1e-3 * width
        return low

    a = ranked(below)
    return a if at == below else a + (at - below) * (ranked(below + 1) - a)


def _slope(total: Total, worths: Callable, threshold: float) -> float:
    """Slope of the curve that is ``CUT`` at the threshold, by Newton's method on fine bins at their mean worth."""

    def part(x, y):
        d = worths(x) - threshold
        own = _bins(d, -64, 64, FINE) + FINE * (y == 1)
        return np.stack([np.bincount(own, v, 2 * FINE) for v in (np.ones(len(d)), d)])

    n, d = total(part)
    d, y = d / np.maximum(n, 1), np.repeat([0, 1], FINE)
    a, offset = 1.0, np.log(CUT / (1 - CUT))
    for _ in range(50):
        p = _logistic(a * d + offset)
        a = float(np.clip(a - ((p - y) * n @ d) / ((p * (1 - p)) * n @ (d * d) + 1e-9), a / 2, a * 2))
    return float(np.clip(a, 1e-3, 1e3))


def labelled_features(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, train: Column) -> DataFrame:
    """``y, x``: label and features of every labelled row that ``train`` keeps; stored."""
    known = labels.filter(F.col(label).isin(0, 1) & train).select(doc_id, F.col(label).cast("int").alias("y")).distinct()
    own = docs.select(doc_id, text).filter(train)
    schema = T.StructType([own.schema[doc_id], T.StructField("x", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(_matrix(batch.column(1).to_pylist())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), x.cast(arrow.field(1).type)], schema=arrow)

    # features travel to the labels, not texts
    return stored(own.mapInArrow(run, schema).join(known, doc_id).select("y", "x"), "quality-features")


def summed(rows: DataFrame) -> Total:
    """Sums over rows ``y, x``: each task adds up its own, Spark the tasks'."""

    def total(part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = None
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                    one = part(x, batch.column(0).to_numpy(zero_copy_only=False))
                    made = one if made is None else made + one
            if made is not None:
                shape = pa.array([list(made.shape)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([shape, pa.array([made.tobytes()], pa.binary())], names=["shape", "sums"])

        made = rows.select("y", "x").mapInArrow(run, "shape array<int>, sums binary").rdd
        return made.map(lambda r: np.frombuffer(r["sums"]).reshape(r["shape"])).treeReduce(np.add)

    return total


def learn(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="quality", train=None) -> Ranker | None:
    """A ranker from the labelled rows that ``train`` keeps (default: all)."""
    rows = labelled_features(docs, labels, doc_id, text, label, F.lit(True) if train is None else train)
    return fitted(summed(rows)) if rows.select("y").distinct().count() == 2 else None


def with_score(df: DataFrame, text: str, ranker: Ranker | None, name: str = "score") -> DataFrame:
    """Every row with its score, computed where the row lies."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                score = ranker.score(texts) if ranker else np.full(len(texts), 0.5)
                cols = [c.cast(f.type) for c, f in zip(part.columns, arrow)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(score, pa.float64())], schema=arrow)

    return df.mapInArrow(run, schema)


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, ranker: Ranker | None, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id, score`` of every row."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return narrow.mapInArrow(_only_scores(ranker), schema)


def _only_scores(ranker: Ranker | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                score = ranker.score(texts) if ranker else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def accepted(docs: DataFrame, ranker: Ranker | None, text: str = "text", at_least: float = CUT) -> DataFrame:
    """The rows whose score reaches ``at_least``, with their columns."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return with_score(inner, "text", ranker).filter(F.col("score") >= at_least).select("row.*")


@query("op7_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = score_documents(docs, learn(docs, labels, train=~held_out("doc_id")))
    predicted = (F.col("score") >= CUT).cast("int")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"))
