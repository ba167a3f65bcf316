"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are packed into blocks inside the tasks that read them. Query blocks and candidate blocks are
dealt over a grid of cells, so that every pair of blocks meets once; in a cell, each term's posting
list is weighted and scattered into a dense array of scores (query x candidate), then every query's
best k are selected by partitioning, and the partial lists are merged per query by a ranked window
that keeps k rows a task before its shuffle. Nothing is broadcast; the grid follows the row counts.

Sums are taken in the narrowest type that holds them exactly (checked per pair of blocks).

Defined results: a null vector, or one holding a null or non-finite component, takes no part;
components of 0 and those that a shorter vector lacks add nothing, so an empty vector scores 0
with all; rows that repeat all take part, but a candidate with the query's id counts as the
query's own and is left out, and a query id that repeats gets one list of k; equal scores go to
the smaller id; an empty table gives an empty result. Extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.common import table
from colloquy.llm.registry import query

#: Rows of a candidate block, of a query block, and the queries whose scores are held at once.
CANDIDATES, QUERIES_, HELD = 8192, 512, 32
#: Rows of one cell of the grid.
CELL_CANDIDATES, CELL_QUERIES = 32_768, 2_048

_BLOCK = "ids binary, terms int, weights binary"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where the vector takes no part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Pack (id, weights) into blocks of at most ``limit`` rows, ordered by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                part = batch.slice(at, limit)
                ids, lists = part.column("id").to_numpy(zero_copy_only=False), part.column("weights")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                dense = np.zeros((len(ids), max(int(sizes.max()), 1)), np.int64)
                dense[np.arange(dense.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                most = max(abs(int(dense.max())), abs(int(dense.min())))
                kind = next((k for k in (np.int16, np.int32) if most <= np.iinfo(k).max), np.int64)
                cols = [[ids[order].tobytes()], [dense.shape[1]], [np.ascontiguousarray(dense[order].astype(kind)).tobytes()]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.binary()))],
                    names=["ids", "terms", "weights"],
                )

    return rows.mapInArrow(run, _BLOCK)


def unpack(ids: bytes, terms: int, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    key = np.frombuffer(ids, np.int64)
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(weights) // (len(key) * terms)]
    return key, np.frombuffer(weights, kind).reshape(len(key), terms)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores (query x candidate), one term after the other."""
    terms = min(queries.shape[1], candidates.shape[1])
    most = lambda a: int(np.abs(a.astype(np.int64)).max(initial=0))
    bound = most(queries) * most(candidates) * max(terms, 1)
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    scores = np.zeros((len(queries), len(candidates)), kind)
    weights = queries[:, :terms].astype(kind)
    postings = np.ascontiguousarray(candidates[:, :terms].T.astype(kind))
    added = np.empty_like(scores)
    for t in range(terms):
        weight, posting = weights[:, t], postings[t]
        rows, where = np.flatnonzero(weight), np.flatnonzero(posting)
        if not len(rows) or not len(where):
            continue
        if len(where) < len(posting) // 4:
            scores[np.ix_(rows, where)] += np.multiply.outer(weight[rows], posting[where])
        elif len(rows) < len(weight) // 2:
            scores[rows] += np.multiply.outer(weight[rows], posting)
        else:
            np.multiply.outer(weight, posting, out=added)
            scores += added
    return scores


def select(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's best k of a block ordered by id."""
    exact = scores.astype(np.int64)
    n = len(ids)
    own = (np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right"))
    kept = np.ones(exact.shape, bool)
    for row in np.flatnonzero(own[1] > own[0]):
        kept[row, own[0][row] : own[1][row]] = False
    if n <= k:
        rows, cols = np.nonzero(kept)
        return query_ids[rows], ids[cols], exact[rows, cols]
    if np.abs(exact).max(initial=0) < (1 << 62) // n:
        key = exact * n + (n - 1 - np.arange(n))
        key[~kept] = np.iinfo(np.int64).min
        cols = np.argpartition(key, n - k, axis=1)[:, n - k :]
    else:
        cols = np.lexsort((np.broadcast_to(-np.arange(n), exact.shape), exact, kept), axis=1)[:, n - k :]
    rows = np.broadcast_to(np.arange(len(exact))[:, None], cols.shape)
    good = kept[rows, cols]
    return query_ids[rows[good]], ids[cols[good]], exact[rows, cols][good]


def search(rows: DataFrame, vec_id: str, weights: Column, is_query: Column, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of every query row."""
    base = rows.select(F.col(vec_id).cast("long").alias("id"), weights.alias("weights"), is_query.alias("q"))
    base = base.filter(F.col("id").isNotNull() & F.col("weights").isNotNull())
    n, n_queries = base.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    across, down = -(-n // CELL_CANDIDATES) or 1, -(-n_queries // CELL_QUERIES) or 1
    left = blocks(base.filter("q").dropDuplicates(["id", "weights"]).select("id", "weights"), QUERIES_)
    right = blocks(base.select("id", "weights"), CANDIDATES)
    lane = lambda count: F.pmod(F.xxhash64("ids"), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = left.select("*", lane(down).alias("row"), every(across).alias("col"))
    right = right.select(*[F.col(c).alias(f"c_{c}") for c in right.columns], lane(across).alias("col"), every(down).alias("row"))
    schema = "query_id long, vec_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_ids, q = unpack(row["ids"], row["terms"], row["weights"])
                ids, c = unpack(row["c_ids"], row["c_terms"], row["c_weights"])
                found = [select(accumulate(q[a : a + HELD], c), q_ids[a : a + HELD], ids, k) for a in range(0, len(q), HELD)]
                arrays = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    met = left.join(right, ["row", "col"]).select(*left.columns[:3], *right.columns[:3])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.mapInArrow(run, schema).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(q.w, c.w)]), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query("op6_exact_topk", _SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return search(rows, "vec_id", quantised(F.col("embedding"), 64), F.col("vec_id") % 20 == 0, 20)
