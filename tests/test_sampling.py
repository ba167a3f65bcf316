import hashlib

import pytest
from pyspark.sql import functions as F

from colloquy.operators import sampling


@pytest.fixture(scope="module")
def data(spark):
    q = F.when(F.col("id") % 4 == 1, F.lit("")).when(F.col("id") % 9 == 2, F.lit(None)).otherwise(F.concat(F.lit("q"), "id"))
    return spark.range(101).select(F.col("id").alias("source_idx"), q.alias("question")).cache()


def empty(i):
    return i % 4 == 1 or i % 9 == 2


def walk(size, n, start, shard, shards):
    """The sequential walk, spelled out."""
    idx = [i for i in range(size) if i % shards == shard]
    if not idx:
        return []
    start %= len(idx)
    return [i for i in idx[start:] + idx[:start] if not empty(i)][:n]


@pytest.mark.parametrize("n", [0, 1, 5, 20, 1000])
@pytest.mark.parametrize("start,shard,shards", [(0, 0, 1), (90, 0, 1), (7, 1, 3), (1000, 2, 3), (3, 6, 7)])
def test_sequential(data, n, start, shard, shards):
    got = sampling.sample_sequential(data, n, start, shard, shards).orderBy("batch_pos").collect()
    assert [r["source_idx"] for r in got] == walk(101, n, start, shard, shards)
    assert [r["batch_pos"] for r in got] == list(range(len(got)))


def test_flag_column_is_used(data):
    flagged = data.withColumn("has_question", sampling.has_question(F.col("question")))
    got = sampling.sample_sequential(flagged, 12, 95).orderBy("batch_pos").collect()
    assert [r["source_idx"] for r in got] == walk(101, 12, 95, 0, 1)


@pytest.mark.parametrize("pairs,n,start,shard,shards", [(5, 10, 0, 0, 1), (8, 30, 13, 0, 1), (3, 500, 2, 1, 2), (4, 7, 50, 2, 3)])
def test_all_batches_at_once(data, pairs, n, start, shard, shards):
    got = sampling.round_batches(data, pairs, n, start, shard, shards).orderBy("pair_idx", "k").collect()
    for p in range(pairs):
        mine = [r["source_idx"] for r in got if r["pair_idx"] == p]
        assert mine == walk(101, n, start + p * n, shard, shards)


def test_no_batches(data):
    assert sampling.round_batches(data, 3, 0).count() == 0
    assert sampling.round_batches(data.filter("false"), 3, 5).count() == 0
    assert sampling.sample_sequential(data.filter("false"), 3).count() == 0
    assert sampling.sample_random(data.filter("false"), 3).count() == 0


def test_one_pass_covers_every_task_once(data):
    usable = [i for i in range(101) if not empty(i)]
    got = sampling.sample_sequential(data, 10**6, 40).collect()
    assert sorted(r["source_idx"] for r in got) == usable


def key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i


@pytest.mark.parametrize("n", [0, 10, 101, 10**9])
def test_random(data, n):
    order = sorted(range(101), key=lambda i: key(5, i))[:n]
    got = sampling.sample_random(data, n, seed=5).collect()
    assert sorted(r["source_idx"] for r in got) == sorted(i for i in order if not empty(i))
    whole = sampling.sample_random_all(data, n, seed=5).orderBy("sample_pos").collect()
    assert [r["source_idx"] for r in whole] == (order if n < 101 else list(range(101)))


def test_shard_arguments(data):
    for shard, shards in ((0, 0), (-1, 2), (2, 2)):
        with pytest.raises(ValueError):
            sampling.shard_filter(data, shard, shards)
    parts = [sampling.shard_filter(data, k, 3).count() for k in range(3)]
    assert sum(parts) == 101


def test_schedule(spark):
    rows = sampling.round_schedule(spark, 3, 10, seed=4, start=2).orderBy("round").collect()
    assert [r["role"] for r in rows] == ["gen", "ver"] * 3
    assert [r["pair_idx"] for r in rows] == [0, 0, 1, 1, 2, 2]
    assert [r["seed"] for r in rows] == [5, 5, 6, 6, 7, 7]
    assert [r["start"] for r in rows] == [2, 2, 12, 12, 22, 22]
    assert [r["seed"] for r in sampling.fresh_schedule(spark, 2, 9).orderBy("round").collect()] == [10, 11, 12, 13]
    assert sampling.eval_rounds(spark, 3, 2, 100) == [(2, 102), (4, 104), (6, 106)]
