"""Ranks, running totals, top-n and dense indexes against plain windows and sorts."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import batching, dedupe, ordinals
from colloquy.session import Files, new_folder
from colloquy.sources import datasets


@pytest.fixture(scope="module")
def rows(spark):
    # a third of the rows share one key, another part has no key
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 != 0, (F.col("id") % 50).cast("string")).alias("k"),
        (F.col("id") * 7919 % 3001 - 500).alias("o"),
        (F.col("id") % 11).alias("v"),
    )
    return df.cache()


@pytest.mark.parametrize("levels", [0, 1, 2, 3])
@pytest.mark.parametrize("keys", [["k"], []])
def test_running_total_equals_the_plain_window(rows, keys, levels):
    w = Window.partitionBy(*keys).orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r["k"], r["o"]): r["t"] for r in rows.withColumn("t", F.sum("v").over(w)).collect()}
    got = ordinals.running_total(rows, keys, ["o"], F.col("v"), "t", width=16, levels=levels)
    assert {(r["k"], r["o"]): r["t"] for r in got.collect()} == want
    assert got.columns == [*rows.columns, "t"]


def test_ranks_start_at_zero(rows):
    got = ordinals.rank_rows(rows, ["k"], ["o"], "r", width=64)
    w = Window.partitionBy("k").orderBy("o")
    want = rows.withColumn("r", F.row_number().over(w) - 1)
    assert sorted(map(tuple, got.select("o", "r").collect())) == sorted(map(tuple, want.select("o", "r").collect()))


def test_rows_are_shuffled_once(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ordinals.rank_rows(rows, ["k"], ["o"], "r", width=64)._jdf.queryExecution().sparkPlan().toString()
        executed = ordinals.rank_rows(rows, ["k"], ["o"], "r", width=64)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    left = executed.split("SortMergeJoin")[1].split("InMemoryTableScan")[0]
    assert left.count("Exchange") == 1


def test_sparse_orders_get_more_levels(spark, rows):
    assert ordinals._levels_for(rows, "o", 1 << 16) == 0
    assert ordinals._levels_for(rows, "o", 64) == 1
    sparse = rows.select("k", (F.col("o") * 1_000_003_000_007).alias("o"))
    assert ordinals._levels_for(sparse, "o", 1 << 16) == 3
    assert ordinals._levels_for(rows.filter("false"), "o", 64) == 0
    w = Window.partitionBy("k").orderBy("o")
    want = sparse.withColumn("r", F.row_number().over(w) - 1)
    got = ordinals.rank_rows(sparse, ["k"], ["o"], "r")
    assert sorted(map(tuple, got.select("o", "r").collect())) == sorted(map(tuple, want.select("o", "r").collect()))


@pytest.mark.parametrize("n", [0, 1, 37, 1000, 2999, 5000])
def test_smallest(rows, n):
    keyed = rows.withColumn("h", F.md5(F.col("o").cast("string").cast("binary")))
    order = [F.col("h"), F.col("o")]
    want = [r["o"] for r in keyed.orderBy(*order).collect()][:n]
    got = ordinals.smallest(keyed, ordinals.hash_bucket(F.col("h")), order, n)
    assert sorted(r["o"] for r in got.collect()) == sorted(want)
    placed = ordinals.smallest(keyed, ordinals.hash_bucket(F.col("h")), order, n, position="p")
    assert [r["o"] for r in placed.orderBy("p").collect()] == want
    assert [r["p"] for r in placed.orderBy("p").collect()] == list(range(len(want)))


@pytest.mark.parametrize("few", [1 << 17, 0])
def test_dense_index(spark, rows, few, monkeypatch):
    """With offsets broadcast, and met in a shuffle."""
    monkeypatch.setattr(ordinals, "BROADCAST_BLOCKS", few)
    raw, folder = new_folder(spark, "raw"), new_folder(spark, "dense")
    rows.repartition(5).write.parquet(raw)
    ordinals.write_indexed(datasets.scan_in_order(spark, raw), folder)
    got = ordinals.read_indexed(spark, folder)
    assert sorted(r["source_idx"] for r in got.collect()) == list(range(3000))
    assert got.columns == [*rows.columns, "source_idx"]
    in_files = [r["o"] for f in sorted(Files(spark, raw).children(raw)) if f.endswith(".parquet") for r in spark.read.parquet(f"{raw}/{f}").collect()]
    assert [r["o"] for r in got.orderBy("source_idx").collect()] == in_files


def test_batches(rows):
    got = batching.request_batches(rows, ["k"], ["o"], 10).groupBy("k", "batch").count().collect()
    assert max(r["count"] for r in got) == 10
    assert sum(r["count"] for r in got) == 3000
    assert {r["batch"] for r in batching.request_batches(rows, ["k"], ["o"], 0).collect()} == {0}


def test_keep_last_is_idempotent(rows):
    once = dedupe.keep_last(rows, "v", "o")
    twice = dedupe.keep_last(once, "v", "o")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.count() == 11


def test_hot_keys_collapse_before_the_shuffle(rows):
    plan = dedupe.keep_last(rows, "v", "o")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max_by") > plan.index("Exchange")  # the partial step feeds the exchange
    assert plan.count("Exchange") == 1
