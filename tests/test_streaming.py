import os

from pyspark.sql import functions as F

from colloquy.session import Files, new_folder
from colloquy.sources import store
from colloquy.streaming.ingest import ingest_shards, read_accuracy, read_ingested, running_accuracy

SCHEMA = "messages string, seq bigint"


def test_ingest_equals_the_batch_result(spark):
    base = new_folder(spark, "ingest")
    data = spark.range(200).select((F.col("id") % 37).cast("string").alias("messages"), F.col("id").alias("seq"))
    for i in range(4):
        data.filter(F.col("seq") % 4 == i).coalesce(1).write.parquet(f"{base}/in/r{i}")
        ingest_shards(spark, f"{base}/in", SCHEMA, f"{base}/store", "seq", f"{base}/progress", files_per_trigger=1)
    got = read_ingested(spark, f"{base}/store")
    store.append_distinct(data, f"{base}/batch", "seq")
    want = store.read_store(spark, f"{base}/batch")
    assert sorted(r["msg_hash"] for r in got.collect()) == sorted(r["msg_hash"] for r in want.collect())
    # nothing new: nothing happens
    parts = Files(spark, base).children(f"{base}/store")
    ingest_shards(spark, f"{base}/in", SCHEMA, f"{base}/store", "seq", f"{base}/progress")
    assert Files(spark, base).children(f"{base}/store") == parts


def test_running_accuracy(spark):
    base = new_folder(spark, "running")
    record = lambda ok, n: spark.range(n).select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("episode_id"), F.lit("q").alias("question"), F.lit("1").alias("ground_truth"),
        F.lit("m").alias("generator_message"), F.lit("m").alias("prediction_used"), F.lit("1").alias("parsed_prediction"),
        F.lit(float(ok)).alias("reward"), F.lit(ok).alias("is_correct"),
    )
    store.write_accuracy_records(record(True, 3), f"{base}/in", "train", 1)
    running_accuracy(spark, f"{base}/in", f"{base}/out", f"{base}/progress")
    store.write_accuracy_records(record(False, 2), f"{base}/in", "train", 2)
    store.write_accuracy_records(record(True, 1), f"{base}/in", "eval", 2)
    running_accuracy(spark, f"{base}/in", f"{base}/out", f"{base}/progress")
    got = {(r["tag"], r["round"]): (r["correct"], r["total"], r["accuracy"]) for r in read_accuracy(spark, f"{base}/out").collect()}
    assert got == {("train", 1): (3, 3, 1.0), ("train", 2): (0, 2, 0.0), ("eval", 2): (1, 1, 1.0)}
    # a round that is written again replaces what it had said, whatever its new files are called
    store.write_accuracy_records(record(False, 3), f"{base}/in", "train", 1)
    running_accuracy(spark, f"{base}/in", f"{base}/out", f"{base}/progress")
    got = {(r["tag"], r["round"]): (r["correct"], r["total"]) for r in read_accuracy(spark, f"{base}/out").collect()}
    assert got == {("train", 1): (0, 3), ("train", 2): (0, 2), ("eval", 2): (1, 1)}
    # what a batch did not touch is neither read nor written again
    size = lambda: sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(f"{base}/out") for n in names)
    before = size()
    store.write_accuracy_records(record(True, 5000), f"{base}/in", "train", 3)
    running_accuracy(spark, f"{base}/in", f"{base}/out", f"{base}/progress")
    middle = size()
    store.write_accuracy_records(record(True, 1), f"{base}/in", "eval", 4)
    running_accuracy(spark, f"{base}/in", f"{base}/out", f"{base}/progress")
    assert size() - middle < 0.2 * (middle - before)
    got = {(r["tag"], r["round"]): (r["correct"], r["total"]) for r in read_accuracy(spark, f"{base}/out").collect()}
    assert got[("train", 3)] == (5000, 5000) and got[("eval", 4)] == (1, 1) and len(got) == 5
