"""Streaming jobs over folders that grow round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import safe_ratio
from colloquy.schema import ACCURACY_RECORD_DDL
from colloquy.sources.keyed_log import KeyedLog
from colloquy.sources.store import append_new_only, log_of


def ingest_shards(
    spark: SparkSession,
    source: str,
    schema,
    home: str,
    order: str,
    checkpoint: str,
    messages: str = "messages",
    files_per_trigger: int | None = None,
) -> None:
    """Take in all new training shards below ``source`` and append the rows not stored yet.

    Each micro-batch is deduplicated, tested against the filters of the stored parts and written as
    its own part; a batch that is run again replaces its part.  Parts are compacted as they grow many.
    """
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def store(batch: DataFrame, batch_id: int) -> None:
        append_new_only(batch, home, order, f"batch={batch_id}", messages)

    (
        reader.parquet(source)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def read_ingested(spark: SparkSession, home: str) -> DataFrame:
    """All rows taken in; no hash is stored twice, so nothing is merged."""
    return log_of(spark, home).read(merge=False)


def running_accuracy(spark: SparkSession, source: str, home: str, checkpoint: str) -> None:
    """Keep accuracy per (tag, round) up to date as record files land.

    An episode counts once for each tag and round, by the record that landed last (by the time of
    its file), so a round that is written again replaces what it had said. The stream itself keeps no state: a
    micro-batch is appended to a keyed log with a table per tag and round, only the tables it touched are
    counted again, and only their rows are appended to the result. A round that gets no more records costs nothing.
    """
    schema = (
        T.StructType.fromDDL(ACCURACY_RECORD_DDL).add("tag", T.StringType()).add("round", T.LongType())
    )
    landed = spark.readStream.schema(schema).json(source).select(
        "tag", "round", "episode_id", "is_correct",
        F.struct(F.col("_metadata.file_modification_time").alias("time"), "is_correct").alias("landed"),
        F.sha1(F.to_json(F.struct("tag", "round", "episode_id"))).alias("record"),
    )
    records, results = _records(spark, home), _results(spark, home)

    def publish(batch: DataFrame, batch_id: int) -> None:
        label = f"batch={batch_id}"
        name = F.concat_ws("_", F.hex("tag"), F.col("round").cast("string"))  # hexadecimal digits fit into any path
        records.append(batch, "landed", label, sinks=name)
        touched = records.labelled(label)
        if not touched:
            return
        counted = records.read(*touched).groupBy("tag", "round").agg(
            F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total")
        )
        rows = counted.select(
            "*", safe_ratio(F.col("correct"), F.col("total")).alias("accuracy"), F.lit(batch_id).alias("batch"),
            F.sha1(F.to_json(F.struct("tag", "round"))).alias("result"),
        )
        results.append(rows, "batch", label)
        for log, tables in ((records, touched), (results, ["rows"])):
            for table in tables:
                log.compact(table)

    (
        landed.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def _records(spark: SparkSession, home: str) -> KeyedLog:
    return KeyedLog(spark, f"{home}/records", "record", one_bucket=True, filters=False)


def _results(spark: SparkSession, home: str) -> KeyedLog:
    return KeyedLog(spark, f"{home}/results", "result", one_bucket=True, filters=False)


def read_accuracy(spark: SparkSession, home: str) -> DataFrame | None:
    """``tag, round, correct, total, accuracy`` as last published."""
    rows = _results(spark, home).read()
    return None if rows is None else rows.select("tag", "round", "correct", "total", "accuracy")
