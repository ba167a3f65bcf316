"""Sharding, sampling and round schedules over a densely indexed dataset.

Every function takes a DataFrame with a dense ``source_idx`` from 0 (assigned once, at
registration).  Sizes and cut-offs, single numbers, come from small jobs over narrow columns
and enter the plan as literals; rows are never collected and no table is sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.ordinals import (
    furthest_needed,
    hash_bucket,
    running_total,
    scaled_bucket,
    smallest,
)

INDEX = "source_idx"
HAS_QUESTION = "has_question"


def task_uid(split: str, index: Column) -> Column:
    return F.concat_ws("_", F.lit(split), index.cast("string"))


def has_question(question: Column) -> Column:
    return F.coalesce(question != "", F.lit(False))


def usable(df: DataFrame, question: str) -> DataFrame:
    """Rows with a question; read off the narrow flag where the dataset has one."""
    return df.filter(F.col(HAS_QUESTION) if HAS_QUESTION in df.columns else has_question(F.col(question)))


def shard_filter(df: DataFrame, shard: int, shards: int) -> DataFrame:
    """Rows of one of ``shards`` modulo shards."""
    if shards < 1:
        raise ValueError("the number of shards must be at least 1")
    if not 0 <= shard < shards:
        raise ValueError(f"the shard must lie in [0, {shards - 1}]")
    return df if shards == 1 else df.filter(F.pmod(F.col(INDEX), F.lit(shards)) == shard)


def _with_shard_position(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("__pos", F.expr(f"{INDEX} div {shards}"))


def _shard_size(df: DataFrame, shard: int, shards: int) -> int:
    """Rows of the shard; follows from the dataset's size and its index, which must be dense (checked)."""
    rows, last = df.agg(F.count(F.lit(1)), F.max(INDEX)).first()
    if rows and last != rows - 1:
        raise ValueError(f"{INDEX} must number the rows from 0 without gaps: {rows} rows, but the last is {last}")
    return max((rows - shard + shards - 1) // shards, 0)


def shuffle_key(seed: int, index: Column) -> Column:
    """Sort key of the seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), index.cast("string")).cast("binary"))


def _shuffled_first(df: DataFrame, n: int, seed: int) -> DataFrame:
    keyed = df.withColumn("__key", shuffle_key(seed, F.col(INDEX)))
    return smallest(keyed, hash_bucket(F.col("__key")), [F.col("__key"), F.col(INDEX)], n).drop("__key")


def sample_random(
    df: DataFrame, n: int, seed: int = 0, shard: int = 0, shards: int = 1, question: str = "question"
) -> DataFrame:
    """``n`` rows of a seeded shuffle of the shard, of which those without a question are
    dropped afterwards; so there may be fewer than ``n``.

    The sample is drawn from the index column alone and then met with the wide columns; how, Spark
    decides by the sample's size.
    """
    drawn = _shuffled_first(shard_filter(df.select(INDEX), shard, shards), n, seed)
    return usable(df, question).join(drawn, INDEX, "left_semi")


def sample_random_all(df: DataFrame, n: int, seed: int = 0, out: str = "sample_pos") -> DataFrame:
    """``n`` rows of a seeded shuffle with their position in the sample; the whole dataset
    in its own order when it has no more than ``n`` rows.  No row is dropped."""
    if n >= df.count():
        return df.withColumn(out, F.col(INDEX).cast("bigint"))
    placed = df.withColumn("__key", shuffle_key(seed, F.col(INDEX)))
    taken = smallest(placed, hash_bucket(F.col("__key")), [F.col("__key"), F.col(INDEX)], n, position=out)
    return taken.drop("__key")


def sample_sequential(
    df: DataFrame,
    n: int,
    start: int = 0,
    shard: int = 0,
    shards: int = 1,
    question: str = "question",
    position: str = "batch_pos",
) -> DataFrame:
    """The first ``n`` rows with a question on a walk over the shard from ``start``, wrapping
    around, at most one full pass; ``batch_pos`` numbers them in walk order.

    The walk's stretch is found from narrow columns; its bounds on the stored index
    then reach the scan, which skips the row groups outside.
    """
    n = max(int(n), 0)
    size = _shard_size(df, shard, shards)
    first = max(int(start), 0) % max(size, 1)

    def walk(rows: DataFrame) -> DataFrame:
        placed = _with_shard_position(usable(shard_filter(rows, shard, shards), question), shards)
        return placed.withColumn("__rot", F.pmod(F.col("__pos") - first, F.lit(max(size, 1))))

    bucket = scaled_bucket(F.col("__rot"), size)
    reach = furthest_needed(walk(df), bucket, "__rot", n)
    index = F.col(INDEX)
    ahead = index.between(first * shards, (first + reach) * shards + shard)
    wrapped = index <= (first + reach - size) * shards + shard
    near = df.filter(ahead | wrapped if first + reach >= size else ahead)
    taken = smallest(walk(near), bucket, [F.col("__rot")], n, position=position)
    return taken.drop("__pos", "__rot")


def round_schedule(
    spark: SparkSession, rounds: int, batch: int, seed: int = 0, start: int = 0
) -> DataFrame:
    """One row per round, ``2 * rounds`` of them: odd rounds train the generator, even ones the
    verifier on the same pair's tasks."""
    return spark.range(1, 2 * rounds + 1, 1, 1).select(
        F.col("id").alias("round"),
        F.when(F.col("id") % 2 == 1, "gen").otherwise("ver").alias("role"),
        F.expr("(id - 1) div 2").alias("pair_idx"),
        (F.expr("(id - 1) div 2") + seed + 1).alias("seed"),
        (F.expr("(id - 1) div 2") * batch + start).alias("start"),
    )


def fresh_schedule(spark: SparkSession, rounds: int, seed: int = 0) -> DataFrame:
    """Schedule with a new sample in every round."""
    return spark.range(1, 2 * rounds + 1, 1, 1).select(
        F.col("id").alias("round"),
        F.when(F.col("id") % 2 == 1, "gen").otherwise("ver").alias("role"),
        (F.col("id") + seed).alias("seed"),
    )


def round_batches(
    df: DataFrame,
    pairs: int,
    n: int,
    start: int = 0,
    shard: int = 0,
    shards: int = 1,
    question: str = "question",
) -> DataFrame:
    """Sequential batches of all round pairs at once: ``pair_idx, k`` and the task's columns.

    Non-empty tasks are ranked once.  The pairs' start positions go through the same
    ranking as marker rows, which yields how many tasks lie before each start; slots
    then meet tasks in one equi-join on the rank.
    """
    spark = df.sparkSession
    part = _with_shard_position(shard_filter(df, shard, shards), shards)
    size = max(_shard_size(df, shard, shards), 1)
    asked = usable(part, question)
    total = asked.count()
    if n <= 0 or total == 0:
        none = F.lit(None).cast("bigint")
        return df.withColumns({"pair_idx": none, "k": none}).limit(0)
    marks = spark.range(pairs).select(
        F.pmod(F.lit(max(int(start), 0)) + F.col("id") * n, F.lit(size)).alias("__pos"),
        F.lit(0).alias("__task"),
        F.col("id").alias("pair_idx"),
        F.lit(None).cast("bigint").alias(INDEX),
    )
    tasks = asked.select(
        "__pos", F.lit(1).alias("__task"), F.lit(-1).cast("bigint").alias("pair_idx"), F.col(INDEX)
    )
    ranked = running_total(
        tasks.unionByName(marks), [], ["__pos", "__task", "pair_idx"], F.col("__task"), "__upto"
    )
    slots = (
        ranked.filter(F.col("__task") == 0)
        .select("pair_idx", F.col("__upto").alias("__first"))
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(min(n, total) - 1).cast("bigint"))))
        .select("pair_idx", "k", F.pmod(F.col("__first") + F.col("k"), F.lit(max(total, 1))).alias("__rank"))
    )
    numbered = ranked.filter(F.col("__task") == 1).select(INDEX, (F.col("__upto") - 1).alias("__rank"))
    placed = slots.join(numbered, "__rank").select("pair_idx", "k", INDEX)
    return placed.join(asked.drop("__pos"), INDEX)


def pair_tasks(rounds: DataFrame, batches: DataFrame) -> DataFrame:
    """Tasks of each round: both rounds of a pair share the pair's batch.

    ``rounds`` has two rows per pair, a number set by the job, and is broadcast.
    """
    return batches.join(F.broadcast(rounds.select("round", "role", "pair_idx")), "pair_idx")


def eval_rounds(spark: SparkSession, rounds: int, every: int, seed: int) -> list[tuple[int, int]]:
    """``(round, sample seed)`` of the rounds that evaluate."""
    return [(r, seed + r) for r in range(1, 2 * rounds + 1) if every > 0 and r % every == 0]

