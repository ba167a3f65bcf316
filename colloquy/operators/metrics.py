"""Accuracy, episode outcomes and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.functions.grading import grade_reward, is_rewarded
from colloquy.functions.text import boxed_last, final_verdict, safe_ratio
from colloquy.operators.joins import with_task


def last_step(steps: DataFrame, key: str = "uid", order: str = "turn_index") -> DataFrame:
    """The last step of each trajectory, reduced before the shuffle."""
    rest = [c for c in steps.columns if c != key]
    best = steps.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return best.select(key, *[F.col("__row")[c].alias(c) for c in rest]).select(*steps.columns)


def accuracy_records(generator_steps: DataFrame, tasks: DataFrame, grader=grade_reward) -> DataFrame:
    """One record per episode that has a generator step: its last public answer, graded.

    ``generator_steps`` needs ``uid, turn_index, student_response``.
    """
    final = last_step(generator_steps.select("uid", "turn_index", "student_response"))
    said = F.coalesce(F.col("student_response"), F.lit(""))
    graded = (
        with_task(final, tasks)
        .withColumn("generator_message", said)
        .withColumn("reward", grader(F.col("generator_message"), F.col("ground_truth")))
    )
    return graded.select(
        F.col("uid").alias("episode_id"),
        F.coalesce(F.col("question"), F.lit("")).alias("question"),
        "ground_truth",
        "generator_message",
        F.col("generator_message").alias("prediction_used"),
        boxed_last(F.col("generator_message")).alias("parsed_prediction"),
        F.coalesce(F.col("reward"), F.lit(0.0)).alias("reward"),
        is_rewarded(F.col("reward")).alias("is_correct"),
    )


def accuracy(records: DataFrame, *by: str) -> DataFrame:
    """Correct, total and ratio of the records; ratio 0 without records."""
    counted = records.groupBy(*by).agg(
        F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total")
    )
    return counted.withColumn("accuracy", safe_ratio(F.col("correct"), F.col("total")))


def episode_correct_any(verifier_steps: DataFrame) -> DataFrame:
    """Correct if any verifier step was rewarded above the threshold."""
    return verifier_steps.groupBy("uid").agg(
        F.bool_or(F.coalesce(F.col("reward"), F.lit(0.0)) > V.REWARD_THRESHOLD).alias("is_correct")
    )


def episode_correct_last(verifier_steps: DataFrame) -> DataFrame:
    """Correct if the last verifier step's raw text ends in the verdict ``correct``."""
    judged = verifier_steps.select("uid", "turn_index", final_verdict(F.col("student_response_raw")).alias("v"))
    last = judged.groupBy("uid").agg(F.max_by(F.struct("v"), "turn_index").alias("last"))
    return last.select("uid", F.coalesce(F.col("last")["v"] == V.VERDICT_CORRECT, F.lit(False)).alias("is_correct"))


def label_counts(steps: DataFrame) -> DataFrame:
    """Labelled steps by role."""
    return (
        steps.filter(F.coalesce(F.col("teacher_target"), F.lit("")) != "")
        .groupBy("role")
        .agg(F.count(F.lit(1)).alias("labelled"))
    )


def early_stop(steps: DataFrame, max_turns: int, verdict: str = "verdict", key: str = "uid") -> DataFrame:
    """Steps up to and including the first ``correct`` verdict, and below ``max_turns``.

    Steps beyond ``max_turns`` go first, so a group holds at most that many rows per role.
    """
    limit = max(int(max_turns), 1)
    stop = F.min(F.when(F.col(verdict) == V.VERDICT_CORRECT, F.col("turn_index"))).over(Window.partitionBy(key))
    return (
        steps.filter(F.col("turn_index") < limit)
        .withColumn("__stop", stop)
        .filter(F.col("__stop").isNull() | (F.col("turn_index") <= F.col("__stop")))
        .drop("__stop")
    )
