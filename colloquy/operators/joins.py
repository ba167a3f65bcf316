"""Equi-joins on explicit keys, in place of pairing by list position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.functions.grading import missing
from colloquy.functions.messages import clean_context
from colloquy.functions.text import py_strip
from colloquy.schema import STEP_KEY


def merge_replicas(*replicas: DataFrame) -> DataFrame:
    """Outputs of several replicas as one table; order is carried by the request key."""
    return reduce(lambda a, b: a.unionByName(b), replicas)


def one_per_key(rows: DataFrame, keys, text: str, arrival: str | None = None) -> DataFrame:
    """``keys`` and ``text``, once per key: the last arrival's, or without an arrival the largest text.

    A NULL text gives way to any other. Copies collapse within each task, before the shuffle.
    """
    order = F.struct(F.col(text).isNotNull(), *([F.col(arrival)] if arrival else []), F.col(text))
    return rows.groupBy(*keys).agg(F.max_by(text, order).alias(text))


def join_responses(
    requests: DataFrame, responses: DataFrame, keys=STEP_KEY, text: str = "text", arrival: str | None = None
) -> DataFrame:
    """Responses onto requests; a lost one becomes the empty string, a repeated one counts once."""
    joined = requests.join(one_per_key(responses, keys, text, arrival), list(keys), "left")
    return joined.withColumn(text, py_strip(F.coalesce(F.col(text), F.lit(""))))


def select_unlabelled(steps: DataFrame, roles=("generator", "verifier")) -> DataFrame:
    """Steps of the wanted roles without a target and with a usable teacher prompt, as requests."""
    return (
        steps.filter(F.col("role").isin(*roles) & missing(F.col("teacher_target")))
        .select(*STEP_KEY, clean_context(F.col("teacher_prompt")).alias("prompt"))
        .filter(F.size("prompt") > 0)
    )


def pending_requests(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """Requests that have no label yet."""
    return requests.join(labels.select(*STEP_KEY), list(STEP_KEY), "left_anti")


def apply_labels(steps: DataFrame, labels: DataFrame, arrival: str | None = None) -> DataFrame:
    """Teacher labels onto steps; a target already there stays, a repeated label counts once."""
    fresh = one_per_key(labels, STEP_KEY, "text", arrival).select(*STEP_KEY, F.coalesce(py_strip(F.col("text")), F.lit("")).alias("__label"))
    takes = missing(F.col("teacher_target")) & F.col("__label").isNotNull()
    joined = steps.join(fresh, list(STEP_KEY), "left")
    return joined.withColumns(
        {
            "teacher_status": F.when(takes, V.TEACHER_STATUS).otherwise(F.col("teacher_status")),
            "teacher_justification": F.when(takes, V.TEACHER_JUSTIFICATION).otherwise(
                F.col("teacher_justification")
            ),
            "teacher_target": F.when(takes, F.col("__label")).otherwise(F.col("teacher_target")),
        }
    ).select(*steps.columns)


def with_task(steps: DataFrame, tasks: DataFrame, columns=("question", "ground_truth")) -> DataFrame:
    """Each step with its task's columns; tasks are unique per uid.

    Tasks have one row per key, so AQE can split the steps of a hot one.
    """
    return steps.drop(*columns).join(tasks.select("uid", *columns), "uid", "left")
