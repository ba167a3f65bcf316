"""Training rows from labelled steps: one projection with an ordered list of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.functions import prompts
from colloquy.functions.grading import answer_is_correct, expected_verdict, grade_reward, missing
from colloquy.functions.hashing import message_hash
from colloquy.functions.messages import (
    clean_context,
    drop_trailing_assistant,
    message,
    messages_of,
    repair_generator_context,
    with_target,
)
from colloquy.functions.text import final_verdict, think_incomplete

KEPT = "kept"


def quality_reason(grader=grade_reward, context: str | None = "context"):
    """Why a labelled step of the judged protocol gives no row, or ``kept``.

    A CASE stops at its first hit, so answers are graded only where the grade decides.
    ``context=None`` leaves the rebuilt-context check out.
    """
    generates = F.col("role") == "generator"
    truth, target = F.col("ground_truth"), F.col("teacher_target")
    wrong = ~answer_is_correct(target, truth, grader)
    expected = expected_verdict(
        F.col("generator_message_raw"), F.col("student_response_raw"), truth, grader
    )
    disagrees = expected.isNotNull() & ~final_verdict(target).eqNullSafe(expected)
    reason = (
        F.when(missing(target), "no_target")
        .when(generates & missing(F.col("question")), "empty_question")
        .when(generates & F.coalesce(wrong, F.lit(False)), "gt_mismatch")
        .when(generates & think_incomplete(target), "think_incomplete")
        .when(~generates & ~missing(truth) & disagrees, "gt_mismatch")
    )
    if context is not None:
        broken = missing(F.col("question")) | missing(F.col("generator_message"))
        reason = reason.when(~generates & (F.size(context) == 0) & broken, "empty_context")
    return reason.otherwise(KEPT)


def _reasoned(steps: DataFrame, grader) -> DataFrame:
    context = drop_trailing_assistant(clean_context(F.col("chat_completions")))
    return steps.withColumn("context", context).withColumn("reason", quality_reason(grader))


def _judged_messages() -> Column:
    """Training messages of a step that is kept."""
    rebuilt = messages_of(
        message("system", F.lit(V.JUDGED_VERIFIER_SYSTEM)),
        message("user", prompts.verify_prompt(F.col("question"), F.col("generator_message"))),
    )
    generator = repair_generator_context(F.col("context"), F.col("question"))
    verifier = F.when(F.size("context") == 0, rebuilt).otherwise(F.col("context"))
    chosen = F.when(F.col("role") == "generator", generator).otherwise(verifier)
    return with_target(chosen, F.col("teacher_target"))


def judged_candidates(steps: DataFrame, grader=grade_reward) -> DataFrame:
    """All steps with the reason and, where kept, the training messages."""
    kept = F.when(F.col("reason") == KEPT, _judged_messages())
    return _reasoned(steps, grader).withColumn("messages", kept).drop("context")


def judged_rows(steps: DataFrame, grader=grade_reward) -> DataFrame:
    """Training rows of the judged protocol with their lineage.

    The reason is needed by the filter only, so answers are graded once.
    """
    kept = _reasoned(steps, grader).filter(F.col("reason") == KEPT)
    return _rows(kept.withColumn("messages", _judged_messages()))


def tagged_rows(steps: DataFrame) -> DataFrame:
    """Training rows of the tagged protocol: every labelled step, no quality filter.

    Generator rows keep the context; verifier rows are rebuilt from the template.
    """
    context = drop_trailing_assistant(clean_context(F.col("chat_completions")))
    generator = repair_generator_context(context, F.col("question"))
    verifier = messages_of(
        message("system", F.lit(V.TAGGED_VERIFIER_SYSTEM)),
        message("user", prompts.tagged_verify_prompt(F.col("question"), F.col("generator_message"))),
    )
    chosen = F.when(F.col("role") == "generator", generator).otherwise(verifier)
    labelled = steps.filter(~missing(F.col("teacher_target")))
    return _rows(labelled.withColumn("messages", with_target(chosen, F.col("teacher_target"))))


def _rows(candidates: DataFrame) -> DataFrame:
    return candidates.select("uid", "role", "turn_index", "messages").withColumn(
        "msg_hash", message_hash(F.col("messages"))
    )


def funnel(candidates: DataFrame) -> DataFrame:
    """Rows by role and reason, and how many of them had no ground truth to check against."""
    return candidates.groupBy("role", "reason").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(missing(F.col("ground_truth"))).alias("without_ground_truth"),
    )
