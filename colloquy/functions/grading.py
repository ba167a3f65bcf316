"""Grading of answers against ground truth, as Column builders.

A *grader* is any ``(answer: Column, ground_truth: Column) -> Column`` giving a
reward; ``grade_reward`` is the one used unless a job is given another (for example
one built on a ``pandas_udf``).  No symbolic algebra: answers agree as normalised
text or as numbers (integers, decimals, ``a/b``, ``\\frac{a}{b}``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.functions.text import bind, blank_to_null, boxed_last, first_present, py_strip

NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
NUMERIC = rf"^{NUMBER}(?:/{NUMBER})?$"
THOUSANDS = r"^[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]*)?$"
FRACTION = r"^([+-]?)\\frac\{([^{}]+)\}\{([^{}]+)\}$"
RELATIVE_TOLERANCE = 1e-9


def normalise_answer(text: Column) -> Column:
    bare = F.regexp_replace(py_strip(text), r"\\left|\\right|\$|[ \t\r\n]", "")
    bare = F.regexp_replace(bare, r"\\[dt]frac", r"\\frac")
    bare = F.regexp_replace(bare, r"\.$", "")
    bare = F.regexp_replace(bare, FRACTION, "$1$2/$3")
    return bind(
        bare,
        lambda b: F.when(b.rlike(THOUSANDS), F.replace(b, F.lit(","), F.lit(""))).otherwise(b),
    )


def numeric_value(answer: Column) -> Column:
    """Number written by a normalised answer, NULL when it is not one."""
    above = F.substring_index(answer, "/", 1).try_cast("double")
    below = F.when(
        F.contains(answer, F.lit("/")),
        F.nullif(F.substring_index(answer, "/", -1).try_cast("double"), F.lit(0.0)),
    ).otherwise(F.lit(1.0))
    return F.when(answer.rlike(NUMERIC), above / below)


def answers_agree(left: Column, right: Column) -> Column:
    """Agreement of two normalised answers; never NULL."""
    pair = F.struct(left.alias("l"), right.alias("r"))

    def compare(p: Column) -> Column:
        numbers = F.struct(numeric_value(p["l"]).alias("x"), numeric_value(p["r"]).alias("y"))
        close = bind(
            numbers,
            lambda n: F.abs(n["x"] - n["y"])
            <= F.lit(RELATIVE_TOLERANCE) * F.greatest(F.abs(n["x"]), F.abs(n["y"])),
        )
        return F.when(p["l"] == p["r"], F.lit(True)).otherwise(close)

    return F.coalesce(bind(pair, compare), F.lit(False))


def grade(answer: Column, ground_truth: Column) -> Column:
    """Whether the last boxed answer in the text agrees with the ground truth; never NULL."""
    truth = F.coalesce(boxed_last(ground_truth), ground_truth)
    return answers_agree(normalise_answer(boxed_last(answer)), normalise_answer(truth))


def grade_reward(answer: Column, ground_truth: Column) -> Column:
    return F.when(grade(answer, ground_truth), F.lit(1.0)).otherwise(F.lit(0.0))


def is_rewarded(reward: Column) -> Column:
    return F.coalesce(reward > V.REWARD_THRESHOLD, F.lit(False))


def missing(value: Column) -> Column:
    return blank_to_null(value).isNull()


def answer_is_correct(answer: Column, ground_truth: Column, grader=grade_reward) -> Column:
    """NULL without ground truth, false for an empty answer, else the grade."""
    return (
        F.when(missing(ground_truth), F.lit(None).cast("boolean"))
        .when(missing(answer), F.lit(False))
        .otherwise(is_rewarded(grader(answer, ground_truth)))
    )


def expected_verdict(
    generator_raw: Column, student_raw: Column, ground_truth: Column, grader=grade_reward
) -> Column:
    """The verdict a verifier should give; NULL without ground truth."""
    judged = F.coalesce(first_present(generator_raw, student_raw), F.lit(""))
    correct = answer_is_correct(judged, ground_truth, grader)
    return F.when(correct, V.VERDICT_CORRECT).when(~correct, V.VERDICT_INCORRECT)
