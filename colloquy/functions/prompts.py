"""Prompt builders and the opening histories of both verifier protocols."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.functions.messages import message, messages_of


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def verify_prompt(question: Column, answer: Column, unfinished: Column | None = None) -> Column:
    note = F.lit("") if unfinished is None else F.when(unfinished, V.JUDGED_UNFINISHED_NOTE).otherwise("")
    return F.concat(
        F.lit(V.JUDGED_VERIFY_INSTRUCTION), note,
        F.lit(V.QUESTION_LABEL), _text(question),
        F.lit(V.PREVIOUS_ANSWER_LABEL), _text(answer),
    )


def regenerate_prompt(question: Column, feedback: Column) -> Column:
    return F.concat(
        F.lit(V.JUDGED_REGENERATE_INSTRUCTION),
        F.lit(V.QUESTION_LABEL), _text(question),
        F.lit(V.VERIFIER_FEEDBACK_LABEL), _text(feedback),
    )


def tagged_verify_prompt(question: Column, answer: Column) -> Column:
    return F.concat(
        F.lit(V.TAGGED_QUESTION_LABEL), _text(question), F.lit(V.TAGGED_ANSWER_LABEL), _text(answer)
    )


def generator_opening(question: Column) -> Column:
    return messages_of(
        message("system", F.lit(V.GENERATOR_SYSTEM)), message("user", _text(question))
    )


def verifier_opening(system: str) -> Column:
    return messages_of(message("system", F.lit(system)))
