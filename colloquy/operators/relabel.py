"""Teacher relabelling of finished steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.functions.grading import missing
from colloquy.functions.messages import clean_context
from colloquy.functions.text import py_strip
from colloquy.operators.rollout import Responder
from colloquy.session import content_mark, new_folder, write_once

#: which roles a collection setting labels
LABELLED_ROLES = {
    "both": ("generator", "verifier"),
    "gen": ("generator",),
    "ver": ("verifier",),
    "none": (),
}


def relabel(
    steps: DataFrame,
    teacher: Responder,
    collect_for: str = "both",
    materialise: bool = True,
    folder: str | None = None,
    made_by: object = None,
) -> DataFrame:
    """Fill in teacher targets where a wanted step has none and its prompt is usable.

    The teacher is a responder like the students, so rows carry their key through the
    call and nothing is joined.  With ``materialise`` the labelled table is written once; one found
    complete in ``folder`` is used as it is if it was made of the same steps: ``made_by`` tells them apart,
    without it their content does.
    """
    roles = LABELLED_ROLES[collect_for]
    if not roles:
        return steps
    asked = steps.withColumn("prompt", clean_context(F.col("teacher_prompt"))).withColumn(
        "active", F.col("role").isin(*roles) & missing(F.col("teacher_target")) & (F.size("prompt") > 0)
    )
    answered = teacher(asked, "teacher", 0)
    takes = F.col("active")
    label = py_strip(F.coalesce(F.col("text"), F.lit("")))
    labelled = answered.withColumns(
        {
            "teacher_status": F.when(takes, V.TEACHER_STATUS).otherwise(F.col("teacher_status")),
            "teacher_justification": F.when(takes, V.TEACHER_JUSTIFICATION).otherwise(
                F.col("teacher_justification")
            ),
            "teacher_target": F.when(takes, label).otherwise(F.col("teacher_target")),
        }
    ).select(*steps.columns)
    if not materialise:
        return labelled
    if folder is None:
        return write_once(labelled, new_folder(steps.sparkSession, "relabel"))
    made_by = made_by or content_mark(steps, "uid", "role", "turn_index", "student_response_raw")
    return write_once(labelled, folder, (collect_for, made_by))
