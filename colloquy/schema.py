"""Spark types shared by the operators."""

from pyspark.sql import types as T

MESSAGE_DDL = "struct<role:string,content:string>"
MESSAGES_DDL = f"array<{MESSAGE_DDL}>"

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
MESSAGES = T.ArrayType(MESSAGE)

TASK = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("ground_truth", T.StringType()),
    ]
)

RESPONSE = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("turn_index", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

#: what makes a task
TASK_COLUMNS = ("uid", "question", "ground_truth")

#: columns of the flat steps table, one row per (uid, role, turn_index)
STEP_COLUMNS = (
    "uid",
    "role",
    "turn_index",
    "question",
    "ground_truth",
    "is_correct",
    "chat_completions",
    "reward",
    "student_response",
    "student_response_raw",
    "generator_message",
    "generator_message_raw",
    "teacher_prompt",
    "teacher_status",
    "teacher_justification",
    "teacher_target",
)

STEP_KEY = ("uid", "role", "turn_index")

ACCURACY_RECORD_DDL = (
    "episode_id string, question string, ground_truth string, generator_message string, "
    "prediction_used string, parsed_prediction string, reward double, is_correct boolean"
)
