"""Conversation, task and dataset views derived from the given tables.

The tables hold plain chats and documents; the views add think tags, boxed answers,
verdicts, teacher targets, blanks and NULLs by rule.  The projections are SQL text shared
with the oracle; ranking is ours on the Spark side and a plain window in the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.functions.text import to_record_json
from colloquy.operators.ordinals import rank_rows

#: turns of the replayed rollouts: the limit a rollout has by default
TURNS = V.DEFAULT_MAX_TURNS

STEPS_PROJECTION = [
    "conv_id",
    "CAST(turn_index AS BIGINT) AS turn_index",
    "CAST(conv_id % 3 AS STRING) AS ground_truth",
    """CASE WHEN (conv_id + turn_index) % 8 = 7 THEN '' ELSE
  CASE (conv_id + turn_index) % 4 WHEN 0 THEN '<think>' || text || '</think> Answer '
       WHEN 1 THEN '<think>' || text || ' ' ELSE text || ' ' END
  || chr(92) || 'boxed{' || CAST((conv_id * 2 + turn_index) % 3 AS STRING) || '}' END AS g_raw""",
    """'<think>looks wrong</think>' || CASE (conv_id * 3 + turn_index) % 5
       WHEN 0 THEN 'It is Correct.' WHEN 1 THEN 'Final: INCORRECT'
       WHEN 2 THEN 'That is wrong!' WHEN 3 THEN 'no verdict 42' ELSE '' END AS v_raw""",
    """CASE (conv_id + 2 * turn_index) % 4 WHEN 0 THEN NULL WHEN 1 THEN '<think>t ' ELSE 'so ' END
  || chr(92) || 'boxed{' || CAST((conv_id + turn_index) % 3 AS STRING) || '}' AS g_target""",
    """CASE (conv_id + 3 * turn_index) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Checked: correct'
       WHEN 2 THEN 'Checked: incorrect.' WHEN 3 THEN 'This is wrong' ELSE 'unsure' END AS v_target""",
]
TASKS_PROJECTION = [
    "conv_id",
    "'train_' || CAST(conv_id AS STRING) AS uid",
    "CASE WHEN conv_id % 11 = 3 THEN '' ELSE text END AS question",
    "CAST(conv_id % 3 AS STRING) AS ground_truth",
]
SFT_PROJECTION = [
    "CAST(conv_id % 40 AS STRING) || '|' || CAST(turn_index AS STRING) AS msg",
    "conv_id * 100 + turn_index AS seq",
    "turn_index AS round",
]
TAGGED_PROJECTION = [
    "conv_id",
    "turn_index",
    "ground_truth",
    "g_raw",
    """'<verdict>' || CASE (conv_id + turn_index) % 2 WHEN 0 THEN 'correct' ELSE 'incorrect' END || '</verdict>' || chr(10)
 || '<feedback>line ' || CAST(turn_index AS STRING) || '</feedback>' || chr(10)
 || CASE (conv_id + turn_index) % 3
      WHEN 0 THEN '<Fixed_Answer> ' || chr(92) || 'boxed{' || ground_truth || '}' || chr(10) || '</fixed_answer>'
      WHEN 1 THEN '<fixed_answer></fixed_answer>' ELSE '' END AS v_raw""",
    "g_target",
    "v_target",
]
MESSAGES_PROJECTION = [
    "conv_id",
    "turn AS pos",
    """CASE WHEN role = 'user' THEN CASE conv_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'Human' WHEN 2 THEN 'customer' ELSE 'USER' END
      WHEN (conv_id + turn) % 13 = 5 THEN '' ELSE role END AS role""",
    "CASE (conv_id + turn) % 9 WHEN 4 THEN '' WHEN 7 THEN NULL ELSE text END AS content",
]
ROWS_PROJECTION = [
    "doc_id AS idx",
    "CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE text END AS problem",
    "CASE doc_id % 5 WHEN 0 THEN 'g' || CAST(doc_id AS STRING) WHEN 1 THEN '' ELSE NULL END AS ground_truth",
    "CASE doc_id % 3 WHEN 0 THEN 'a' || CAST(doc_id AS STRING) ELSE NULL END AS answer",
    "CASE doc_id % 4 WHEN 0 THEN 'so ' || chr(92) || 'boxed{1}' WHEN 1 THEN '' ELSE NULL END AS solution",
    "CASE doc_id % 2 WHEN 0 THEN 'l' ELSE NULL END AS label",
]


def _select(columns: list[str], source: str) -> str:
    return "SELECT " + ",\n ".join(columns) + f"\nFROM {source}"


#: the views as common table expressions, in order of dependency
CTE = {
    "v_steps": _select(
        STEPS_PROJECTION,
        "(SELECT conv_id, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index"
        " FROM conversations WHERE role = 'assistant') a",
    ),
    "v_tasks": _select(
        TASKS_PROJECTION,
        "(SELECT conv_id, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn"
        " FROM conversations WHERE role = 'user') u WHERE rn = 1",
    ),
    "v_sft": _select(SFT_PROJECTION, "v_steps"),
    "v_dagger": _select(TAGGED_PROJECTION, "v_steps"),
    "v_messages": _select(MESSAGES_PROJECTION, "conversations"),
    "v_rows": _select(ROWS_PROJECTION, "documents"),
}
NEEDS = {
    "v_sft": ["v_steps"],
    "v_dagger": ["v_steps"],
}


def with_views(names: list[str] | str, body: str, extra: dict[str, str] | None = None) -> str:
    """Oracle SQL with the views it needs as CTEs; ``extra`` CTEs follow them."""
    names = [names] if isinstance(names, str) else names
    wanted: list[str] = []
    for name in names:
        for n in [*NEEDS.get(name, []), name]:
            if n not in wanted:
                wanted.append(n)
    ctes = {**{n: CTE[n] for n in wanted}, **(extra or {})}
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in ctes.items()) + "\n" + body


# ---- the same views in Spark --------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per assistant turn; turns are ranked in blocks, so a long conversation is no hot key."""
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")
    return rank_rows(said, ["conv_id"], ["turn"], "turn_index").selectExpr(*STEPS_PROJECTION)


UID = "'train_' || CAST(conv_id AS STRING) AS uid"


def v_first_steps(spark: SparkSession, sf_dir: str, turns: int = TURNS) -> DataFrame:
    """The first ``turns`` assistant turns of each conversation, what a rollout can reach.

    Spark limits each group before the shuffle (``WindowGroupLimit``).  Partitioned by
    ``uid``, like everything an episode meets later, so grouping them shuffles no more.
    """
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    keyed = said.selectExpr(UID, "conv_id", "turn", "text")
    ranked = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("uid").orderBy("turn")))
    first = ranked.filter(F.col("rn") <= turns).withColumn("turn_index", F.col("rn") - 1)
    return first.selectExpr(*STEPS_PROJECTION, "uid")


def v_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").selectExpr(UID, "conv_id", "turn", "text")
    last = asked.groupBy("uid").agg(F.max_by("text", "turn").alias("text"), F.max("conv_id").alias("conv_id"))
    return last.selectExpr("uid", *[p for p in TASKS_PROJECTION if not p.endswith("AS uid")]).select(
        "conv_id", "uid", "question", "ground_truth"
    )


def v_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_steps(spark, sf_dir).selectExpr(*SFT_PROJECTION)


def v_dagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_steps(spark, sf_dir).selectExpr(*TAGGED_PROJECTION)


def v_first_tagged(spark: SparkSession, sf_dir: str, turns: int = TURNS) -> DataFrame:
    return v_first_steps(spark, sf_dir, turns).selectExpr(*TAGGED_PROJECTION, "uid")


def v_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*MESSAGES_PROJECTION)


def v_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*ROWS_PROJECTION)


def as_json(col: Column) -> Column:
    return to_record_json(col)
