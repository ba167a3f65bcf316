"""Queries over whole conversations as message rows, of any length."""

from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.functions import coerce, messages
from colloquy.operators import dialogues
from colloquy.plans import sqltext as Q
from colloquy.plans.registry import query
from colloquy.plans.views import v_messages, with_views

c = F.col
KEYS = ["conv_id"]
LIMITS = [0, 1, 2, 4, 9, 12]
BUDGETS = [4, 20, 60, 256, 4096]
_WORDS = r"regexp_extract_all(coalesce(content, ''), '[^ \t\n\r\f\x0B]+')"

_CLEAN = "SELECT conv_id, pos, role, content FROM v_messages WHERE role <> '' AND content IS NOT NULL"
_NUMBERED = """SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  first_value(role) OVER (PARTITION BY conv_id ORDER BY pos) IS NOT DISTINCT FROM 'system' AS head FROM v_messages"""
_SIZED = f"SELECT *, {_WORDS} AS tk FROM ({_NUMBERED}) x"
_SUMMED = f"""SELECT *, head AND i = 1 AS is_head, max(CASE WHEN head AND i = 1 THEN len(tk) ELSE 0 END) OVER (PARTITION BY conv_id) AS hk,
  sum(CASE WHEN head AND i = 1 THEN 0 ELSE len(tk) END) OVER (PARTITION BY conv_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS suf
FROM ({_SIZED}) y"""


@query("clean_context_rows", with_views("v_messages", _CLEAN))
def clean_context_rows(spark, d):
    return dialogues.clean_rows(v_messages(spark, d))


@query("drop_trailing_assistant_rows", with_views("v_messages", f"""
SELECT conv_id, pos, role, content FROM ({_CLEAN}) k
QUALIFY NOT (role = 'assistant' AND row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1)"""))
def drop_trailing_assistant_rows(spark, d):
    return dialogues.drop_trailing_assistant_rows(dialogues.clean_rows(v_messages(spark, d)), KEYS)


@query("trim_history_rows", with_views("v_messages", f"""
SELECT conv_id, lim, pos, role, content FROM ({_NUMBERED}) x, (SELECT unnest({LIMITS}::BIGINT[]) AS lim) l
WHERE lim <= 0 OR n <= lim OR (lim = 1 AND head) OR (head AND i = 1) OR i > n - lim + CASE WHEN head THEN 1 ELSE 0 END"""))
def trim_history_rows(spark, d):
    return dialogues.trim_history_rows(v_messages(spark, d), KEYS, LIMITS)


@query("truncate_tail_rows", with_views("v_messages", f"""
SELECT conv_id, budget, pos, role, content FROM ({_SUMMED}) s, (SELECT unnest({BUDGETS}::BIGINT[]) AS budget) b
WHERE is_head OR hk + suf <= budget"""))
def truncate_tail_rows(spark, d):
    tokens = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))
    return dialogues.token_budget_rows(v_messages(spark, d), KEYS, BUDGETS, F.size(tokens))


@query("fit_token_budget_rows", with_views("v_messages", f"""
SELECT conv_id, budget, pos, role, CASE WHEN is_head OR hk + suf <= budget OR content IS NULL OR content = '' THEN content
  ELSE array_to_string(tk[len(tk) - least(len(tk), greatest(budget - hk, 0)) + 1:], ' ') END AS content
FROM ({_SUMMED}) s, (SELECT unnest({BUDGETS}::BIGINT[]) AS budget) b WHERE is_head OR hk + suf <= budget OR i = n"""))
def fit_token_budget_rows(spark, d):
    tokens = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))
    return dialogues.token_budget_rows(
        v_messages(spark, d), KEYS, BUDGETS, F.size(tokens), fit_last=True, tokens=tokens
    )


_USER = "content <> '' AND lower(role) = 'user'"


@query("coerce_question_rows", with_views("v_messages", f"""
SELECT conv_id, min_by(content, pos) FILTER (WHERE {_USER}) AS question FROM v_messages GROUP BY conv_id"""))
def coerce_question_rows(spark, d):
    """The first thing a user asked, over the whole conversation."""
    asked = F.coalesce(F.expr(_USER), F.lit(False))
    return v_messages(spark, d).groupBy("conv_id").agg(
        F.min_by(F.when(asked, c("content")), F.when(asked, c("pos"))).alias("question")
    )


_USERISH = f"lower(role) IN ({', '.join(Q.lit(r) for r in V.USER_ROLES)})"


@query("question_text_rows", with_views("v_messages", f"""
SELECT conv_id, coalesce(max_by(content, pos) FILTER (WHERE content <> '' AND {_USERISH}),
  max_by(content, pos) FILTER (WHERE content <> ''), '') AS question FROM v_messages GROUP BY conv_id"""))
def question_text_rows(spark, d):
    """The last thing a user said, else the last that anyone said, over the whole conversation."""
    said = coerce.has_text(c("content"))
    last = lambda cond: F.max_by(F.when(cond, c("content")), F.when(cond, c("pos")))
    return v_messages(spark, d).groupBy("conv_id").agg(
        F.coalesce(last(said & coerce.is_userish(c("role"))), last(said), F.lit("")).alias("question")
    )


_DEEP = [
    "CASE conv_id % 5 WHEN 0 THEN 'g' || CAST(conv_id AS STRING) WHEN 1 THEN '' ELSE NULL END AS ground_truth",
    "CASE conv_id % 7 WHEN 0 THEN 'so ' || chr(92) || 'boxed{1}' WHEN 1 THEN '' ELSE NULL END AS solution",
    "CASE conv_id % 2 WHEN 0 THEN 'n' || CAST(conv_id AS STRING) ELSE '' END AS nested_answer",
    "'x' || CAST(conv_id AS STRING) AS nested_label",
    # every third conversation's text ends in a box
    """CASE WHEN conv_id % 3 = 1 AND first <> '' THEN first || ' ' || chr(92) || 'boxed{' || chr(92) || 'frac{1}{' || CAST(conv_id AS STRING) || '}}'
  ELSE first END AS said""",
]


@query("coerce_ground_truth_deep_rows", with_views("v_messages", f"""
SELECT conv_id, coalesce(nullif(ground_truth, ''), nullif(solution, ''), {Q.boxed_last('said')}, nullif(said, ''),
  nullif(nested_answer, ''), nested_label) AS truth
FROM (SELECT conv_id, {', '.join(_DEEP)} FROM (
  SELECT conv_id, (min_by({{'c': content}}, pos) FILTER (WHERE role = 'assistant')).c AS first FROM v_messages GROUP BY conv_id) f) s"""))
def coerce_ground_truth_deep_rows(spark, d):
    """The first assistant message of the whole conversation stands for its messages."""
    spoke = c("role") == "assistant"
    first = F.min_by(F.when(spoke, F.struct("content")), F.when(spoke, c("pos")))
    found = v_messages(spark, d).groupBy("conv_id").agg(first["content"].alias("first"))
    rows = found.selectExpr("conv_id", *_DEEP)
    nested = F.struct(c("nested_answer").alias("answer"), c("nested_label").alias("label"))
    said = messages.messages_of(messages.message("assistant", c("said")))
    raw = rows.select("conv_id", "ground_truth", "solution", said.alias("messages"), nested.alias("content"))
    return coerce.with_question_and_truth(raw, "views").select("conv_id", c("ground_truth").alias("truth"))
