"""Queries over raw rows and message arrays: coercion, contexts, windows, budgets."""

from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.functions import coerce, messages
from colloquy.plans import sqltext as Q
from colloquy.plans.registry import query
from colloquy.plans.views import as_json, table, v_messages, v_rows, with_views

c = F.col

@query("coerce_question_or_query", with_views("v_rows", """
SELECT idx, coalesce(nullif(problem, ''), label) AS question FROM v_rows"""))
def coerce_question_or_query(spark, d):
    return v_rows(spark, d).select("idx", coerce.question_or_query(c("problem"), c("label")).alias("question"))


@query("coerce_ground_truth", with_views("v_rows", """
SELECT idx, coalesce(nullif(ground_truth, ''), nullif(answer, ''), nullif(solution, ''), nullif(label, '')) AS truth
FROM v_rows"""))
def coerce_ground_truth(spark, d):
    none = F.lit(None).cast("string")
    return v_rows(spark, d).select(
        "idx",
        coerce.coerce_ground_truth(c("ground_truth"), c("answer"), c("solution"), c("label"), none).alias("truth"),
    )


_USERISH = f"lower(m.role) IN ({', '.join(Q.lit(r) for r in V.USER_ROLES)})"


# the question as text, as one object, as a list of objects and strings, or as something else
_UNION = """CASE (conv_id + turn) % 6
  WHEN 0 THEN {j}
  WHEN 1 THEN '{{"from":"Human","value":' || {j} || '}}'
  WHEN 2 THEN '{{"question":' || {j} || ',"speaker":"system"}}'
  WHEN 3 THEN '[{{"speaker":"student","text":"first"}},' || {j} || ',{{"role":"assistant","content":"last"}}]'
  WHEN 4 THEN '[{{"name":"client","prompt":' || {j} || '}},"  ",{{"role":"system","content":"s"}},7]'
  ELSE '[{{"role":"assistant","message":' || {j} || '}},[],{{"role":"user","content":""}}]' END AS raw"""


@query("question_text_union", """
SELECT conv_id, turn, text AS question FROM conversations""")
def question_text_union(spark, d):
    from colloquy.functions.hashing import json_string

    raw = table(spark, d, "conversations").withColumn("j", json_string(c("text"))).selectExpr(
        "conv_id", "turn", _UNION.format(j="j")
    )
    return raw.select(
        "conv_id", "turn", coerce.question_from_variant(F.parse_json("raw")).alias("question")
    )


@query("userish_messages", with_views("v_messages", f"""
SELECT m.conv_id, m.pos, m.role, m.content FROM v_messages m WHERE {_USERISH}"""))
def userish_messages(spark, d):
    return v_messages(spark, d).filter(coerce.is_userish(c("role")))


@query("last_user_message", with_views("v_messages", f"""
SELECT conv_id, max_by(content, pos) FILTER (WHERE content <> '' AND lower(role) IN ({', '.join(Q.lit(r) for r in V.USER_ROLES)})) AS last_userish,
       min_by(content, pos) FILTER (WHERE content <> '' AND lower(role) = 'user') AS first_user,
       min_by(pos, pos) FILTER (WHERE role = 'assistant') AS first_assistant_pos
FROM v_messages GROUP BY conv_id"""))
def last_user_message(spark, d):
    said = coerce.has_text(c("content"))
    pick = lambda agg, cond, value: agg(F.when(cond, F.struct(value)), F.when(cond, c("pos")))
    userish = said & coerce.is_userish(c("role"))
    user = said & (F.lower("role") == "user")
    found = v_messages(spark, d).groupBy("conv_id").agg(
        pick(F.max_by, userish, c("content")).alias("u"),
        pick(F.min_by, user, c("content")).alias("f"),
        F.min(F.when(c("role") == "assistant", c("pos"))).alias("first_assistant_pos"),
    )
    return found.select(
        "conv_id", c("u")["content"].alias("last_userish"), c("f")["content"].alias("first_user"),
        "first_assistant_pos",
    )


# message texts of all shapes: NULL, plain, one object, list with object content, nested lists, empty
_SHAPES = """CASE (conv_id + turn) % 9
  WHEN 0 THEN NULL
  WHEN 1 THEN 'plain: ' || text
  WHEN 2 THEN '{{"role":"' || role || '","content":' || {j} || '}}'
  WHEN 3 THEN '[{{"role":"' || role || '","content":{{"a":[1,2],"t":' || {j} || '}}}},{{"content":null}}]'
  WHEN 4 THEN '[[{{"role":"r1","content":' || {j} || '}},{{"role":"r2"}}],["p",' || {j} || ',5]]'
  WHEN 5 THEN '[' || {j} || ',{{"role":"assistant","content":"x"}},[],null]'
  WHEN 6 THEN '[]'
  WHEN 7 THEN {j}
  ELSE '[{{"content":' || {j} || ',"role":null,"extra":1}}]' END AS shape"""
_J = "CAST(to_json(text) AS VARCHAR)"
_EXPECTED = f"""CASE (conv_id + turn) % 9
  WHEN 0 THEN '[{{"role":null,"content":null}}]'
  WHEN 1 THEN '[{{"role":"user","content":' || CAST(to_json('plain: ' || text) AS VARCHAR) || '}}]'
  WHEN 2 THEN '[{{"role":"' || role || '","content":' || {_J} || '}}]'
  WHEN 3 THEN '[{{"role":"' || role || '","content":' || CAST(to_json('{{"a":[1,2],"t":' || {_J} || '}}') AS VARCHAR) || '}},{{"role":null,"content":null}}]'
  WHEN 4 THEN '[{{"role":"r1","content":' || {_J} || '}},{{"role":"r2","content":null}},{{"role":"user","content":' || CAST(to_json('p ' || text || ' 5') AS VARCHAR) || '}}]'
  WHEN 5 THEN '[{{"role":"user","content":' || {_J} || '}},{{"role":"assistant","content":"x"}},{{"role":"user","content":null}}]'
  WHEN 6 THEN '[{{"role":null,"content":null}}]'
  WHEN 7 THEN '[{{"role":"user","content":' || {_J} || '}}]'
  ELSE '[{{"role":null,"content":' || {_J} || '}}]' END"""


@query("normalize_messages", f"SELECT conv_id, turn, {_EXPECTED} AS messages FROM conversations")
def normalize_messages(spark, d):
    from colloquy.functions.hashing import json_string

    shaped = table(spark, d, "conversations").withColumn("j", json_string(c("text"))).selectExpr(
        "conv_id", "turn", _SHAPES.format(j="j")
    )
    return shaped.select("conv_id", "turn", as_json(messages.normalise_messages(c("shape"))).alias("messages"))
