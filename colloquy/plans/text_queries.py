"""Queries over texts: verdicts, think tags, boxes, prompts, hashes, grading."""

from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.functions import grading, mathematics, prompts, text
from colloquy.plans import sqltext as Q
from colloquy.plans.registry import query
from colloquy.plans.views import (
    table,
    v_dagger,
    v_steps,
    v_tasks,
    with_views,
)

c = F.col


@query("verdict", with_views("v_steps", f"""
SELECT conv_id, turn_index, {Q.verdict('v_raw')} AS verdict, {Q.verdict('v_target')} AS target_verdict,
       {Q.verdict('g_raw')} AS answer_verdict
FROM v_steps"""))
def verdict(spark, d):
    return v_steps(spark, d).select(
        "conv_id", "turn_index",
        text.final_verdict(c("v_raw")).alias("verdict"),
        text.final_verdict(c("v_target")).alias("target_verdict"),
        text.final_verdict(c("g_raw")).alias("answer_verdict"),
    )


@query("strip_think", with_views("v_steps", f"""
SELECT conv_id, turn_index, {Q.strip_think('g_raw')} AS g_public, {Q.strip_think('v_raw')} AS v_public
FROM v_steps"""))
def strip_think(spark, d):
    return v_steps(spark, d).select(
        "conv_id", "turn_index",
        text.strip_think(c("g_raw")).alias("g_public"), text.strip_think(c("v_raw")).alias("v_public"),
    )


@query("think_incomplete", with_views("v_steps", f"""
SELECT conv_id, turn_index, {Q.unfinished('g_raw')} AS answer_unfinished, {Q.unfinished('g_target')} AS target_unfinished
FROM v_steps"""))
def think_incomplete(spark, d):
    return v_steps(spark, d).select(
        "conv_id", "turn_index",
        text.think_incomplete(c("g_raw")).alias("answer_unfinished"),
        text.think_incomplete(c("g_target")).alias("target_unfinished"),
    )


# texts with several boxes, nested braces and an empty one
_BOXES = """CASE (conv_id + turn_index) % 4
  WHEN 0 THEN g_raw || ' then ' || chr(92) || 'boxed{' || chr(92) || 'frac{' || ground_truth || '}{2}} end'
  WHEN 1 THEN chr(92) || 'boxed{a{b{c}}} ' || g_raw
  WHEN 2 THEN g_raw || chr(92) || 'boxed{}'
  ELSE g_raw END AS said"""


@query("boxed_first", with_views("v_steps", f"""
SELECT conv_id, turn_index, {Q.boxed_first('said')} AS boxed, {Q.boxed_first('g_target')} AS target_boxed
FROM (SELECT *, {_BOXES} FROM v_steps) s"""))
def boxed_first(spark, d):
    return v_steps(spark, d).selectExpr("*", _BOXES).select(
        "conv_id", "turn_index",
        text.boxed_first(c("said")).alias("boxed"), text.boxed_first(c("g_target")).alias("target_boxed"),
    )


@query("boxed_last", with_views("v_steps", f"""
SELECT conv_id, turn_index, {Q.boxed_last('said')} AS boxed, {Q.boxed_last('g_target')} AS target_boxed
FROM (SELECT *, {_BOXES} FROM v_steps) s"""))
def boxed_last(spark, d):
    return v_steps(spark, d).selectExpr("*", _BOXES).select(
        "conv_id", "turn_index",
        text.boxed_last(c("said")).alias("boxed"), text.boxed_last(c("g_target")).alias("target_boxed"),
    )


@query("fixed_answer", with_views("v_dagger", f"""
SELECT conv_id, turn_index, {Q.tag('v_raw', 'fixed_answer')} AS fixed,
       {Q.boxed_first(Q.tag('v_raw', 'fixed_answer'))} AS fixed_boxed
FROM v_dagger"""))
def fixed_answer(spark, d):
    fixed = text.fixed_answer(c("v_raw"))
    return v_dagger(spark, d).select(
        "conv_id", "turn_index", fixed.alias("fixed"), text.boxed_first(fixed).alias("fixed_boxed")
    )


@query("verifier_tags", with_views("v_dagger", f"""
SELECT conv_id, turn_index, {Q.tag('v_raw', 'verdict')} AS verdict, {Q.tag('v_raw', 'feedback')} AS feedback,
       {Q.tag('v_raw', 'fixed_answer')} AS fixed
FROM v_dagger"""))
def verifier_tags(spark, d):
    return v_dagger(spark, d).select(
        "conv_id", "turn_index",
        text.extract_tag(c("v_raw"), V.VERDICT_TAG).alias("verdict"),
        text.extract_tag(c("v_raw"), V.FEEDBACK_TAG).alias("feedback"),
        text.extract_tag(c("v_raw"), V.FIXED_ANSWER_TAG).alias("fixed"),
    )


_PADDED = """CASE (conv_id + turn) % 4
  WHEN 0 THEN chr(28) || chr(9) || text || chr(10) || chr(31)
  WHEN 1 THEN chr(12288) || chr(160) || text || chr(133) || chr(10)
  WHEN 2 THEN chr(65279) || ' ' || text || chr(8203) || ' '
  ELSE '  ' || text || '  ' END AS padded"""
# chr() of Spark knows one byte only, so the wide characters are written out there
_PADDED_SPARK = (
    _PADDED.replace("chr(12288)", "'　'").replace("chr(160)", "'\xa0'").replace("chr(133)", "'\x85'")
    .replace("chr(65279)", "'﻿'").replace("chr(8203)", "'​'")
)


@query("py_strip", f"""
SELECT conv_id, turn, {Q.strip('padded')} AS stripped
FROM (SELECT *, {_PADDED} FROM conversations) s""")
def py_strip(spark, d):
    return table(spark, d, "conversations").selectExpr("*", _PADDED_SPARK).select(
        "conv_id", "turn", text.py_strip(c("padded")).alias("stripped")
    )


@query("verify_prompt", with_views(["v_steps", "v_tasks"], f"""
SELECT s.conv_id, s.turn_index, {Q.verify_shown('t.question', 's.g_raw')} AS prompt,
       {Q.tagged_verify('t.question', 's.g_raw')} AS tagged_prompt
FROM v_steps s JOIN v_tasks t USING (conv_id)"""))
def verify_prompt(spark, d):
    from colloquy.operators.rollout import JUDGED

    # the tasks side has one row per conversation; AQE splits a hot conversation's steps
    steps = v_steps(spark, d).select("conv_id", "turn_index", "g_raw")
    joined = steps.join(v_tasks(spark, d).select("conv_id", "question"), "conv_id")
    return joined.select(
        "conv_id", "turn_index",
        JUDGED.ask(c("question"), c("g_raw")).alias("prompt"),
        prompts.tagged_verify_prompt(c("question"), c("g_raw")).alias("tagged_prompt"),
    )


@query("regen_prompt", with_views(["v_steps", "v_tasks"], f"""
SELECT s.conv_id, s.turn_index, {Q.regenerate('t.question', Q.strip_think('s.v_raw'))} AS prompt
FROM v_steps s JOIN v_tasks t USING (conv_id)"""))
def regen_prompt(spark, d):
    steps = v_steps(spark, d).select("conv_id", "turn_index", "v_raw")
    joined = steps.join(v_tasks(spark, d).select("conv_id", "question"), "conv_id")
    return joined.select(
        "conv_id", "turn_index",
        prompts.regenerate_prompt(c("question"), text.strip_think(c("v_raw"))).alias("prompt"),
    )


_FLAT = f"replace({Q.strip('text')}, chr(10), ' ')"


@query("question_snippet", f"""
SELECT doc_id, CASE WHEN length({_FLAT}) > 120 THEN left({_FLAT}, 117) || '...' ELSE {_FLAT} END AS snippet
FROM documents""")
def question_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", text.question_snippet(c("text")).alias("snippet"))




@query("route_slot", """
WITH RECURSIVE tab AS (
  SELECT b, b AS v, 0 AS i FROM (SELECT unnest(range(0, 256))::BIGINT AS b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, i + 1 FROM tab WHERE i < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM tab WHERE i = 8),
keyed AS (SELECT doc_id, source || ':' || CAST(doc_id AS VARCHAR) AS k FROM documents),
walk AS (
  SELECT doc_id, k, 4294967295::BIGINT AS crc, 1 AS p FROM keyed
  UNION ALL
  SELECT doc_id, k, xor(t[(xor(crc, ascii(substr(k, p, 1))) & 255) + 1], crc >> 8), p + 1
  FROM walk, crc_table WHERE p <= length(k))
SELECT doc_id, CAST(xor(crc, 4294967295::BIGINT) % 8 AS BIGINT) AS slot FROM walk WHERE p = length(k) + 1""")
def route_slot(spark, d):
    key = F.concat_ws(":", c("source"), c("doc_id").cast("string"))
    return table(spark, d, "documents").select(
        "doc_id", text.routing_slot(key, 8).cast("bigint").alias("slot")
    )


# answers written in several ways: plain, decimal, fraction, dollars and a period, thousands
_WRITTEN = """CASE (conv_id + turn_index) % 6
  WHEN 0 THEN g_raw
  WHEN 1 THEN 'so ' || chr(92) || 'boxed{' || CAST((conv_id + turn_index) % 3 AS STRING) || '.0}'
  WHEN 2 THEN chr(92) || 'boxed{' || chr(92) || 'dfrac{' || CAST(2 * (conv_id % 3) AS STRING) || '}{2}}'
  WHEN 3 THEN chr(92) || 'boxed{ $' || CAST((conv_id + turn_index) % 3 AS STRING) || '$. }'
  WHEN 4 THEN chr(92) || 'boxed{' || CAST(1 + conv_id % 9 AS STRING) || ',000} is not it'
  ELSE chr(92) || 'boxed{' || CAST((conv_id * turn_index) % 3 AS STRING) || '/1}' END AS said"""
_TRUTH = """CASE WHEN (conv_id + turn_index) % 6 = 4 THEN 'exactly ' || chr(92) || 'boxed{' || CAST((1 + conv_id % 7) * 1000 AS STRING) || '}'
  ELSE ground_truth END AS truth"""


@query("grade_answers", with_views("v_steps", f"""
SELECT conv_id, turn_index, is_correct, CASE WHEN is_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM (
  SELECT conv_id, turn_index, coalesce(a = g OR abs(x - y) <= 1e-9 * greatest(abs(x), abs(y)), false) AS is_correct
  FROM (SELECT *, {Q.number('a')} AS x, {Q.number('g')} AS y FROM (
    SELECT conv_id, turn_index, {Q.normalised('box')} AS a, {Q.normalised('want')} AS g FROM (
      SELECT conv_id, turn_index, {Q.boxed_last('said')} AS box, coalesce({Q.boxed_last('truth')}, truth) AS want
      FROM (SELECT *, {_WRITTEN}, {_TRUTH} FROM v_steps) w) b) n) v) r"""))
def grade_answers(spark, d):
    graded = v_steps(spark, d).selectExpr("conv_id", "turn_index", _WRITTEN, _TRUTH)
    return graded.select(
        "conv_id", "turn_index",
        grading.grade(c("said"), c("truth")).alias("is_correct"),
        grading.grade_reward(c("said"), c("truth")).alias("reward"),
    )


# answers and truths about the number K of a document, and whether they mean the same
_MEANT = [
    (r"\frac{2K}{4}", r"K/2", True), (r"(x+K)^2", r"x^2 + K^2 + 2 \cdot K \cdot x", True), (r"\{1, K, -2\}", r"\{-2, 1, K\}", True),
    (r"\sqrt{8}", r"2\sqrt{2}", True), (r"n = K", r"K", True), (r"[0, K)", r"[0, K]", False), (r"(K, -1)", r"(-1, K)", False),
    (r"x + K", r"x + K + 1", False), (r"K \pm 1", r"K + 1, K - 1", True), (r"K\%", r"K", True), (r"\text{none}", r"K", False), (r"\frac{K}{3", r"K", False),
    (r"\dfrac{1}{K + 1}", r"(K+1)^{-1}", True), (r"yK", r"zK", False),
]
_MEANT_SQL = ", ".join(f"({i}, {str(same).lower()})" for i, (_, _, same) in enumerate(_MEANT))


@query("grade_mathematics", f"""
SELECT doc_id, same AS is_correct, CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward
FROM documents JOIN (VALUES {_MEANT_SQL}) t(i, same) ON doc_id % {len(_MEANT)} = i""")
def grade_mathematics(spark, d):
    """Answers that differ as text from truths they may or may not equal, graded by meaning."""
    pairs = F.array(*[F.struct(F.lit(answer).alias("a"), F.lit(truth).alias("b")) for answer, truth, _ in _MEANT])
    number = F.concat(F.lit("{"), c("doc_id").cast("string"), F.lit("}"))
    asked = table(spark, d, "documents").select("doc_id", F.get(pairs, (c("doc_id") % len(_MEANT)).cast("int")).alias("p"), number.alias("k"))
    said = F.concat(F.lit("Hence \\boxed{"), F.replace("p.a", F.lit("K"), c("k")), F.lit("}."))
    truth = F.replace("p.b", F.lit("K"), c("k"))
    return asked.select(
        "doc_id", mathematics.grade_mathematics(said, truth).alias("is_correct"),
        mathematics.mathematics_reward(said, truth).alias("reward"),
    )


_MAYBE_TRUTH = "CASE (conv_id + turn_index) % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE ground_truth END AS truth"


def _q_correct(answer: str, truth: str) -> str:
    return (
        f"CASE WHEN {truth} IS NULL OR {truth} = '' THEN NULL WHEN {answer} IS NULL OR {answer} = '' THEN false "
        f"ELSE {Q.simple_grade(answer, truth)} END"
    )


@query("answer_is_correct", with_views("v_steps", f"""
SELECT conv_id, turn_index, {_q_correct('g_raw', 'truth')} AS answer_correct, {_q_correct('g_target', 'truth')} AS target_correct
FROM (SELECT *, {_MAYBE_TRUTH} FROM v_steps) s"""))
def answer_is_correct(spark, d):
    steps = v_steps(spark, d).selectExpr("*", _MAYBE_TRUTH)
    return steps.select(
        "conv_id", "turn_index",
        grading.answer_is_correct(c("g_raw"), c("truth")).alias("answer_correct"),
        grading.answer_is_correct(c("g_target"), c("truth")).alias("target_correct"),
    )


@query("expected_verdict", with_views("v_steps", f"""
SELECT conv_id, turn_index, CASE ok WHEN true THEN 'correct' WHEN false THEN 'incorrect' END AS expected FROM (
  SELECT conv_id, turn_index, {_q_correct('judged', 'truth')} AS ok FROM (
    SELECT *, {_MAYBE_TRUTH}, coalesce(nullif(g_raw, ''), nullif(v_raw, ''), '') AS judged FROM v_steps) s) t"""))
def expected_verdict(spark, d):
    steps = v_steps(spark, d).selectExpr("*", _MAYBE_TRUTH)
    return steps.select(
        "conv_id", "turn_index",
        grading.expected_verdict(c("g_raw"), c("v_raw"), c("truth")).alias("expected"),
    )
