"""Queries over all recorded steps of conversations of any length: labels, counts, funnel, training rows."""

from pyspark.sql import functions as F

from colloquy.functions import hashing, tokenizers
from colloquy.operators import metrics, rollout, sft
from colloquy.operators.relabel import relabel
from colloquy.plans import sqltext as Q
from colloquy.plans.episode_queries import _FUNNEL_REASON, _SYS, _VSYS, _said, _uid, recorded_targets
from colloquy.plans.registry import query
from colloquy.plans.views import as_json, v_steps, v_tasks, with_views
from colloquy.session import new_folder
from colloquy.sources import datasets

c = F.col

_TURNS = {
    "turns": f"""SELECT s.conv_id, 'train_' || s.conv_id AS uid, coalesce(t.question, '') AS question, s.ground_truth, turn_index,
  {_said('s', 'g_raw')} AS g, {_said('s', 'v_raw')} AS v, {_said('s', 'g_target')} AS gt, {_said('s', 'v_target')} AS vt
FROM v_steps s LEFT JOIN v_tasks t USING (conv_id)""",
    "steps": """SELECT uid, question, ground_truth, 'generator' AS role, turn_index, g AS raw, NULL AS gen_raw, gt AS target FROM turns
UNION ALL SELECT uid, question, ground_truth, 'verifier', turn_index, v, g, vt FROM turns""",
}


def recorded_steps(spark, d):
    """Every recorded turn of every conversation as a step of either role."""
    # one task per conversation; AQE splits a hot conversation's steps
    asked = v_tasks(spark, d).select("conv_id", "question")
    turns = v_steps(spark, d).join(asked, "conv_id", "left").select(
        _uid().alias("uid"), "question", "ground_truth", "turn_index", c("g_raw").alias("generator"), c("v_raw").alias("verifier")
    )
    return rollout.steps_of_turns(turns)


def labelled_rows(spark, d):
    teacher = rollout.keyed_teacher(recorded_targets(v_steps(spark, d)))
    return relabel(recorded_steps(spark, d), teacher, materialise=False)


@query("relabel_replay_rows", with_views(["v_steps", "v_tasks"], """
SELECT uid, role, turn_index, target AS teacher_target, 'revise' AS teacher_status FROM steps""", _TURNS))
def relabel_replay_rows(spark, d):
    return labelled_rows(spark, d).select("uid", "role", "turn_index", "teacher_target", "teacher_status")


@query("relabel_counts_rows", with_views(["v_steps", "v_tasks"], """
SELECT role, count(*) AS labelled FROM steps WHERE target <> '' GROUP BY role""", _TURNS))
def relabel_counts_rows(spark, d):
    return metrics.label_counts(labelled_rows(spark, d))


@query("sft_funnel_rows", with_views(["v_steps", "v_tasks"], f"""
SELECT role, {_FUNNEL_REASON} AS reason, count(*) AS n, 0::BIGINT AS without_ground_truth FROM steps GROUP BY ALL""", _TURNS))
def sft_funnel_rows(spark, d):
    """Every recorded step by the reason that decides on it."""
    return sft.funnel(sft.judged_candidates(labelled_rows(spark, d)))


# the last eight messages before a target are the last four turns
_TRAINING = {
    **_TURNS,
    "fed": f"""SELECT *, {Q.verify_shown('question', 'g')} AS ask, CASE WHEN turn_index = 0 THEN question
  ELSE {Q.regenerate('question', Q.strip_think('pv'))} END AS user_turn
FROM (SELECT *, lag(v) OVER (PARTITION BY uid ORDER BY turn_index) AS pv FROM turns) x""",
    "talks": f"""SELECT *, list([{Q.msg('user', 'user_turn')}, {Q.msg('assistant', 'g')}]) OVER near AS gl,
  list([{Q.msg('user', 'ask')}, {Q.msg('assistant', 'v')}]) OVER near AS vl
FROM fed WINDOW near AS (PARTITION BY uid ORDER BY turn_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    "said": f"""SELECT uid, question, ground_truth, 'generator' AS role, turn_index, g AS raw, NULL AS gen_raw, gt AS target,
  list_concat([{_SYS}], flatten(gl)[:-2]) AS context FROM talks
UNION ALL SELECT uid, question, ground_truth, 'verifier', turn_index, v, g, vt, list_concat([{_VSYS}], flatten(vl)[:-2]) FROM talks""",
    "rows": f"""SELECT uid, role, turn_index, list_concat(context, [{Q.msg('assistant', 'target')}]) AS messages
FROM said WHERE {_FUNNEL_REASON} = 'kept'""",
}


def training_rows(spark, d):
    """Training rows of all recorded steps, each bounded by the training history limit."""
    return sft.judged_rows(labelled_rows(spark, d))


@query("message_hash_rows", with_views(["v_steps", "v_tasks"], f"""
SELECT uid, role, turn_index, sha1({Q.canonical('messages')}) AS msg_hash, length({Q.canonical('messages')}) AS canonical_length
FROM rows""", _TRAINING))
def message_hash_rows(spark, d):
    return training_rows(spark, d).select(
        "uid", "role", "turn_index", "msg_hash",
        F.length(hashing.canonical_messages(c("messages"))).cast("bigint").alias("canonical_length"),
    )


@query("jsonl_to_parquet_rows", with_views(["v_steps", "v_tasks"], f"""
SELECT uid, role, turn_index, {Q.text_json('messages')} AS messages FROM rows""", _TRAINING))
def jsonl_to_parquet_rows(spark, d):
    path = f"{new_folder(spark, 'sft-rows')}.jsonl"
    training_rows(spark, d).select(as_json(F.struct("uid", "role", "turn_index", "messages")).alias("value")).write.text(path)
    columns = "uid string, role string, turn_index bigint"
    out = datasets.jsonl_for_training(spark, path, new_folder(spark, "training-rows"), columns=columns)
    return spark.read.parquet(out).select("uid", "role", "turn_index", as_json(c("messages")).alias("messages"))


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@query("fit_prompt_tokenizer")
def fit_prompt_tokenizer(spark, d, model: str = TOKENIZER, budget: int = 300):
    """The prompts of all recorded steps cut to a budget that a tokenizer counts; tests hold it against a loop."""
    load = tokenizers.sentencepiece_coder(spark, model)
    fit = tokenizers.prompt_fitter(load, budget)
    fitted = recorded_steps(spark, d).select("uid", "role", "turn_index", fit(c("teacher_prompt")).alias("prompt"))
    shown = F.array_join(F.transform("prompt", lambda m: F.concat_ws("|", m["role"], m["content"])), "\n")
    return fitted.select("uid", "role", "turn_index", F.size("prompt").cast("bigint").alias("n_messages"), F.sha1(shown).alias("prompt_sha1"))
