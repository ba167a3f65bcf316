"""Queries over episodes: rollouts, relabelling, training rows, accuracy, whole jobs."""

from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.functions import grading
from colloquy.functions.mathematics import mathematics_reward
from colloquy.functions.messages import message, messages_of
from colloquy.functions.text import final_verdict, py_strip, strip_think
from colloquy.operators import joins, metrics, rollout, sft
from colloquy.operators.ordinals import rank_rows
from colloquy.operators.relabel import relabel as relabel_steps
from colloquy.plans import jobs
from colloquy.plans import sqltext as Q
from colloquy.plans.registry import query
from colloquy.plans.views import (
    TURNS,
    as_json,
    v_dagger,
    v_first_steps,
    v_first_tagged,
    v_steps,
    v_tasks,
    with_views,
)
from colloquy.session import new_folder
from colloquy.sources import store

c = F.col

def _uid():
    return F.concat(F.lit("train_"), c("conv_id").cast("string"))


# ---- oracle: the turns of the protocols, one after the other -------------------------------------

EACH = range(TURNS)
_SYS, _VSYS = Q.msg("system", Q.lit(V.GENERATOR_SYSTEM)), Q.msg("system", Q.lit(V.JUDGED_VERIFIER_SYSTEM))
_TSYS = Q.msg("system", Q.lit(V.TAGGED_VERIFIER_SYSTEM))


def _said(alias: str, column: str) -> str:
    return f"coalesce({Q.strip(f'{alias}.{column}')}, '')"


def _recorded(view: str) -> str:
    """All turns' recorded texts and targets of every task that has a question."""
    columns = {"g": "g_raw", "v": "v_raw", "gt": "g_target", "vt": "v_target"}
    said = ",\n  ".join(f"{_said(f's{t}', column)} AS {short}{t}" for t in EACH for short, column in columns.items())
    turns = "\n".join(f"LEFT JOIN {view} s{t} ON s{t}.conv_id = t.conv_id AND s{t}.turn_index = {t}" for t in EACH)
    return f"SELECT t.conv_id, t.uid, t.question, t.ground_truth,\n  {said}\nFROM v_tasks t {turns} WHERE t.question <> ''"


def _each(one) -> str:
    return ", ".join(one(t) for t in EACH)


def _reached(t: int, stop: str) -> str:
    """Turn ``t`` is played unless an earlier one stopped."""
    return " AND ".join(["true", *[f"NOT {stop}{u}" for u in range(t)]])


def _talk(system: str, asked: list[str], answers: list[str]) -> str:
    """A history: a system message if any, then questions and answers in turn."""
    said = [m for pair in zip(asked, answers) for m in (Q.msg("user", pair[0]), Q.msg("assistant", pair[1]))]
    return "[" + ", ".join([*([system] if system else []), *said, *[Q.msg("user", a) for a in asked[len(answers) :]]]) + "]"


_JUDGED = {
    "pair": _recorded("v_steps"),
    "shown": f"""SELECT *, {_each(lambda t: f"{Q.verify_shown('question', f'g{t}')} AS ask{t}")},
  {_each(lambda t: f"{Q.regenerate('question', Q.strip_think(f'v{t}'))} AS regen{t}")},
  {_each(lambda t: f"coalesce({Q.verdict(f'v{t}')} = 'correct', false) AS ok{t}")} FROM pair""",
}


def _judged_turn(t: int) -> str:
    """Both steps of turn ``t`` of a table shaped like ``shown``."""
    g, v, asks = [f"g{u}" for u in range(t + 1)], [f"v{u}" for u in range(t + 1)], [f"ask{u}" for u in range(t + 1)]
    questions = ["question", *[f"regen{u}" for u in range(t)]]
    return f"""SELECT uid, question, ground_truth, 'generator' AS role, {t}::BIGINT AS turn_index, closed AS is_correct,
  {_talk(_SYS, questions, g)} AS chat, {_talk(_SYS, questions, g[:-1])} AS prompt,
  NULL::DOUBLE AS reward, g{t} AS raw, NULL AS gen_raw, gt{t} AS target FROM x WHERE {_reached(t, 'ok')}
UNION ALL SELECT uid, question, ground_truth, 'verifier', {t}, closed,
  {_talk(_VSYS, asks, v)}, {_talk(_VSYS, asks, v[:-1])},
  CASE WHEN {Q.simple_grade(f'g{t}', 'ground_truth')} THEN 1 ELSE 0 END, v{t}, g{t}, vt{t} FROM x WHERE {_reached(t, 'ok')}"""


_JUDGED_STEPS = {
    "x": f"SELECT *, {' OR '.join(f'ok{t}' for t in EACH)} AS closed FROM shown",
    "st": "\nUNION ALL ".join(map(_judged_turn, EACH)),
    "steps": f"""SELECT uid, question, ground_truth, role, turn_index, is_correct, chat, prompt, reward, raw,
  {Q.strip_think('raw')} AS public, gen_raw, {Q.strip_think('gen_raw')} AS gen_public, target FROM st""",
}
_REPLAY = {**_JUDGED, **_JUDGED_STEPS}
_STEP_OUT = f"""SELECT uid, role, turn_index, is_correct, reward, public AS student_response, raw AS student_response_raw,
  gen_public AS generator_message, gen_raw AS generator_message_raw, {Q.text_json('chat')} AS chat_completions,
  {Q.text_json('prompt')} AS teacher_prompt FROM steps"""
# the reason a labelled step is dropped; ``target`` '' counts as missing
_REASON = f"""CASE WHEN target = '' THEN 'no_target'
  WHEN role = 'generator' AND NOT {Q.simple_grade('target', 'ground_truth')} THEN 'gt_mismatch'
  WHEN role = 'generator' AND {Q.unfinished('target')} THEN 'think_incomplete'
  WHEN role = 'verifier' AND {Q.verdict('target')} IS DISTINCT FROM
    (CASE WHEN {Q.simple_grade("coalesce(nullif(gen_raw, ''), raw)", 'ground_truth')} THEN 'correct' ELSE 'incorrect' END) THEN 'gt_mismatch'
  ELSE 'kept' END"""
_SFT = {
    **_REPLAY,
    "reasoned": f"SELECT *, {_REASON} AS reason FROM steps",
    "rows": f"SELECT uid, role, turn_index, list_concat(chat[:-2], [{Q.msg('assistant', 'target')}]) AS messages FROM reasoned WHERE reason = 'kept'",
    "hashed": f"SELECT *, sha1({Q.canonical('messages')}) AS msg_hash FROM rows",
}

# ---- Spark side -----------------------------------------------------------------------------------


def recorded_responses(steps):
    """Recorded texts as rows ``(uid, role, turn_index, text)``."""
    pairs = F.array(
        F.struct(F.lit("generator").alias("role"), c("g_raw").alias("text")),
        F.struct(F.lit("verifier").alias("role"), c("v_raw").alias("text")),
    )
    uid = c("uid") if "uid" in steps.columns else _uid().alias("uid")
    return steps.select(uid, "turn_index", F.inline(pairs)).select("uid", "role", "turn_index", "text")


def recorded_targets(steps):
    pairs = F.array(
        F.struct(F.lit("generator").alias("role"), c("g_target").alias("text")),
        F.struct(F.lit("verifier").alias("role"), c("v_target").alias("text")),
    )
    uid = c("uid") if "uid" in steps.columns else _uid().alias("uid")
    return steps.select(uid, "turn_index", F.inline(pairs)).select("uid", "role", "turn_index", "text")


def recorded_dataset(spark, d, steps=v_first_steps, dense=False):
    """Tasks with their recorded responses, indexed by conversation or densely."""
    tasks = v_tasks(spark, d)
    if dense:
        tasks = rank_rows(tasks, [], ["conv_id"], "source_idx")
    else:
        tasks = tasks.withColumn("source_idx", c("conv_id"))
    return rollout.attach_recordings(tasks, recorded_responses(steps(spark, d)), TURNS)


def replayed_steps(spark, d):
    tasks = recorded_dataset(spark, d).filter("question <> ''")
    state = rollout.run_rollout(tasks, rollout.recorded_responder, rollout.JUDGED, TURNS, materialise=False)
    return rollout.steps_of(state, rollout.JUDGED)


def labelled_steps(spark, d):
    teacher = rollout.recorded_teacher(recorded_targets(v_first_steps(spark, d)), TURNS)
    return relabel_steps(replayed_steps(spark, d), teacher, materialise=False)


def _step_columns(steps):
    return steps.select(
        "uid", "role", "turn_index", "is_correct", "reward", "student_response", "student_response_raw",
        "generator_message", "generator_message_raw", as_json(c("chat_completions")).alias("chat_completions"),
        as_json(c("teacher_prompt")).alias("teacher_prompt"),
    )


@query("replay_pag", with_views(["v_steps", "v_tasks"], _STEP_OUT, _REPLAY))
def replay_pag(spark, d):
    return _step_columns(replayed_steps(spark, d))


def _stub_students(batch=64):
    """Stub models that answer from the length of the last prompt message.

    Defined inside, so that they travel to the workers by value.
    """

    def generator(prompts, uids):
        return [f"<think>n</think> \\boxed{{{len(p[-1]['content']) % 3}}}" for p in prompts]

    def verifier(prompts, uids):
        return [f"<think>v</think> {'correct' if len(p[-1]['content']) % 2 == 0 else 'incorrect'} " for p in prompts]

    return rollout.by_role(
        generator=rollout.model_responder(generator, batch),
        verifier=rollout.model_responder(verifier, batch),
    )


def _q_stub_generator(last: str) -> str:
    return f"'<think>n</think> ' || chr(92) || 'boxed{{' || CAST(length({last}) % 3 AS VARCHAR) || '}}'"


def _q_stub_verifier(last: str) -> str:
    return f"'<think>v</think> ' || CASE WHEN length({last}) % 2 = 0 THEN 'correct' ELSE 'incorrect' END"


_NO_TARGETS = _each(lambda t: f"'' AS gt{t}, '' AS vt{t}")
_STUB = {"a0": f"SELECT *, {_NO_TARGETS}, {_q_stub_generator('question')} AS g0 FROM v_tasks WHERE question <> ''"}
for _t in EACH:
    _STUB |= {
        f"b{_t}": f"SELECT *, {Q.verify_shown('question', f'g{_t}')} AS ask{_t} FROM a{_t}",
        f"c{_t}": f"SELECT *, {_q_stub_verifier(f'ask{_t}')} AS v{_t} FROM b{_t}",
        f"d{_t}": f"SELECT *, {Q.regenerate('question', Q.strip_think(f'v{_t}'))} AS regen{_t}, "
        f"{Q.verdict(f'v{_t}')} = 'correct' AS ok{_t} FROM c{_t}",
        f"a{_t + 1}": f"SELECT *, {_q_stub_generator(f'regen{_t}')} AS g{_t + 1} FROM d{_t}",
    }
_STUB |= {"shown": f"SELECT * FROM a{TURNS}", **_JUDGED_STEPS}


@query("rollout_pag", with_views("v_tasks", _STEP_OUT, _STUB))
def rollout_pag(spark, d):
    """The rollout with stub models behind the batch interface, every phase written."""
    tasks = v_tasks(spark, d).filter("question <> ''")
    state = rollout.run_rollout(tasks, _stub_students(), rollout.JUDGED, TURNS)
    return _step_columns(rollout.steps_of(state, rollout.JUDGED))


# ---- tagged protocol --------------------------------------------------------------------------------

_TAGGED_PAIR = {
    "pair": _recorded("v_dagger").replace("WHERE t.question <> ''", ""),
    "shown": f"""SELECT *, {_each(lambda t: f"{Q.tagged_verify('question', f'g{t}')} AS ask{t}")},
  {_each(lambda t: f"CASE WHEN v{t} = '' THEN {Q.tagged_verify('question', f'g{t}')} ELSE v{t} END AS fed{t}")},
  {_each(lambda t: f"{Q.boxed_first(Q.tag(f'v{t}', 'fixed_answer'))} IS NOT NULL AS fix{t}")},
  {_each(lambda t: f"{Q.simple_grade(f'g{t}', 'ground_truth')} AS ok{t}")} FROM pair""",
}


def _tagged_turn(t: int, reached: str) -> str:
    questions = ["question", *[f"fed{u}" for u in range(t)]]
    return f"""SELECT uid, question, 'generator' AS role, {t}::BIGINT AS turn_index,
  {_talk(_SYS, questions, [f'g{u}' for u in range(t + 1)])} AS chat, NULL::DOUBLE AS reward, g{t} AS raw, NULL AS gen_raw, gt{t} AS target
FROM shown WHERE {reached}
UNION ALL SELECT uid, question, 'verifier', {t}, {_talk('', [f'ask{t}'], [f'v{t}'])},
  CASE WHEN ok{t} THEN 1 ELSE 0 END, v{t}, g{t}, vt{t} FROM shown WHERE {reached}"""


def _tagged_steps(stop: str | None) -> str:
    """Steps of all turns; ``stop`` names the flag that ends an episode."""
    return "\nUNION ALL ".join(_tagged_turn(t, _reached(t, stop) if stop else "true") for t in EACH)


_TAGGED_STOP = {**_TAGGED_PAIR, "steps": _tagged_steps("fix")}
_TAGGED_FULL = {**_TAGGED_PAIR, "steps": _tagged_steps(None)}
_TAGGED_ROWS = f"""SELECT uid, role, turn_index, CASE WHEN role = 'generator' THEN list_concat(chat[:-2], [{Q.msg('assistant', 'target')}])
  ELSE [{_TSYS}, {Q.msg('user', Q.tagged_verify('question', 'gen_raw'))}, {Q.msg('assistant', 'target')}] END AS messages
FROM steps WHERE target <> ''"""


def _tagged_state(spark, d, stop_on_fix):
    protocol = rollout.tagged(stop_on_fix)
    tasks = recorded_dataset(spark, d, v_first_tagged)
    state = rollout.run_rollout(tasks, rollout.recorded_responder, protocol, TURNS, materialise=False)
    return state, protocol


@query("replay_dagger", with_views(["v_dagger", "v_tasks"], f"""
SELECT s.uid, role, turn_index, reward, raw AS student_response, gen_raw AS generator_message,
  {Q.text_json('chat')} AS chat_completions, CASE {' '.join(f'WHEN fix{t} THEN ok{t}' for t in EACH)} ELSE {' OR '.join(f'ok{t}' for t in EACH)} END AS is_correct
FROM steps s JOIN shown USING (uid)""", _TAGGED_STOP))
def replay_dagger(spark, d):
    state, protocol = _tagged_state(spark, d, stop_on_fix=True)
    episodes = rollout.episodes_of(state, protocol).select("uid", "is_correct")
    steps = rollout.steps_of(state, protocol).drop("is_correct").join(episodes, "uid")
    return steps.select(
        "uid", "role", "turn_index", "reward", "student_response", "generator_message",
        as_json(c("chat_completions")).alias("chat_completions"), "is_correct",
    )


_STUB_TAGGED = {"a0": f"SELECT *, {_NO_TARGETS}, {_q_stub_generator('question')} AS g0 FROM v_tasks"}
for _t in EACH:
    _STUB_TAGGED |= {
        f"b{_t}": f"SELECT *, {Q.tagged_verify('question', f'g{_t}')} AS ask{_t}, {Q.simple_grade(f'g{_t}', 'ground_truth')} AS ok{_t} FROM a{_t}",
        f"c{_t}": f"SELECT *, {_q_stub_verifier(f'ask{_t}')} AS v{_t} FROM b{_t}",
        f"a{_t + 1}": f"SELECT *, v{_t} AS fed{_t}, {_q_stub_generator(f'v{_t}')} AS g{_t + 1} FROM c{_t}",
    }
_STUB_TAGGED |= {"shown": f"SELECT * FROM a{TURNS}", "steps": _tagged_steps(None)}


@query("rollout_dagger", with_views("v_tasks", f"""
SELECT uid, role, turn_index, reward, raw AS student_response, gen_raw AS generator_message,
  {Q.text_json('chat')} AS chat_completions FROM steps""", _STUB_TAGGED))
def rollout_dagger(spark, d):
    protocol = rollout.tagged()
    state = rollout.run_rollout(v_tasks(spark, d), _stub_students(batch=7), protocol, TURNS)
    return rollout.steps_of(state, protocol).select(
        "uid", "role", "turn_index", "reward", "student_response", "generator_message",
        as_json(c("chat_completions")).alias("chat_completions"),
    )


# ---- joins and labels ---------------------------------------------------------------------------------

_PROMPT_LENGTH = "len(prompt) || '|' || length(prompt[-1].content)"


@query("relabel", with_views(["v_steps", "v_tasks"], f"""
SELECT uid, role, turn_index, {_PROMPT_LENGTH} AS teacher_target, 'revise' AS teacher_status, '' AS teacher_justification
FROM steps""", _REPLAY))
def relabel(spark, d):
    """Every step of the replayed rollout (which ends at its turn limit) labelled by a stub teacher behind the batch interface."""

    def answer(prompts, uids):
        return [f" {len(p)}|{len(p[-1]['content'])}\n" for p in prompts]

    labelled = relabel_steps(replayed_steps(spark, d), rollout.model_responder(answer, 32))
    return labelled.select(
        "uid", "role", "turn_index", "teacher_target", "teacher_status", "teacher_justification"
    )


@query("labelled_rollout", with_views(["v_steps", "v_tasks"], """
SELECT uid, role, turn_index, CASE WHEN role = 'verifier' THEN target END AS teacher_target, CASE WHEN role = 'verifier' THEN 'revise' END AS teacher_status
FROM steps""", _REPLAY))
def labelled_rollout(spark, d):
    """The judged rollout with the teacher in line, labelling one role."""
    tasks = recorded_dataset(spark, d).filter("question <> ''")
    teacher = rollout.recorded_teacher(recorded_targets(v_first_steps(spark, d)), TURNS)
    options = jobs.RoundOptions(max_turns=TURNS)
    labelled = jobs.labelled_rollout(tasks, rollout.recorded_responder, teacher, options, "ver", folder=new_folder(spark, "labelled"))
    return labelled.select("uid", "role", "turn_index", "teacher_target", "teacher_status")


@query("relabel_join", with_views("v_steps", f"""
SELECT uid, turn_index, CASE WHEN old <> '' THEN old ELSE {Q.strip('v_target')} END AS teacher_target,
  CASE WHEN coalesce(old, '') = '' AND v_target IS NOT NULL THEN 'revise' END AS teacher_status
FROM (SELECT *, 'train_' || conv_id AS uid, CASE WHEN (conv_id + turn_index) % 2 = 0 THEN g_target END AS old FROM v_steps) s"""))
def relabel_join(spark, d):
    steps = v_steps(spark, d).select(
        _uid().alias("uid"), F.lit("generator").alias("role"), "turn_index",
        messages_of(message("user", c("g_raw"))).alias("teacher_prompt"),
        F.lit(None).cast("string").alias("teacher_status"),
        F.lit(None).cast("string").alias("teacher_justification"),
        F.when((c("conv_id") + c("turn_index")) % 2 == 0, c("g_target")).alias("teacher_target"),
    )
    answers = recorded_targets(v_steps(spark, d)).filter("role = 'verifier' AND text IS NOT NULL").withColumn(
        "role", F.lit("generator")
    )
    already = steps.filter(~grading.missing(c("teacher_target")))
    due = joins.pending_requests(joins.select_unlabelled(steps), already)
    labels = answers.join(due.select("uid", "role", "turn_index"), ["uid", "role", "turn_index"], "left_semi")
    labels = labels.unionByName(labels.filter("turn_index % 2 = 0"))  # some came twice
    return joins.apply_labels(steps, labels).select("uid", "turn_index", "teacher_target", "teacher_status")


@query("join_responses", with_views("v_steps", f"""
SELECT 'train_' || conv_id AS uid, role, turn_index, CASE WHEN (conv_id + turn_index) % 7 = 0 THEN '' ELSE
  CASE role WHEN 'generator' THEN {Q.strip('g_raw')} ELSE {Q.strip('v_raw')} END END AS text
FROM v_steps, (SELECT unnest(['generator', 'verifier']) AS role) r"""))
def join_responses(spark, d):
    """Two replicas' outputs merged and joined back; every seventh answer was lost, every fifth came
    once more, and an earlier, shorter one with it."""
    steps = v_steps(spark, d)
    arrived = recorded_responses(steps.filter("(conv_id + turn_index) % 7 <> 0"))
    arrived = arrived.withColumn("seq", F.lit(2))
    again = arrived.filter("turn_index % 5 = 0")
    partial = again.withColumns({"text": F.concat(F.lit("zz"), F.left("text", F.lit(3))), "seq": F.lit(1)})
    arrived = arrived.unionByName(again).unionByName(partial)
    replicas = [arrived.filter("role = 'generator'"), arrived.filter("role = 'verifier'")]
    requests = recorded_responses(steps).select("uid", "role", "turn_index")
    return joins.join_responses(requests, joins.merge_replicas(*replicas), arrival="seq")


# ---- steps, accuracy, outcomes --------------------------------------------------------------------------


@query("last_step", with_views("v_steps", """
SELECT conv_id, turn_index, g_raw FROM v_steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn_index DESC) = 1"""))
def last_step(spark, d):
    return metrics.last_step(v_steps(spark, d).select("conv_id", "turn_index", "g_raw"), "conv_id")


@query("early_stop", with_views("v_steps", f"""
SELECT conv_id, turn_index, verdict FROM (
  SELECT conv_id, turn_index, verdict, min(CASE WHEN verdict = 'correct' THEN turn_index END) OVER (PARTITION BY conv_id) AS stop
  FROM (SELECT conv_id, turn_index, {Q.verdict('v_raw')} AS verdict FROM v_steps) v) s
WHERE turn_index < {TURNS} AND (stop IS NULL OR turn_index <= stop)"""))
def early_stop(spark, d):
    judged = v_first_steps(spark, d).select("conv_id", "turn_index", final_verdict(c("v_raw")).alias("verdict"))
    return metrics.early_stop(judged, TURNS, key="conv_id")


_PUBLIC = Q.strip_think(Q.strip("g_raw"))
_ACCURACY = {
    "final": "SELECT * FROM v_steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn_index DESC) = 1",
    "said": f"SELECT conv_id, {_PUBLIC} AS public FROM final",
    "records": f"""SELECT 'train_' || s.conv_id AS episode_id, coalesce(t.question, '') AS question, t.ground_truth, public AS generator_message,
      public AS prediction_used, {Q.boxed_last('public')} AS parsed_prediction, {Q.simple_grade('public', 't.ground_truth')} AS is_correct
      FROM said s LEFT JOIN v_tasks t USING (conv_id)""",
}


def _accuracy_records(spark, d, steps=None):
    steps = v_steps(spark, d) if steps is None else steps
    spoken = steps.select(
        _uid().alias("uid"), "turn_index", strip_think(py_strip(c("g_raw"))).alias("student_response")
    )
    return metrics.accuracy_records(spoken, v_tasks(spark, d))


@query("gen_accuracy_detail", with_views(["v_steps", "v_tasks"], """
SELECT *, CASE WHEN is_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM records""", _ACCURACY))
def gen_accuracy_detail(spark, d):
    return _accuracy_records(spark, d)


@query("gen_accuracy", with_views(["v_steps", "v_tasks"], """
SELECT count(*) FILTER (WHERE is_correct) AS correct, count(*) AS total,
  CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE is_correct) / count(*) ELSE 0.0 END AS accuracy FROM records""", _ACCURACY))
def gen_accuracy(spark, d):
    return metrics.accuracy(_accuracy_records(spark, d))


@query("gen_accuracy_mathematics", with_views(["v_steps", "v_tasks"], """
SELECT count(*) FILTER (WHERE is_correct) AS correct, count(*) AS total,
  CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE is_correct) / count(*) ELSE 0.0 END AS accuracy FROM records""", _ACCURACY))
def gen_accuracy_mathematics(spark, d):
    """Accuracy by another grader, against truths that are written as expressions of the same value."""
    spoken = v_steps(spark, d).select(
        _uid().alias("uid"), "turn_index", strip_think(py_strip(c("g_raw"))).alias("student_response")
    )
    truth = F.concat(F.lit("\\frac{2 \\cdot "), c("ground_truth"), F.lit("}{2}"))
    return metrics.accuracy(metrics.accuracy_records(spoken, v_tasks(spark, d).withColumn("ground_truth", truth), mathematics_reward))


@query("episode_correct_any", with_views("v_dagger", f"""
SELECT 'train_' || conv_id AS uid, bool_or({Q.simple_grade('g_raw', 'ground_truth')}) AS is_correct FROM v_dagger GROUP BY conv_id"""))
def episode_correct_any(spark, d):
    steps = v_dagger(spark, d).select(
        _uid().alias("uid"), grading.grade_reward(c("g_raw"), c("ground_truth")).alias("reward")
    )
    return metrics.episode_correct_any(steps)


@query("episode_correct_last", with_views("v_steps", f"""
SELECT 'train_' || conv_id AS uid, coalesce({Q.verdict('v_raw')} = 'correct', false) AS is_correct
FROM v_steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn_index DESC) = 1"""))
def episode_correct_last(spark, d):
    steps = v_steps(spark, d).select(_uid().alias("uid"), "turn_index", c("v_raw").alias("student_response_raw"))
    return metrics.episode_correct_last(steps)


@query("transcripts", with_views(["v_steps", "v_tasks"], f"""
SELECT uid AS episode_id, {Q.text_json('''{'uid': uid, 'question': any_value(question), 'ground_truth': any_value(ground_truth)}''')} AS task,
  {Q.text_json('''[{'name': 'generator', 'steps': list(step ORDER BY turn_index) FILTER (WHERE role = 'generator')},
   {'name': 'verifier', 'steps': list(step ORDER BY turn_index) FILTER (WHERE role = 'verifier')}]''')} AS trajectories
FROM (SELECT *, {{'turn_index': turn_index, 'student_response': public, 'student_response_raw': raw, 'generator_message': gen_public,
  'generator_message_raw': gen_raw, 'teacher_target': CAST(NULL AS VARCHAR), 'chat_completions': chat}} AS step FROM steps) s GROUP BY uid""", _REPLAY))
def transcripts(spark, d):
    """Episodes of the replayed rollout, which ends at its turn limit."""
    nested = store.transcripts(replayed_steps(spark, d), v_tasks(spark, d))
    return nested.select(
        "episode_id", as_json(c("task")).alias("task"), as_json(c("trajectories")).alias("trajectories")
    )


# ---- training rows -----------------------------------------------------------------------------------------


@query("sft_build_pag", with_views(["v_steps", "v_tasks"], f"""
SELECT uid, role, turn_index, {Q.text_json('messages')} AS messages, msg_hash FROM hashed""", _SFT))
def sft_build_pag(spark, d):
    """Rows of the replayed rollout, which ends at its turn limit."""
    rows = sft.judged_rows(labelled_steps(spark, d))
    return rows.select("uid", "role", "turn_index", as_json(c("messages")).alias("messages"), "msg_hash")


@query("sft_build_dagger", with_views(["v_dagger", "v_tasks"], f"""
SELECT uid, role, turn_index, {Q.text_json('messages')} AS messages FROM ({_TAGGED_ROWS}) r""", _TAGGED_FULL))
def sft_build_dagger(spark, d):
    """Rows of the replayed rollout, which ends at its turn limit."""
    state, protocol = _tagged_state(spark, d, stop_on_fix=False)
    teacher = rollout.recorded_teacher(recorded_targets(v_first_tagged(spark, d)), TURNS)
    rows = sft.tagged_rows(relabel_steps(rollout.steps_of(state, protocol), teacher, materialise=False))
    return rows.select("uid", "role", "turn_index", as_json(c("messages")).alias("messages"))


# all tasks, those without a question too
_FUNNEL = {**_REPLAY, "pair": _recorded("v_steps").replace("WHERE t.question <> ''", "")}
_FUNNEL_REASON = _REASON.replace(
    "WHEN role = 'generator' AND NOT", "WHEN role = 'generator' AND question = '' THEN 'empty_question'\n  WHEN role = 'generator' AND NOT", 1
)


# ---- jobs ------------------------------------------------------------------------------------------------------

EVERYTHING = 1 << 40


@query("dagger_round", with_views(["v_steps", "v_tasks"], """
SELECT role, CASE role WHEN 'generator' THEN 1 ELSE 2 END::BIGINT AS round, msg_hash,
  max_by(uid, (uid, turn_index)) AS uid, max_by(turn_index, (uid, turn_index)) AS turn_index
FROM hashed GROUP BY role, msg_hash""", _SFT))
def dagger_round(spark, d):
    """A pair of rounds: sample, replay, transcripts, accuracy, relabel, build, dedupe, store."""
    out = new_folder(spark, "rounds")
    options = jobs.RoundOptions(
        batch_tasks=EVERYTHING, rounds=1, max_turns=TURNS, dump_transcripts=True, materialise=False
    )
    teacher = rollout.recorded_teacher(recorded_targets(v_first_steps(spark, d)), TURNS)
    jobs.alternate(recorded_dataset(spark, d), rollout.recorded_responder, teacher, options, out)
    stored = [store.read_store(spark, f"{out}/{role}_sft") for role in ("gen", "ver")]
    whole = stored[0].unionByName(stored[1])
    return whole.select("role", c("round").cast("bigint").alias("round"), "msg_hash", "uid", "turn_index")


def _numbered_targets(spark, d):
    """Recorded targets under the position a task takes in a whole sample."""
    numbered = rank_rows(v_tasks(spark, d).select("conv_id"), [], ["conv_id"], "place")
    targets = recorded_targets(v_first_tagged(spark, d)).join(
        numbered.select(_uid().alias("uid"), "place"), "uid"
    )
    return targets.select(
        F.concat(F.lit("train_"), c("place").cast("string")).alias("uid"), "role", "turn_index", "text"
    )


_COLLECTED = {
    **{k: v.replace("t.uid,", "'train_' || (row_number() OVER (ORDER BY t.conv_id) - 1) AS uid,") for k, v in _TAGGED_FULL.items()},
    "rows": _TAGGED_ROWS,
    "hashed": f"SELECT *, sha1({Q.canonical('messages')}) AS msg_hash FROM rows",
}
_KEPT_ONCE = """max_by(uid, (uid, turn_index)) AS uid, max_by(turn_index, (uid, turn_index)) AS turn_index
FROM hashed GROUP BY role, msg_hash"""


@query("collect_once", with_views(["v_dagger", "v_tasks"], f"SELECT role, msg_hash, {_KEPT_ONCE}", _COLLECTED))
def collect_once(spark, d):
    prefix = new_folder(spark, "collect")
    options = jobs.RoundOptions(batch_tasks=EVERYTHING, max_turns=TURNS, materialise=False)
    teacher = rollout.recorded_teacher(_numbered_targets(spark, d), TURNS)
    jobs.collect_once(recorded_dataset(spark, d, v_first_tagged, dense=True), rollout.recorded_responder, teacher, options, prefix)
    stored = [store.read_by_role(spark, prefix, table) for table in ("gen", "ver")]
    return stored[0].unionByName(stored[1]).select("role", "msg_hash", "uid", "turn_index")


@query("tagged_rounds", with_views(["v_dagger", "v_tasks"], f"""
SELECT role, CASE role WHEN 'generator' THEN 1 ELSE 2 END::BIGINT AS round, msg_hash, {_KEPT_ONCE}""", _COLLECTED))
def tagged_rounds(spark, d):
    """A generator and a verifier round of the tagged protocol, each on the whole dataset."""
    out = new_folder(spark, "tagged")
    options = jobs.RoundOptions(batch_tasks=EVERYTHING, rounds=1, max_turns=TURNS, materialise=False)
    teacher = rollout.recorded_teacher(_numbered_targets(spark, d), TURNS)
    jobs.alternate_tagged(recorded_dataset(spark, d, v_first_tagged, dense=True), rollout.recorded_responder, teacher, options, out)
    stored = [store.read_store(spark, f"{out}/{role}_sft") for role in ("gen", "ver")]
    whole = stored[0].unionByName(stored[1])
    return whole.select("role", c("round").cast("bigint").alias("round"), "msg_hash", "uid", "turn_index")


@query("eval_accuracy", with_views(["v_steps", "v_tasks"], f"""
SELECT count(*) FILTER (WHERE ok) AS correct, count(*) AS total, count(*) FILTER (WHERE ok) / count(*) AS accuracy
FROM (SELECT {Q.simple_grade('public', 'ground_truth')} AS ok FROM steps WHERE role = 'generator'
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY turn_index DESC) = 1) r""", _REPLAY))
def eval_accuracy(spark, d):
    options = jobs.RoundOptions(
        eval_tasks=EVERYTHING, eval_every=2, eval_seed=5, rounds=1, max_turns=TURNS, materialise=False
    )
    return jobs.evaluate(
        recorded_dataset(spark, d), rollout.recorded_responder, options, 2, new_folder(spark, "eval")
    )
