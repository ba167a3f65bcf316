"""The rollout against a plain simulation of one episode at a time."""

import pytest
from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.operators import rollout
from colloquy.operators.relabel import relabel
from colloquy.session import new_folder

TURNS = 7  # long enough for both history limits to cut


def cut(history, limit):
    if len(history) <= limit:
        return list(history)
    return history[:1] + history[-(limit - 1) :]


def public(raw):
    return raw.split("</think>", 1)[1].strip() if "</think>" in raw else raw


def said(role, uid, turn, prompt):
    """What the stub students answer; depends on the whole prompt."""
    size = sum(len(m["content"] or "") for m in prompt) + len(prompt)
    number = int(uid.split("_")[1])
    if role == "generator":
        kind = (number + turn) % 4
        box = f" \\boxed{{{size % 4}}} "
        return ["<think>x</think> so" + box, "<think>never ends" + box, "", box][kind]
    if number % 5 == turn:
        return f" <think>{size}</think> it is correct. "
    return [f"<think>a</think> {size} is wrong", "incorrect", "no idea", ""][(number + turn) % 4]


def simulate(uid, question, truth, max_turns):
    gen = [("system", V.GENERATOR_SYSTEM), ("user", question)]
    ver = [("system", V.JUDGED_VERIFIER_SYSTEM)]
    steps, correct = [], False
    as_dicts = lambda h: [{"role": r, "content": t} for r, t in h]
    for turn in range(max_turns):
        prompt = cut(gen, 12)
        raw = said("generator", uid, turn, as_dicts(prompt)).strip()
        gen.append(("assistant", raw))
        steps.append(("generator", turn, raw, public(raw), None, None, cut(gen, 9), prompt))
        unfinished = "<think>" in raw and "</think>" not in raw
        shown = raw if unfinished else public(raw)
        note = V.JUDGED_UNFINISHED_NOTE if unfinished else ""
        ver.append(("user", f"{V.JUDGED_VERIFY_INSTRUCTION}{note}\n\nQuestion:\n{question}\n\nPrevious answer:\n{shown}"))
        prompt = cut(ver, 12)
        verdict = said("verifier", uid, turn, as_dicts(prompt)).strip()
        ver.append(("assistant", verdict))
        reward = 1.0 if f"\\boxed{{{truth}}}" in raw else 0.0
        steps.append(("verifier", turn, verdict, public(verdict), raw, reward, cut(ver, 9), prompt))
        if "it is correct." in verdict:
            correct = True
            break
        gen.append(
            ("user", f"{V.JUDGED_REGENERATE_INSTRUCTION}\n\nQuestion:\n{question}\n\nVerifier feedback:\n{public(verdict)}")
        )
    return steps, correct


@pytest.fixture(scope="module")
def tasks(spark):
    return spark.range(23).select(
        F.concat(F.lit("t_"), "id").alias("uid"),
        F.concat(F.lit("What is "), "id", F.lit("?\n")).alias("question"),
        (F.col("id") % 4).cast("string").alias("ground_truth"),
    )


def students():
    def respond(df, role, turn):
        source, name = said_source(), role

        def answer(prompts, uids):
            scope = {}
            exec(source, scope)
            return [scope["said"](name, u, turn, p) for p, u in zip(prompts, uids)]

        return rollout.model_responder(answer, batch=5, slots=3)(df, role, turn)

    return respond


def said_source():
    import inspect

    return inspect.getsource(said)


def as_tuples(df):
    out = {}
    for r in df.collect():
        chat = lambda name: [(m["role"], m["content"]) for m in r[name]]
        out[(r["uid"], r["role"], r["turn_index"])] = (
            r["student_response_raw"], r["student_response"], r["generator_message_raw"], r["reward"],
            chat("chat_completions"), chat("teacher_prompt"), r["is_correct"],
        )
    return out


@pytest.fixture(scope="module")
def state(tasks):
    return rollout.run_rollout(tasks, students(), rollout.JUDGED, TURNS)


def test_rollout_equals_the_simulation(tasks, state):
    got = as_tuples(rollout.steps_of(state))
    want = {}
    for t in tasks.collect():
        steps, correct = simulate(t["uid"], t["question"], t["ground_truth"], TURNS)
        for role, turn, raw, pub, gen_raw, reward, chat, prompt in steps:
            want[(t["uid"], role, turn)] = (raw, pub, gen_raw, reward, chat, prompt, correct)
    assert got == want
    episodes = {r["uid"]: r["is_correct"] for r in rollout.episodes_of(state).collect()}
    assert episodes == {k[0]: v[-1] for k, v in want.items()}


def test_replay_equals_the_rollout(tasks, state):
    steps = rollout.steps_of(state)
    recorded = steps.select("uid", "role", "turn_index", F.col("student_response_raw").alias("text"))
    again = rollout.run_rollout(
        rollout.attach_recordings(tasks, recorded, TURNS), rollout.recorded_responder, rollout.JUDGED, TURNS,
        materialise=False,
    )
    assert as_tuples(rollout.steps_of(again)) == as_tuples(steps)


def test_a_rollout_goes_on_where_it_stopped(spark, tasks):
    folder = new_folder(spark, "resume")
    want = as_tuples(rollout.steps_of(rollout.run_rollout(tasks, students(), rollout.JUDGED, 2, folder=folder)))


    class Lazy:
        """Builds the phase, never runs it."""

        def __call__(self, df, role, turn):
            return df.withColumn("text", F.raise_error(F.lit("a finished phase was run again")).cast("string"))

    got = as_tuples(rollout.steps_of(rollout.run_rollout(tasks, Lazy(), rollout.JUDGED, 2, folder=folder)))
    assert got == want


def test_turn_limit_of_zero_means_one(spark, tasks):
    state = rollout.run_rollout(tasks, students(), rollout.JUDGED, 0)
    assert {r["turn_index"] for r in rollout.steps_of(state).collect()} == {0}


def test_early_stop_keeps_nothing_after_correct(state):
    last = {}
    for r in rollout.steps_of(state).filter("role = 'verifier'").collect():
        last[r["uid"]] = max(last.get(r["uid"], 0), r["turn_index"])
    for r in rollout.steps_of(state).filter("role = 'verifier'").collect():
        if r["student_response_raw"].endswith("correct."):
            assert r["turn_index"] == last[r["uid"]]


def test_tagged_rollout(spark, tasks):
    """Fixed turns; the verifier's whole text goes back; a boxed fix may stop it."""
    recorded = []
    for i in range(23):
        for turn in range(4):
            recorded.append((f"t_{i}", "generator", turn, f"g{turn} \\boxed{{{(i + turn) % 4}}} "))
            fix = "\\boxed{9}" if (i + turn) % 3 == 2 else ""
            recorded.append((f"t_{i}", "verifier", turn, "" if i == 4 else f"<fixed_answer>{fix}</fixed_answer> v{turn}"))
    responses = spark.createDataFrame(recorded, "uid string, role string, turn_index bigint, text string")
    for stop in (False, True):
        protocol = rollout.tagged(stop)
        state = rollout.run_rollout(
            rollout.attach_recordings(tasks, responses, 4), rollout.recorded_responder, protocol, 4, materialise=False
        )
        turns = {r["uid"]: r["turns"] for r in state.collect()}
        steps = {(r["uid"], r["role"], r["turn_index"]): r for r in rollout.steps_of(state, protocol).collect()}
        correct = {r["uid"]: r["is_correct"] for r in rollout.episodes_of(state, protocol).collect()}
        for i in range(23):
            stops = [t for t in range(4) if stop and i != 4 and (i + t) % 3 == 2]
            last = stops[0] if stops else 3
            assert turns[f"t_{i}"] == last + 1
            right = [(i + t) % 4 == i % 4 for t in range(last + 1)]
            assert correct[f"t_{i}"] == (right[last] if stops else any(right))
        step = steps[("t_0", "verifier", 0)]
        asked = "Question: What is 0?\n\n---\nGenerator message:\ng0 \\boxed{0}"
        assert [(m["role"], m["content"]) for m in step["chat_completions"]] == [
            ("user", asked), ("assistant", "<fixed_answer></fixed_answer> v0")
        ]
        assert step["reward"] == 1.0
        if not stop:
            chat = steps[("t_0", "generator", 1)]["chat_completions"]
            assert chat[3]["content"] == "<fixed_answer></fixed_answer> v0"
            # an empty verifier answer: its own prompt goes back instead
            assert steps[("t_4", "generator", 1)]["chat_completions"][3]["content"].startswith("Question: What is 4?")


def test_relabel_fills_only_what_is_missing(spark, tasks):
    steps = rollout.steps_of(rollout.run_rollout(tasks, students(), rollout.JUDGED, 2))
    some = F.when(F.col("turn_index") == 1, F.lit("old")).otherwise(F.col("teacher_target"))
    teacher = rollout.model_responder(lambda prompts, uids: [f" {len(p)} " for p in prompts], 4)
    got = relabel(steps.withColumn("teacher_target", some), teacher, "gen").collect()
    for r in got:
        if r["turn_index"] == 1:
            assert (r["teacher_target"], r["teacher_status"]) == ("old", None)
        elif r["role"] == "generator":
            assert (r["teacher_target"], r["teacher_status"], r["teacher_justification"]) == ("2", "revise", "")
        else:
            assert r["teacher_target"] is None
    assert relabel(steps, teacher, "none") is steps
