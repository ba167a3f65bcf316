"""Multi-turn rollout of a generator and a verifier, as phases over a state DataFrame.

One row per episode carries both histories.  Every phase builds prompts with Column
expressions, lets a *responder* add a ``text`` column, and appends it to the history.
Steps are read off the finished histories; nothing is joined back by position.

A responder is ``(df, role, turn) -> df`` with ``text`` added; ``df`` has ``uid``, ``prompt``
and ``active``.  ``model_responder`` calls a model in batches, ``recorded_responder``
looks up recorded responses.

The two protocols differ in three Columns: the verifier's user turn, the rule that closes an
episode, and the generator's next user turn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import fixed_values as V
from colloquy.functions import prompts
from colloquy.functions.grading import grade_reward, is_rewarded
from colloquy.functions.messages import append, message, messages_of, trim_history
from colloquy.functions.text import (
    boxed_first,
    final_verdict,
    fixed_answer,
    py_strip,
    strip_think,
    think_incomplete,
)
from colloquy.schema import STEP_COLUMNS, TASK_COLUMNS
from colloquy.session import content_mark, new_folder, write_once

ROLES = ("generator", "verifier")

Responder = Callable[[DataFrame, str, int], DataFrame]
#: cuts a column of prompts to what a model takes
Fit = Callable[[Column], Column]


@dataclass(frozen=True)
class Protocol:
    """How verifier and generator talk to each other."""

    verifier_system: str
    #: (question, generator's raw text) -> verifier's user turn
    ask: Callable[[Column, Column], Column]
    #: verifier's raw text -> whether the episode ends here
    closes: Callable[[Column], Column]
    #: (question, verifier's raw text, verifier's user turn) -> generator's next user turn
    feed_back: Callable[[Column, Column, Column], Column]
    #: whether public texts leave out the reasoning
    hides_reasoning: bool
    #: tells protocols apart in the folders of a job
    label: str = ""


def _judged_ask(question: Column, raw: Column) -> Column:
    # an unfinished reasoning block is shown as it is, with a note
    unfinished = think_incomplete(raw)
    return prompts.verify_prompt(question, F.when(unfinished, raw).otherwise(strip_think(raw)), unfinished)


JUDGED = Protocol(
    verifier_system=V.JUDGED_VERIFIER_SYSTEM,
    ask=_judged_ask,
    closes=lambda said: F.coalesce(final_verdict(said) == V.VERDICT_CORRECT, F.lit(False)),
    feed_back=lambda question, said, asked: prompts.regenerate_prompt(question, strip_think(said)),
    hides_reasoning=True,
    label="judged",
)


def tagged(stop_on_fix: bool = False) -> Protocol:
    """The protocol whose verifier answers in tags; it may stop at a boxed fixed answer."""
    fixes = lambda said: boxed_first(fixed_answer(said)).isNotNull()
    return Protocol(
        verifier_system=V.TAGGED_VERIFIER_SYSTEM,
        ask=prompts.tagged_verify_prompt,
        closes=fixes if stop_on_fix else (lambda said: F.lit(False)),
        feed_back=lambda question, said, asked: F.when(said == "", asked).otherwise(said),
        hides_reasoning=False,
        label=f"tagged, stop_on_fix={stop_on_fix}",
    )


# ---- responders ------------------------------------------------------------------------------


def model_responder(
    answer: Callable[[list, list], list], batch: int = 64, slots: int | None = None
) -> Responder:
    """Call ``answer(prompts, uids) -> texts`` in batches inside Spark tasks.

    Only the keys and prompts of open rows cross into Python; the rest of a row waits in the JVM, and answers come
    back in its order, so nothing is paired between tasks.  ``slots`` spreads the requests by uid; an episode
    then stays with one task.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for uids, prompts_ in batches:
            due = np.flatnonzero(prompts_.is_valid().to_numpy(zero_copy_only=False))
            texts = [None] * len(uids)
            size = batch if batch > 0 else max(len(due), 1)
            for start in range(0, len(due), size):
                chunk = pa.array(due[start : start + size])
                answers = answer(prompts_.take(chunk).to_pylist(), uids.take(chunk).to_pylist())
                for i, text in zip(chunk.to_pylist(), answers):
                    texts[i] = text
            yield pa.array(texts, pa.string())

    def respond(df: DataFrame, role: str, turn: int) -> DataFrame:
        if slots:
            df = df.repartition(slots, "uid")
        ask = F.arrow_udf(run, "string").asNondeterministic()
        return df.withColumn("text", ask(F.col("uid"), F.when(F.col("active"), F.col("prompt"))))

    return respond


def by_role(**responders: Responder) -> Responder:
    """One responder per role."""
    return lambda df, role, turn: responders[role](df, role, turn)


def by_episode(responses: DataFrame, max_turns: int, out: str) -> DataFrame:
    """Responses ``(uid, role, turn_index, text)`` as one row per episode.

    ``out`` holds, per role, an array of texts by turn.  Only turns the rollout can reach are
    kept, one text per role and turn; copies of a response collapse before the shuffle.
    """
    turns = range(max(int(max_turns), 1))
    said = lambda role, t: F.max(F.when((F.col("role") == role) & (F.col("turn_index") == t), F.col("text")))
    columns = {f"{role}_{t}": said(role, t) for role in ROLES for t in turns}
    whole = (
        responses.filter(F.col("turn_index") < len(turns))
        .groupBy("uid")
        .agg(*[agg.alias(name) for name, agg in columns.items()])
    )
    per_role = [F.array(*[F.col(f"{role}_{t}") for t in turns]).alias(role) for role in ROLES]
    return whole.select("uid", F.struct(*per_role).alias(out))


def attach_recordings(tasks: DataFrame, responses: DataFrame, max_turns: int) -> DataFrame:
    """Give each task its recorded responses."""
    return tasks.join(by_episode(responses, max_turns, "recorded"), "uid", "left")


def recorded_responder(df: DataFrame, role: str, turn: int) -> DataFrame:
    """Answer from the ``recorded`` column of ``attach_recordings``."""
    return df.withColumn("text", F.get(F.col("recorded")[role], F.lit(turn)))


def recorded_teacher(labels: DataFrame, max_turns: int) -> Responder:
    """A teacher that answers from a table ``(uid, role, turn_index, text)``.

    Joined by episode: the steps of a rollout lie together by ``uid`` already, so their
    long contexts are not shuffled again.
    """

    def respond(df: DataFrame, role: str, turn: int) -> DataFrame:
        joined = df.join(by_episode(labels, max_turns, "__labels"), "uid", "left")
        mine = F.when(F.col("role") == "generator", F.col("__labels.generator")).otherwise(F.col("__labels.verifier"))
        return joined.withColumn("text", F.get(mine, F.col("turn_index").cast("int"))).drop("__labels")

    return respond


def keyed_teacher(labels: DataFrame) -> Responder:
    """A teacher that answers from a table ``(uid, role, turn_index, text)``, step by step, at any turn."""

    def respond(df: DataFrame, role: str, turn: int) -> DataFrame:
        once = labels.groupBy("uid", "role", "turn_index").agg(F.max("text").alias("text"))
        return df.join(once, ["uid", "role", "turn_index"], "left")

    return respond


# ---- phases ------------------------------------------------------------------------------------


def open_episodes(tasks: DataFrame, protocol: Protocol) -> DataFrame:
    return tasks.withColumns(
        {
            "question": F.coalesce(F.col("question"), F.lit("")),
            "gen_hist": prompts.generator_opening(F.col("question")),
            "ver_hist": prompts.verifier_opening(protocol.verifier_system),
            "done": F.lit(False),
            "closed": F.lit(False),
            "turns": F.lit(0),
        }
    )


def _respond(state: DataFrame, history: str, role: str, turn: int, responder: Responder, fit: Fit | None) -> DataFrame:
    """Let the responder answer the history of every open episode, cut by messages and then by ``fit``; adds ``said``."""
    prompt = trim_history(F.col(history), V.ROLLOUT_HISTORY_LIMIT)
    asked = state.withColumns({"prompt": fit(prompt) if fit else prompt, "active": ~F.col("done")})
    answered = responder(asked, role, turn)
    return answered.withColumn("said", py_strip(F.coalesce(F.col("text"), F.lit("")))).drop("prompt", "text")


def _grow(history: str, *items: Column) -> Column:
    return F.when(F.col("active"), append(F.col(history), *items)).otherwise(F.col(history))


def generator_phase(state: DataFrame, turn: int, responder: Responder, fit: Fit | None = None) -> DataFrame:
    answered = _respond(state, "gen_hist", "generator", turn, responder, fit)
    return answered.withColumn("gen_hist", _grow("gen_hist", message("assistant", F.col("said")))).drop(
        "said", "active"
    )


def verifier_phase(
    state: DataFrame, turn: int, max_turns: int, responder: Responder, protocol: Protocol, fit: Fit | None = None
) -> DataFrame:
    """The verifier's part of a turn; adds the turn's two texts as ``generator`` and ``verifier``."""
    raw = F.try_element_at("gen_hist", F.lit(-1))["content"]
    asked = state.withColumn("active", ~F.col("done")).withColumn(
        "ver_hist", _grow("ver_hist", message("user", protocol.ask(F.col("question"), raw)))
    ).drop("active")
    answered = _respond(asked, "ver_hist", "verifier", turn, responder, fit)
    user_turn = F.try_element_at("ver_hist", F.lit(-1))["content"]
    closes = protocol.closes(F.col("said"))
    more = turn + 1 < max_turns
    judged = answered.withColumn("__closes", F.col("active") & closes)
    columns = {
        "generator": raw,
        "verifier": F.col("said"),
        "ver_hist": _grow("ver_hist", message("assistant", F.col("said"))),
        "turns": F.when(F.col("active"), F.lit(turn + 1)).otherwise(F.col("turns")),
        "closed": F.col("closed") | F.col("__closes"),
        "done": F.col("done") | F.col("__closes") | F.lit(not more),
    }
    if more:
        next_turn = protocol.feed_back(F.col("question"), F.col("said"), user_turn)
        columns["gen_hist"] = F.when(
            F.col("active") & ~F.col("__closes"), append(F.col("gen_hist"), message("user", next_turn))
        ).otherwise(F.col("gen_hist"))
    return judged.withColumns(columns).drop("said", "active", "__closes")


def run_rollout(
    tasks: DataFrame,
    responder: Responder,
    protocol: Protocol = JUDGED,
    max_turns: int = V.DEFAULT_MAX_TURNS,
    materialise: bool = True,
    folder: str | None = None,
    made_by: object = None,
    fit: Fit | None = None,
) -> DataFrame:
    """Roll every task out for at most ``max_turns`` turns; returns the final state.

    With ``materialise`` each phase is written below ``folder`` and read back: model
    output is neither repeatable nor cheap, so it is computed once, and this also cuts
    the lineage.  A phase found complete in ``folder`` is not run again, so a job that was
    cut short goes on where it stopped; one made with another protocol or limit, or for other tasks (``made_by``
    tells them apart, without it their content does), raises.  Closed episodes leave the loop.  Without
    ``materialise`` (recorded responses) the turns stay one lazy plan.

    What is written of an episode in a phase is bounded: the turn's texts, and the messages that the next
    prompts can show.  The whole histories are put together once, from the turns of all phases.  ``fit`` cuts
    prompts to a token budget before the responder sees them.
    """
    max_turns = max(int(max_turns), 1)
    state = open_episodes(tasks, protocol)
    if not materialise:
        for turn in range(max_turns):
            state = generator_phase(state, turn, responder, fit)
            state = verifier_phase(state, turn, max_turns, responder, protocol, fit).drop(*_TEXTS)
        return state

    if folder is not None:
        made_by = made_by or content_mark(tasks, *TASK_COLUMNS)
    folder = folder or new_folder(tasks.sparkSession, "rollout")
    made_by = (protocol.label, protocol.verifier_system, max_turns, made_by)

    finished, log = [], []
    for turn in range(max_turns):
        spoken = write_once(_windows(generator_phase(state, turn, responder, fit)), f"{folder}/turn={turn}/generator", made_by)
        judged = _windows(verifier_phase(spoken, turn, max_turns, responder, protocol, fit))
        after = write_once(judged, f"{folder}/turn={turn}/verifier", made_by)
        log.append(after.select("uid", F.lit(turn).alias("turn"), *_TEXTS))
        after = after.drop(*_TEXTS)
        finished.append(after.filter("done"))
        state = after.filter("NOT done")
        if turn + 1 < max_turns and state.isEmpty():
            break
    return _with_histories(_all(finished), _all(log), protocol)


#: the texts of one turn
_TEXTS = ("generator", "verifier")


def _all(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for part in tables[1:]:
        whole = whole.unionByName(part)
    return whole


def _windows(state: DataFrame) -> DataFrame:
    """Histories cut to what later prompts can show of them."""
    return state.withColumns({h: trim_history(F.col(h), V.ROLLOUT_HISTORY_LIMIT) for h in ("gen_hist", "ver_hist")})


def _with_histories(episodes: DataFrame, log: DataFrame, protocol: Protocol) -> DataFrame:
    """Finished episodes with both whole histories, from the log ``(uid, turn, generator, verifier)``."""
    turns = log.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("turn", *_TEXTS))).alias("__log"))  # at most max_turns
    question, said = F.col("question"), F.col("__log")
    ask = lambda x: protocol.ask(question, x["generator"])

    def generator(x: Column, i: Column) -> Column:
        spoke = message("assistant", x["generator"])
        fed = message("user", protocol.feed_back(question, x["verifier"], ask(x)))
        return F.when(i + 1 < F.size(said), messages_of(spoke, fed)).otherwise(messages_of(spoke))

    talk = lambda x: messages_of(message("user", ask(x)), message("assistant", x["verifier"]))
    histories = {
        "gen_hist": F.concat(prompts.generator_opening(question), F.flatten(F.transform(said, generator))),
        "ver_hist": F.concat(prompts.verifier_opening(protocol.verifier_system), F.flatten(F.transform(said, talk))),
    }
    return episodes.drop(*histories).join(turns, "uid").withColumns(histories).select(*episodes.columns)


# ---- results -----------------------------------------------------------------------------------


def _content(history: str, position: Column) -> Column:
    return F.get(F.col(history), position)["content"]


def episodes_of(state: DataFrame, protocol: Protocol = JUDGED, grader=grade_reward) -> DataFrame:
    """One row per episode.

    Judged episodes are correct if the last verdict closed them.  Tagged ones are
    graded: at the turn that closed them, else by any rewarded turn.
    """
    if protocol.hides_reasoning:
        correct = F.col("closed")
    else:
        right = lambda t: is_rewarded(grader(_content("gen_hist", t * 2 + 2), F.col("ground_truth")))
        any_turn = F.exists(F.sequence(F.lit(0), F.col("turns") - 1), right)
        correct = F.when(F.col("closed"), right(F.col("turns") - 1)).otherwise(any_turn)
    return state.select(
        "uid", "question", "ground_truth", correct.alias("is_correct"),
        F.col("turns").cast("bigint").alias("turns"), F.lit("env_done").alias("termination_reason"),
    )


def steps_of_turns(turns: DataFrame, protocol: Protocol = JUDGED, grader=grade_reward, block: int = 64) -> DataFrame:
    """The steps table of recorded turns ``(uid, question, ground_truth, turn_index, generator, verifier)``.

    Turns count from 0 without a gap, and each is a step of either role: no limit, no early stop, and
    ``is_correct`` is NULL. The history limits bound what a step's contexts show, so a step needs the
    turns just before it only: an episode is cut into blocks, each with copies of those before it.
    """
    depth = max(V.ROLLOUT_HISTORY_LIMIT, V.TRAINING_HISTORY_LIMIT) // 2
    home = F.expr(f"turn_index div {block}")
    blocks = F.when(F.col("turn_index") % block >= block - depth, F.array(home, home + 1)).otherwise(F.array(home))
    said = lambda name: py_strip(F.coalesce(F.col(name), F.lit(""))).alias(name)
    near = Window.partitionBy("uid", "__block").orderBy("turn_index").rowsBetween(-depth, 0)
    seen = (
        turns.select(
            "uid", F.coalesce("question", F.lit("")).alias("question"), "ground_truth", "turn_index",
            said("generator"), said("verifier"), F.explode(blocks).alias("__block"),
        )
        .withColumn("__turns", F.collect_list(F.struct("turn_index", "generator", "verifier")).over(near))
        .filter(F.col("__block") == home)
    )
    question, seen_turns = F.col("question"), F.col("__turns")
    ask = lambda x: protocol.ask(question, x["generator"])

    def fed(x: Column, i: Column) -> Column:
        before = F.get(seen_turns, i - 1)
        return F.when(x["turn_index"] == 0, question).otherwise(protocol.feed_back(question, before["verifier"], ask(before)))

    def history(opening: Column, asks, answers: str) -> Column:
        talk = F.transform(seen_turns, lambda x, i: messages_of(message("user", asks(x, i)), message("assistant", x[answers])))
        known = F.when(F.get(seen_turns, F.lit(0))["turn_index"] == 0, talk).otherwise(F.slice(talk, 2, depth))
        return F.concat(F.slice(opening, 1, 1), F.flatten(known))

    each = seen.withColumn("role", F.explode(F.array(F.lit("generator"), F.lit("verifier"))))
    verifies = F.col("role") == "verifier"
    whole = F.when(
        verifies, history(prompts.verifier_opening(protocol.verifier_system), lambda x, i: ask(x), "verifier")
    ).otherwise(history(prompts.generator_opening(question), fed, "generator"))
    up_to_now = F.col("__history")
    context = trim_history(up_to_now, V.TRAINING_HISTORY_LIMIT)
    public = strip_think if protocol.hides_reasoning else (lambda c: c)
    if not protocol.hides_reasoning:
        context = F.when(verifies, F.slice(up_to_now, -2, 2)).otherwise(context)
    none = F.lit(None).cast("string")
    return each.withColumns(
        {"__history": whole, "student_response_raw": F.when(verifies, F.col("verifier")).otherwise(F.col("generator"))}
    ).withColumns(
        {
            "is_correct": F.lit(None).cast("boolean"),
            "chat_completions": context,
            "teacher_prompt": trim_history(F.slice(up_to_now, F.lit(1), F.size(up_to_now) - 1), V.ROLLOUT_HISTORY_LIMIT),
            "student_response": public(F.col("student_response_raw")),
            "generator_message": F.when(verifies, public(F.col("generator"))),
            "generator_message_raw": F.when(verifies, F.col("generator")),
            "reward": F.when(verifies, grader(F.col("generator"), F.col("ground_truth"))),
            "teacher_status": none,
            "teacher_justification": none,
            "teacher_target": none,
        }
    ).select(*STEP_COLUMNS)


def steps_of(state: DataFrame, protocol: Protocol = JUDGED, grader=grade_reward) -> DataFrame:
    """The steps table: one row per (uid, role, turn_index), unlabelled.

    Turn ``t`` speaks at position ``2t + 2`` of either history (from 0).
    """
    turns = state.filter("turns > 0").withColumn("__t", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    each = turns.withColumn("role", F.explode(F.array(F.lit("generator"), F.lit("verifier"))))
    spoke = F.col("__t") * 2 + 2
    verifies = F.col("role") == "verifier"
    history = F.when(verifies, F.col("ver_hist")).otherwise(F.col("gen_hist"))
    raw = each.withColumns(
        {
            "__history": history,
            "student_response_raw": F.get(history, spoke)["content"],
            "__generator_raw": _content("gen_hist", spoke),
        }
    )
    public = strip_think if protocol.hides_reasoning else (lambda c: c)
    up_to_now = F.slice("__history", F.lit(1), spoke + 1)
    before = F.slice("__history", F.lit(1), spoke)
    context = trim_history(up_to_now, V.TRAINING_HISTORY_LIMIT)
    if not protocol.hides_reasoning:
        # a tagged verifier step shows its own exchange only
        context = F.when(verifies, F.slice("__history", spoke, F.lit(2))).otherwise(context)
        correct = F.lit(None).cast("boolean")
    else:
        correct = F.col("closed")
    none = F.lit(None).cast("string")
    return raw.withColumns(
        {
            "turn_index": F.col("__t").cast("bigint"),
            "is_correct": correct,
            "chat_completions": context,
            "teacher_prompt": trim_history(before, V.ROLLOUT_HISTORY_LIMIT),
            "student_response": public(F.col("student_response_raw")),
            "generator_message": F.when(verifies, public(F.col("__generator_raw"))),
            "generator_message_raw": F.when(verifies, F.col("__generator_raw")),
            "reward": F.when(verifies, grader(F.col("__generator_raw"), F.col("ground_truth"))),
            "teacher_status": none,
            "teacher_justification": none,
            "teacher_target": none,
        }
    ).select(*STEP_COLUMNS)
