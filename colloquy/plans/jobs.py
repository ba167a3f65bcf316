"""Whole jobs: one round, alternating rounds, one-shot collection, evaluation.

Each job chains DataFrame operators and writes one table per stage.  A job started again in
the same folder takes finished stages as they are and goes on behind them.  What a round
stores is decided by the round's role, whatever was labelled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.functions.grading import grade_reward
from colloquy.functions.messages import count_words
from colloquy.operators import rollout, sft
from colloquy.operators.metrics import accuracy, accuracy_records
from colloquy.operators.relabel import relabel
from colloquy.operators.rollout import JUDGED, Protocol, Responder
from colloquy.operators.sampling import (
    INDEX,
    eval_rounds,
    fresh_schedule,
    sample_random,
    sample_random_all,
    sample_sequential,
    task_uid,
)
from colloquy.schema import TASK_COLUMNS
from colloquy.session import content_mark, input_mark, write_once
from colloquy.sources import store

ROLE_NAMES = {"gen": "generator", "ver": "verifier"}


@dataclass(frozen=True)
class RoundOptions:
    """Options of a job; names follow what they set."""

    split: str = "train"
    batch_tasks: int = 256
    rounds: int = 1
    seed: int = 0
    sample_mode: str = "random"  # or "sequential"
    sample_start: int = 0
    shard: int = 0
    shards: int = 1
    max_turns: int = V.DEFAULT_MAX_TURNS
    collect_for: str = "auto"
    storage: str = "parquet"  # "json", "parquet_shards", or "append_only"
    mirror_json: bool = False
    latest_only: bool = False
    dump_transcripts: bool = False
    dump_tasks: bool = False
    dataset_head: int = 0
    truncate_tokens: int = 0
    eval_tasks: int = 0
    eval_every: int = 1
    eval_seed: int = 0
    materialise: bool = True
    #: tokens of a message: (content Column) -> Column
    counter: Callable[[Column], Column] = count_words
    #: cuts prompts to the model's token budget before each call: (messages Column) -> Column
    fit_prompt: Callable[[Column], Column] | None = None

    def sampling(self) -> tuple:
        """What decides the tasks of a pair of rounds."""
        return (self.split, self.batch_tasks, self.seed, self.sample_mode, self.sample_start, self.shard, self.shards)


def sample_round_tasks(dataset: DataFrame, o: RoundOptions, pair: int) -> DataFrame:
    """Tasks of a pair of rounds: ``uid, question, ground_truth`` plus carried columns."""
    if o.sample_mode == "sequential":
        start = o.sample_start + pair * o.batch_tasks
        taken = sample_sequential(dataset, o.batch_tasks, start, o.shard, o.shards).drop("batch_pos")
    elif o.sample_mode == "random":
        taken = sample_random(dataset, o.batch_tasks, o.seed + pair + 1, o.shard, o.shards)
    else:
        raise ValueError(f"unknown sample mode {o.sample_mode!r}: use 'random' or 'sequential'")
    return taken.withColumn("uid", task_uid(o.split, F.col(INDEX)))


def labelled_rollout(
    tasks: DataFrame, student: Responder, teacher: Responder, o: RoundOptions, collect_for: str = "both",
    protocol: Protocol = JUDGED, folder: str | None = None, grader=grade_reward,
) -> DataFrame:
    """Roll out and label in one go, as a workflow with an inline teacher does.

    The teacher sees the prompts the students saw, so labelling after the rollout gives
    the same rows.
    """
    mark = content_mark(tasks, *TASK_COLUMNS) if folder else None
    state = rollout.run_rollout(
        tasks, student, protocol, o.max_turns, materialise=o.materialise, fit=o.fit_prompt, folder=folder and f"{folder}/rollout", made_by=mark
    )
    steps = rollout.steps_of(state, protocol, grader)
    made_by = (protocol.label, o.max_turns, mark)
    return relabel(steps, teacher, collect_for, folder=folder and f"{folder}/labelled", made_by=made_by)


def dump_dataset_head(dataset: DataFrame, o: RoundOptions, out: str) -> None:
    """The first tasks a job would take, as JSON lines."""
    if o.dataset_head > 0:
        head = dataset.select(INDEX, "question", "ground_truth")
        if o.sample_mode == "sequential":
            taken = sample_sequential(head, o.dataset_head, o.sample_start, o.shard, o.shards).drop("batch_pos")
        else:
            taken = sample_random(head, o.dataset_head, o.seed, o.shard, o.shards)
        store.dump_json(
            taken.select(task_uid(o.split, F.col(INDEX)).alias("uid"), "question", "ground_truth"),
            f"{out}/dataset_head_sample.jsonl",
        )


def judged_round(
    tasks: DataFrame,
    student: Responder,
    teacher: Responder,
    o: RoundOptions,
    round_idx: int,
    role: str,
    out: str,
    grader=grade_reward,
) -> DataFrame:
    """One round of the judged protocol up to the stored rows; returns the labelled candidates."""
    here = f"{out}/round={round_idx:03d}"
    made_by = (o.max_turns, content_mark(tasks, *TASK_COLUMNS))
    state = rollout.run_rollout(
        tasks, student, JUDGED, o.max_turns, materialise=o.materialise, fit=o.fit_prompt, folder=f"{here}/rollout", made_by=made_by
    )
    steps = write_once(rollout.steps_of(state, JUDGED, grader), f"{here}/steps", made_by)
    if o.dump_transcripts:
        store.dump_json(store.transcripts(steps, tasks), f"{here}/transcripts")
    records = accuracy_records(steps.filter("role = 'generator'"), tasks, grader)
    store.write_accuracy_records(records, f"{out}/accuracy", "train", round_idx)
    collect_for = role if o.collect_for == "auto" else o.collect_for
    labelled = relabel(steps, teacher, collect_for, folder=f"{here}/labelled", made_by=made_by)
    candidates = write_once(sft.judged_candidates(labelled, grader), f"{here}/candidates", (*made_by, collect_for))
    kept = candidates.filter(F.col("reason") == sft.KEPT)
    store_rows(kept, o, round_idx, role, out)
    return candidates


def store_rows(rows: DataFrame, o: RoundOptions, round_idx: int, role: str, out: str) -> None:
    """Keep the rows of the round's role, in the storage the job asks for."""
    mine = rows.filter(F.col("role") == ROLE_NAMES[role]).select(
        "uid", "role", "turn_index", "messages", F.lit(round_idx).alias("round"),
        F.struct(F.lit(round_idx), F.col("uid"), F.col("turn_index")).alias("seq"),
    )
    if o.storage == "parquet_shards":
        store.write_shard(
            mine.drop("seq"), f"{out}/{role}_sft_shards", f"{role}_sft", round_idx, o.truncate_tokens, o.counter
        )
        if o.mirror_json:
            # one folder per round, so that a repeated round does not double its lines
            store.dump_json(mine.select("messages"), f"{out}/{role}_sft.jsonl/round={round_idx:03d}")
        return
    if o.storage == "append_only":
        # same set of messages as the rewriting stores, at the cost of the new rows only
        store.append_new_only(mine, f"{out}/{role}_sft_parts", "seq", f"round={round_idx:03d}")
    else:
        store.append_distinct(
            mine, f"{out}/{role}_sft", "seq", file_format=o.storage,
            position="first" if o.storage == "json" else "last",
        )
    if o.latest_only:
        store.write_latest(
            mine.drop("seq"), f"{out}/{role}_sft_latest", f"{role}_sft_latest", round_idx, o.truncate_tokens,
            o.counter,
        )


def evaluate(
    dataset: DataFrame, student: Responder, o: RoundOptions, round_idx: int, out: str, grader=grade_reward
) -> DataFrame | None:
    """Accuracy on an evaluation sample, without labelling; ``None`` when this round has none."""
    due = dict(eval_rounds(dataset.sparkSession, o.rounds, o.eval_every, o.eval_seed))
    if o.eval_tasks <= 0 or round_idx not in due:
        return None
    sampled = sample_random(dataset, o.eval_tasks, due[round_idx]).withColumn("uid", task_uid(o.split, F.col(INDEX)))
    here = f"{out}/eval={round_idx:03d}"
    made_by = (o.split, o.eval_tasks, due[round_idx], input_mark(dataset, INDEX))
    tasks = write_once(sampled, f"{here}/tasks", made_by)
    state = rollout.run_rollout(
        tasks, student, JUDGED, o.max_turns, materialise=o.materialise, fit=o.fit_prompt, folder=here, made_by=made_by
    )
    steps = rollout.steps_of(state, JUDGED, grader).filter("role = 'generator'")
    records = accuracy_records(steps, tasks, grader)
    store.write_accuracy_records(records, f"{out}/accuracy", "eval", round_idx)
    written = dataset.sparkSession.read.schema(records.schema).json(f"{out}/accuracy/tag=eval/round={round_idx}")
    return accuracy(written)


def alternate(
    dataset: DataFrame,
    student: Responder,
    teacher: Responder,
    o: RoundOptions,
    out: str,
    eval_dataset: DataFrame | None = None,
    grader=grade_reward,
) -> None:
    """Alternating generator and verifier rounds of the judged protocol, pairs sharing tasks."""
    spark = dataset.sparkSession
    dump_dataset_head(dataset, o, out)
    for round_idx in range(1, 2 * o.rounds + 1):
        role = "gen" if round_idx % 2 == 1 else "ver"
        pair = (round_idx - 1) // 2
        folder = f"{out}/tasks/pair={pair:03d}"
        if role == "gen":
            write_once(sample_round_tasks(dataset, o, pair), folder, (o.sampling(), input_mark(dataset, INDEX)))
        tasks = spark.read.parquet(folder)
        if o.dump_tasks:
            store.dump_json(
                tasks.select("uid", "question", "ground_truth"), f"{out}/sampled_tasks_round_{round_idx:03d}.jsonl"
            )
        if tasks.isEmpty():
            continue
        judged_round(tasks, student, teacher, o, round_idx, role, out, grader)
        evaluate(eval_dataset if eval_dataset is not None else dataset, student, o, round_idx, out, grader)


def sample_tagged_tasks(dataset: DataFrame, o: RoundOptions, seed: int) -> DataFrame:
    """Tasks of the tagged protocol, numbered by their position in the sample."""
    taken = sample_random_all(dataset, o.batch_tasks, seed)
    return taken.withColumn("uid", task_uid(o.split, F.col("sample_pos"))).drop("sample_pos")


def written_tagged_tasks(dataset: DataFrame, o: RoundOptions, seed: int, here: str) -> DataFrame:
    """The sample of a tagged round or collection, written once; another seed, size or dataset in the same folder raises."""
    made_by = (o.split, o.batch_tasks, seed, input_mark(dataset, INDEX))
    return write_once(sample_tagged_tasks(dataset, o, seed), f"{here}/tasks", made_by)


def _tagged_rows(
    tasks: DataFrame, student: Responder, teacher: Responder, o: RoundOptions, collect_for: str,
    stop_on_fix: bool, here: str, grader,
) -> DataFrame:
    protocol = rollout.tagged(stop_on_fix)
    return sft.tagged_rows(labelled_rollout(tasks, student, teacher, o, collect_for, protocol, here, grader))


def tagged_round(
    dataset: DataFrame, student: Responder, teacher: Responder, o: RoundOptions, round_idx: int, out: str,
    stop_on_fix: bool = False, grader=grade_reward, role: str | None = None, seed: int | None = None,
) -> None:
    """One round of the tagged protocol, with a new sample; role and seed are those of the fresh schedule."""
    role = role or ("gen" if round_idx % 2 == 1 else "ver")
    seed = o.seed + round_idx if seed is None else seed
    here = f"{out}/round={round_idx:03d}"
    tasks = written_tagged_tasks(dataset, o, seed, here)
    rows = _tagged_rows(
        tasks, student, teacher, o, role if o.collect_for == "auto" else o.collect_for, stop_on_fix, here, grader,
    )
    store_rows(rows, o, round_idx, role, out)


def alternate_tagged(
    dataset: DataFrame, student: Responder, teacher: Responder, o: RoundOptions, out: str, stop_on_fix: bool = False
) -> None:
    for r in fresh_schedule(dataset.sparkSession, o.rounds, o.seed).collect():  # a row a round
        tagged_round(dataset, student, teacher, o, r["round"], out, stop_on_fix, role=r["role"], seed=r["seed"])


def collect_once(
    dataset: DataFrame, student: Responder, teacher: Responder, o: RoundOptions, prefix: str,
    stop_on_fix: bool = False, grader=grade_reward,
) -> None:
    """Sample, roll out, label and store both roles' rows once, in two tables."""
    tasks = written_tagged_tasks(dataset, o, o.seed, f"{prefix}_work")
    rows = _tagged_rows(
        tasks, student, teacher, o, "both" if o.collect_for == "auto" else o.collect_for,
        stop_on_fix, f"{prefix}_work", grader,
    )
    store.write_by_role(
        rows.withColumn("seq", F.struct("uid", "turn_index")), prefix, "seq"
    )
