"""Whole jobs on recorded responses, and the measured figures of the views."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import rollout, sft
from colloquy.operators.relabel import relabel
from colloquy.plans import episode_queries as E
from colloquy.plans import jobs
from colloquy.plans.catalog import QUERIES
from colloquy.plans.views import v_first_steps, v_tasks
from colloquy.session import Files, new_folder
from colloquy.sources import store

D = "/root/testdata/sf0.01"


def test_figures(spark):
    accuracy = QUERIES["gen_accuracy"](spark, D).first()
    assert (accuracy["correct"], accuracy["total"]) == (25, 98)
    stopped = QUERIES["early_stop"](spark, D).collect()
    assert len(stopped) == 191
    assert sum(r["verdict"] == "correct" for r in stopped) == 44
    state = rollout.run_rollout(E.recorded_dataset(spark, D), rollout.recorded_responder, rollout.JUDGED, E.TURNS, materialise=False)
    teacher = rollout.recorded_teacher(E.recorded_targets(v_first_steps(spark, D)), E.TURNS)
    steps = relabel(rollout.steps_of(state, rollout.JUDGED), teacher, materialise=False)
    funnel = {(r["role"], r["reason"]): r["n"] for r in sft.funnel(sft.judged_candidates(steps)).collect()}
    assert funnel == {
        ("generator", "kept"): 47, ("generator", "no_target"): 158, ("generator", "gt_mismatch"): 60,
        ("generator", "think_incomplete"): 23, ("generator", "empty_question"): 15, ("verifier", "kept"): 66,
        ("verifier", "no_target"): 154, ("verifier", "gt_mismatch"): 83,
    }
    assert QUERIES["sft_append_parquet"](spark, D).count() == 118


@pytest.fixture(scope="module")
def setting(spark):
    dataset = E.recorded_dataset(spark, D).cache()
    teacher = rollout.recorded_teacher(E.recorded_targets(v_first_steps(spark, D)).cache(), 2)
    return dataset, teacher


def run(spark, setting, **options):
    dataset, teacher = setting
    out = new_folder(spark, "job")
    o = jobs.RoundOptions(max_turns=2, materialise=False, **options)
    jobs.alternate(dataset, rollout.recorded_responder, teacher, o, out)
    return out


def test_rounds_share_tasks_and_store_their_role_only(spark, setting):
    out = run(spark, setting, batch_tasks=20, rounds=2, collect_for="both", sample_mode="random", dump_tasks=True)
    uids = [
        {r["uid"] for r in spark.read.json(f"{out}/sampled_tasks_round_{r:03d}.jsonl").collect()} for r in (1, 2, 3, 4)
    ]
    assert uids[0] == uids[1] and uids[2] == uids[3] and uids[0] != uids[2]
    gen = store.read_store(spark, f"{out}/gen_sft").collect()
    ver = store.read_store(spark, f"{out}/ver_sft").collect()
    assert {r["role"] for r in gen} == {"generator"} and {r["round"] for r in gen} <= {1, 3}
    assert {r["role"] for r in ver} == {"verifier"} and {r["round"] for r in ver} <= {2, 4}
    assert len({r["msg_hash"] for r in gen}) == len(gen)


def test_shard_storage_with_mirror_and_latest(spark, setting):
    out = run(spark, setting, batch_tasks=30, storage="parquet_shards", mirror_json=True, truncate_tokens=40)
    shards = spark.read.parquet(f"{out}/gen_sft_shards")
    assert shards.count() == spark.read.json(f"{out}/gen_sft.jsonl").count() > 0
    out = run(spark, setting, batch_tasks=30, storage="json", latest_only=True)
    latest = store.read_store(spark, f"{out}/gen_sft_latest")
    assert latest.count() > 0 and {r["round"] for r in latest.collect()} == {1}


def test_append_only_storage_holds_the_same_messages(spark, setting):
    kept = run(spark, setting, batch_tasks=60, rounds=2, storage="append_only")
    whole = run(spark, setting, batch_tasks=60, rounds=2)
    for role, rounds in (("gen", (1, 3)), ("ver", (2, 4))):
        log = store.log_of(spark, f"{kept}/{role}_sft_parts")
        parts = [log.read(label=f"round={r:03d}") for r in rounds]
        got = [r["msg_hash"] for p in parts for r in p.collect()]
        want = [r["msg_hash"] for r in store.read_store(spark, f"{whole}/{role}_sft").collect()]
        assert sorted(got) == sorted(want)


def test_a_job_can_be_started_again(spark, setting):
    dataset, teacher = setting
    out = new_folder(spark, "job")
    o = jobs.RoundOptions(max_turns=2, batch_tasks=40, storage="parquet_shards", mirror_json=True)
    sizes = []
    for answers in (rollout.recorded_responder, None):  # the second time nobody is asked
        jobs.alternate(dataset, answers or (lambda df, r, t: df.withColumn("text", F.lit("other"))), teacher, o, out)
        sizes.append((spark.read.parquet(f"{out}/gen_sft_shards").count(), spark.read.json(f"{out}/gen_sft.jsonl").count()))
    assert sizes[0] == sizes[1] and sizes[0][0] == sizes[0][1] > 0


def test_evaluation_rounds(spark, setting):
    out = run(spark, setting, batch_tasks=5, rounds=2, eval_tasks=10, eval_every=2)
    files = Files(spark, f"{out}/accuracy")
    assert files.children(f"{out}/accuracy/tag=eval") == ["round=2", "round=4"]
    assert files.children(f"{out}/accuracy/tag=train") == [f"round={r}" for r in (1, 2, 3, 4)]


def test_unknown_sample_mode(spark, setting):
    with pytest.raises(ValueError):
        run(spark, setting, sample_mode="shuffled")


def candidate(spark, **values):
    base = dict(
        uid="u", role="generator", turn_index=0, question="Q", ground_truth="1", chat_completions=[], reward=None,
        student_response="", student_response_raw="\\boxed{1}", generator_message=None, generator_message_raw=None,
        teacher_target="so \\boxed{1}",
    )
    base.update(values)
    ddl = (
        "uid string, role string, turn_index bigint, question string, ground_truth string, chat_completions "
        "array<struct<role:string,content:string>>, reward double, student_response string, student_response_raw string, "
        "generator_message string, generator_message_raw string, teacher_target string"
    )
    df = spark.createDataFrame([tuple(base.values())], ddl)
    r = sft.judged_candidates(df).first()
    return r["reason"], r["messages"] and [(m["role"], m["content"]) for m in r["messages"]]


def test_reasons(spark):
    why = lambda **kw: candidate(spark, **kw)[0]
    assert why() == "kept"
    assert why(teacher_target="") == "no_target"
    assert why(teacher_target=None) == "no_target"
    assert why(question="", teacher_target="\\boxed{2}") == "empty_question"
    assert why(teacher_target="\\boxed{2}") == "gt_mismatch"
    assert why(teacher_target="\\boxed{2}", ground_truth=None) == "kept"
    assert why(teacher_target="<think> \\boxed{1}") == "think_incomplete"
    ver = dict(role="verifier", generator_message="g", generator_message_raw="\\boxed{1}")
    assert why(**ver, teacher_target="correct") == "kept"
    assert why(**ver, teacher_target="incorrect") == "gt_mismatch"
    assert why(**ver, teacher_target="unsure") == "gt_mismatch"
    assert why(**ver, teacher_target="unsure", ground_truth="") == "kept"
    # an empty generator message: the verifier's own text is graded
    empty = dict(role="verifier", generator_message="", generator_message_raw="", student_response_raw="\\boxed{1}")
    assert why(**empty, teacher_target="incorrect") == "gt_mismatch"
    assert why(**empty, teacher_target="correct") == "empty_context"
    assert why(**empty, teacher_target="correct", chat_completions=[("user", "x")]) == "kept"


def test_rebuilt_contexts(spark):
    _, got = candidate(spark)
    assert [r for r, _ in got] == ["system", "user", "assistant"]
    assert got[1] == ("user", "Q") and got[2] == ("assistant", "so \\boxed{1}")
    _, got = candidate(spark, chat_completions=[("system", "s"), ("user", "q"), ("assistant", "old")])
    assert got == [("system", "s"), ("user", "q"), ("assistant", "so \\boxed{1}")]
    _, got = candidate(spark, role="verifier", generator_message="g", generator_message_raw="\\boxed{1}", teacher_target="correct")
    assert got[1][1].endswith("\n\nQuestion:\nQ\n\nPrevious answer:\ng")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tasks_of_a_sample(spark):
    o = jobs.RoundOptions(batch_tasks=7)
    tasks = v_tasks(spark, D).withColumn("source_idx", F.col("conv_id"))
    got = jobs.sample_tagged_tasks(tasks, o, 3)
    assert sorted(r["uid"] for r in got.collect()) == sorted(f"train_{i}" for i in range(7))


def test_other_tasks_in_the_same_folder_raise(spark, setting):
    """Another evaluation size, another seed, other steps: nothing finished is taken for them."""
    dataset, teacher = setting
    out = new_folder(spark, "job")
    o = dict(max_turns=1, rounds=1, eval_every=2, materialise=False)
    first = jobs.evaluate(dataset, rollout.recorded_responder, jobs.RoundOptions(eval_tasks=5, **o), 2, out).first()
    again = jobs.evaluate(dataset, rollout.recorded_responder, jobs.RoundOptions(eval_tasks=5, **o), 2, out).first()
    assert first == again and 0 < first["total"] <= 5
    with pytest.raises(RuntimeError, match="other options or input"):
        jobs.evaluate(dataset, rollout.recorded_responder, jobs.RoundOptions(eval_tasks=20, **o), 2, out)
    other = dataset.filter("source_idx % 2 = 0")  # another version of the dataset
    with pytest.raises(RuntimeError, match="other options or input"):
        jobs.evaluate(other, rollout.recorded_responder, jobs.RoundOptions(eval_tasks=5, **o), 2, out)

    tagged = lambda seed: jobs.tagged_round(dataset, rollout.recorded_responder, teacher, jobs.RoundOptions(batch_tasks=5, max_turns=1, seed=seed, materialise=False), 1, out)
    tagged(1)
    tagged(1)
    with pytest.raises(RuntimeError, match="other options or input"):
        tagged(2)

    state = rollout.run_rollout(dataset.limit(4).withColumn("uid", F.col("source_idx").cast("string")), rollout.recorded_responder, max_turns=1, materialise=False)
    steps, folder = rollout.steps_of(state), new_folder(spark, "labels")
    assert relabel(steps, teacher, folder=folder).count() == relabel(steps, teacher, folder=folder).count()
    with pytest.raises(RuntimeError, match="other options or input"):
        relabel(steps.filter("role = 'generator'"), teacher, folder=folder)


def test_other_tasks_in_a_rollout_folder_raise(spark, setting):
    dataset, _ = setting
    tasks = dataset.withColumn("uid", F.col("source_idx").cast("string"))
    folder = new_folder(spark, "rollout")
    run_ = lambda t: rollout.run_rollout(t, rollout.recorded_responder, max_turns=1, folder=folder)
    n = run_(tasks.filter("source_idx < 9")).count()
    assert run_(tasks.filter("source_idx < 9")).count() == n
    with pytest.raises(RuntimeError, match="other options or input"):
        run_(tasks.filter("source_idx < 5"))
