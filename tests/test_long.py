"""Conversations longer than any limit: what reads recorded texts reads all of them."""

import duckdb
import pytest
from compare import check, connect
from conftest import DATA

from colloquy.operators import ordinals, rollout
from colloquy.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def long(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW given AS SELECT * FROM read_parquet('{DATA}/sf0.001/conversations.parquet')")
    con.execute(f"""COPY (SELECT * FROM given WHERE conv_id <> 7 UNION ALL
      SELECT 7, i, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END, 'turn ' || i FROM (SELECT unnest(range(0, 900)) AS i) r
      UNION ALL SELECT 100003, i, 'assistant', 'only ' || i FROM (SELECT unnest(range(0, 30)) AS i) r)
      TO '{folder}/conversations.parquet'""")
    return folder


@pytest.mark.parametrize("name", ["relabel_replay_rows", "relabel_counts_rows", "sft_funnel_rows"])
def test_all_recorded_steps(spark, long, monkeypatch, name):
    monkeypatch.setattr(ordinals, "BLOCK_WIDTH", 32)
    check(QUERIES[name](spark, long), connect(long, ["conversations"]), ORACLE[name])


def test_nothing_stops_at_a_turn(spark, long):
    said = spark.read.parquet(f"{long}/conversations.parquet").filter("role = 'assistant'").count()
    assert QUERIES["relabel_replay_rows"](spark, long).count() == 2 * said
    assert sum(r["n"] for r in QUERIES["sft_funnel_rows"](spark, long).collect()) == 2 * said


def test_contexts_are_those_of_a_rollout(spark, long):
    """The tagged and the judged protocol without a stop, turn by turn, against the steps of recorded turns."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    rows = [(u, "q" + u, "1", t, f"<think>x</think>g{u}{t}" if t % 3 else f" <think>g{t}", f"v{u}{t} " if t % 4 else "")
            for u, n in (("a", 1), ("b", 4), ("c", 7), ("d", 9)) for t in range(n)]
    ddl = "uid string, question string, ground_truth string, turn_index long, generator string, verifier string"
    turns = spark.createDataFrame(rows, ddl).repartition(3)
    tasks = turns.select("uid", "question", "ground_truth").distinct()
    said = turns.selectExpr("uid", "turn_index", "inline(array(named_struct('role', 'generator', 'text', generator), named_struct('role', 'verifier', 'text', verifier)))")
    for protocol in (replace(rollout.JUDGED, closes=lambda said: F.lit(False)), rollout.tagged()):
        state = rollout.run_rollout(rollout.attach_recordings(tasks, said, 9), rollout.recorded_responder, protocol, 9)
        want = rollout.steps_of(state, protocol).drop("is_correct").join(turns.select("uid", "turn_index"), ["uid", "turn_index"], "left_semi")
        got = rollout.steps_of_turns(turns, protocol, block=8).drop("is_correct").select(*want.columns)
        key = lambda r: (r["uid"], r["role"], r["turn_index"])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("name", ["message_hash_rows", "jsonl_to_parquet_rows", "question_text_rows", "coerce_ground_truth_deep_rows"])
def test_no_pieces(spark, long, monkeypatch, name):
    monkeypatch.setattr(ordinals, "BLOCK_WIDTH", 32)
    got = QUERIES[name](spark, long)
    check(got, connect(long, ["conversations"]), ORACLE[name])
    if "conv_id" in got.columns:
        assert got.count() == got.select("conv_id").distinct().count()
