"""Queries on tables where one conversation and one text hold most rows."""

import duckdb
import pytest
from compare import check, connect
from conftest import DATA

from colloquy.operators import ordinals
from colloquy.plans.catalog import ORACLE, QUERIES

HOT = [
    "verdict", "boxed_last", "message_hash_rows", "question_text_rows", "scan_json_list", "register_in_file_order",
    "last_user_message", "gen_accuracy", "gen_accuracy_detail", "early_stop", "last_step", "episode_correct_any",
    "join_responses", "relabel_join", "distinct_messages", "sft_append_parquet", "sft_append_jsonl", "sft_new_only",
    "request_batches", "param_batches", "sample_random", "sample_sequential", "round_batches", "replay_pag",
    "clean_context_rows", "drop_trailing_assistant_rows", "trim_history_rows", "truncate_tail_rows",
    "fit_token_budget_rows", "coerce_question_rows", "replay_dagger", "sft_build_pag", "sft_funnel_rows", "transcripts", "stream_sft_ingest",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skew"))
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf0.001/{t}.parquet')")
    con.execute(f"""COPY (SELECT * FROM conversations WHERE conv_id <> 7 UNION ALL
      SELECT 7, i, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END,
             CASE WHEN i % 5 = 0 THEN 'same line' ELSE 'turn ' || i END FROM (SELECT unnest(range(0, 900)) AS i) r)
      TO '{folder}/conversations.parquet'""")
    con.execute(f"""COPY (SELECT * FROM documents UNION ALL
      SELECT doc_id + 200, 'the very same text', 'en', 'src0', n_chars FROM documents)
      TO '{folder}/documents.parquet'""")
    return folder


@pytest.mark.parametrize("name", HOT)
def test_hot_key(spark, skewed, monkeypatch, name):
    monkeypatch.setattr(ordinals, "BLOCK_WIDTH", 32)  # the hot conversation spans many blocks
    con = connect(skewed, ["conversations", "documents"])
    check(QUERIES[name](spark, skewed), con, ORACLE[name])
