import json
import os

import pytest
from pyspark.sql import functions as F

from colloquy.operators import joins
from colloquy.session import Files, new_folder, work_root
from colloquy.sources import datasets, store

c = F.col


def rows(spark, *items):
    return spark.createDataFrame([([("user", m)], s) for m, s in items], "messages array<struct<role:string,content:string>>, seq int")


def content(df):
    return sorted((r["messages"][0]["content"], r["seq"]) for r in df.collect())


def test_append_keeps_the_last_row(spark):
    home = new_folder(spark, "append")
    store.append_distinct(rows(spark, ("a", 1), ("b", 2), ("a", 3)), home, "seq")
    assert content(store.read_store(spark, home)) == [("a", 3), ("b", 2)]
    store.append_distinct(rows(spark, ("b", 5), ("c", 6)), home, "seq")
    assert content(store.read_store(spark, home)) == [("a", 3), ("b", 5), ("c", 6)]
    # appending the same rows again changes nothing
    store.append_distinct(rows(spark, ("b", 5), ("c", 6)), home, "seq")
    assert content(store.read_store(spark, home)) == [("a", 3), ("b", 5), ("c", 6)]


def test_append_json_keeps_first_place_and_last_value(spark):
    home = new_folder(spark, "append")
    one = lambda s, v: spark.createDataFrame([("m", s, v)], "messages string, seq int, v string")
    store.append_distinct(one(1, "old"), home, "seq", file_format="json", position="first")
    store.append_distinct(one(7, "new"), home, "seq", file_format="json", position="first")
    got = store.read_store(spark, home, "json", "messages string, seq int, v string").collect()
    assert [tuple(r) for r in got] == [("m", 1, "new")]


def test_no_rows_write_nothing(spark):
    home = new_folder(spark, "append")
    assert store.append_distinct(rows(spark, ("a", 1)).limit(0), home, "seq") is None
    store.write_shard(rows(spark, ("a", 1)).limit(0), home, "gen", 1)
    assert store.write_latest(rows(spark, ("a", 1)).limit(0), home, "gen", 1) is None
    assert not Files(spark, home).exists(home)


def test_rows_without_messages_are_rejected_with_a_count(spark):
    home = new_folder(spark, "append")
    data = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "messages string, seq int")
    with pytest.warns(UserWarning, match="2 rows without messages"):
        store.append_distinct(data, home, "seq")
    assert store.read_store(spark, home).count() == 1


def test_table_without_messages_is_not_deduplicated(spark):
    home = new_folder(spark, "append")
    data = spark.createDataFrame([(1, "x"), (2, "x")], "seq int, note string")
    for _ in range(2):
        store.append_distinct(data, home, "seq")
    assert store.read_store(spark, home).count() == 4


def test_columns_are_aligned_by_name(spark):
    home = new_folder(spark, "append")
    store.append_distinct(spark.createDataFrame([("a", 1)], "messages string, seq int"), home, "seq")
    store.append_distinct(spark.createDataFrame([(2, "n", "b")], "seq int, note string, messages string"), home, "seq")
    got = store.read_store(spark, home).orderBy("seq").select("messages", "note").collect()
    assert [tuple(r) for r in got] == [("a", None), ("b", "n")]


def test_unfinished_part_is_ignored_and_unreadable_one_raises(spark):
    home = new_folder(spark, "append")
    store.append_distinct(rows(spark, ("a", 1)), home, "seq")
    # one job died before its manifest, another while writing it
    rows(spark, ("zzz", 9)).write.parquet(f"{home}/parts/died/bucket_=a")
    with open(f"{home}/log/00000001.json", "w") as f:
        f.write('{"order": "seq", "tables": {"rows": [')
    assert content(store.read_store(spark, home)) == [("a", 1)]
    store.append_distinct(rows(spark, ("b", 2)), home, "seq")
    assert content(store.read_store(spark, home)) == [("a", 1), ("b", 2)]

    log = store.log_of(spark, home)
    entry = log.current().tables["rows"][0]
    part = f"{home}/{entry.path}/bucket_={next(iter(entry.buckets))}"
    for name in os.listdir(part):
        with open(f"{part}/{name}", "w") as f:
            f.write("not parquet at all")
    with pytest.raises(Exception):
        store.read_store(spark, home).collect()


def test_append_new_only_can_be_repeated(spark):
    home = new_folder(spark, "parts")
    store.append_new_only(rows(spark, ("a", 1), ("b", 2), ("a", 3)), home, "seq", "batch=0")
    for _ in range(2):
        store.append_new_only(rows(spark, ("b", 4), ("c", 5), ("c", 6)), home, "seq", "batch=1")
    log = store.log_of(spark, home)
    assert content(log.read(label="batch=0")) == [("a", 3), ("b", 2)]
    assert content(log.read(label="batch=1")) == [("c", 6)]
    assert content(log.read(merge=False)) == [("a", 3), ("b", 2), ("c", 6)]
    assert store.append_new_only(rows(spark, ("a", 9)), home, "seq", "batch=2") is None


def test_shards_and_latest(spark):
    home = new_folder(spark, "shards")
    long = spark.createDataFrame([([("user", "a b c"), ("assistant", "d e")],)], "messages array<struct<role:string,content:string>>")
    for r in (1, 2, 2):  # a repeated round replaces its shard
        store.write_shard(long, home, "gen", r, max_tokens=3)
    got = spark.read.parquet(home).collect()
    assert sorted(r["round"] for r in got) == [1, 2]
    assert {tuple(map(tuple, r["messages"])) for r in got} == {(("assistant", "d e"),)}

    latest = new_folder(spark, "latest")
    for r in (1, 2):
        store.write_latest(long, latest, "gen", r)
    assert [r["round"] for r in store.read_store(spark, latest).collect()] == [2]
    assert len(Files(spark, latest).children(latest)) == 1


def test_counts(spark, tmp_path):
    base = str(tmp_path)
    data = rows(spark, ("a", 1), ("b", 2), ("c", 3))
    data.write.parquet(f"{base}/deep/x/one.parquet")
    data.write.parquet(f"{base}/deep/two.parquet")
    (tmp_path / "lines.jsonl").write_text('{"a":1}\n\n  \n{broken\n')
    (tmp_path / "list.json").write_text("[1,\n {}, []]")
    (tmp_path / "one.json").write_text('{"a": 1}')
    (tmp_path / "none.json").write_text("{}")
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "bad.parquet").write_text("nope")
    (tmp_path / "notes.txt").write_text("a\n\nb\n")
    count = lambda name: store.count_rows(spark, f"{base}/{name}")
    assert count("deep") == 6
    assert count("deep/two.parquet") == 3
    assert count("lines.jsonl") == 2
    assert (count("list.json"), count("one.json"), count("none.json")) == (3, 1, 0)
    with pytest.raises(ValueError, match="not JSON"):
        count("bad.json")
    assert count("notes.txt") == 2
    assert count("missing.parquet") == 0
    with pytest.raises(Exception, match="bad.parquet"):
        count("bad.parquet")
    assert store.count_messages(spark, f"{base}/deep/two.parquet", f"{base}/deep/x/one.parquet") == 6


def test_tolerant_lines(spark, tmp_path):
    path = str(tmp_path / "rows.jsonl")
    with open(path, "w") as f:
        f.write('{"a":1,"messages":[{"role":"user"}]}\n\n{"a":2\n{"a":3}\n{"a":4} tail\nnonsense\n{"a":5}}\n{"a":6}] [\n')
    got = datasets.scan_jsonl_tolerant(spark, path, "a int, messages string").collect()
    assert [tuple(r) for r in got] == [(1, '[{"role":"user"}]'), (3, None)]
    assert datasets.count_malformed(spark, path) == 5


def test_jsonl_for_training(spark, tmp_path):
    path = str(tmp_path / "sft.jsonl")
    shapes = ["plain", None, [{"role": "user", "content": "a b c"}, {"role": "assistant", "content": "d"}], {"content": 1}]
    with open(path, "w") as f:
        for i, m in enumerate(shapes):
            f.write(json.dumps({"id": i, "messages": m}) + "\n")
    out = datasets.jsonl_for_training(spark, path, str(tmp_path / "out"), max_tokens=3)
    got = [[tuple(m) for m in r["messages"]] for r in spark.read.parquet(out).orderBy("id").collect()]
    assert got == [[("user", "plain")], [(None, None)], [("assistant", "d")], [(None, "1")]]
    bare = str(tmp_path / "bare.jsonl")
    with open(bare, "w") as f:
        f.write('{"id": 1}\n')
    out = datasets.jsonl_for_training(spark, bare, str(tmp_path / "bare-out"))
    assert [[tuple(m) for m in r["messages"]] for r in spark.read.parquet(out).collect()] == [[(None, None)]]
    assert datasets.jsonl_for_training(spark, "x.parquet", "unused") == "x.parquet"


def test_registry(spark):
    root = new_folder(spark, "registry")
    with pytest.raises(RuntimeError):
        datasets.register(spark, root, "d", "train")
    raw = f"{root}/raw.jsonl"
    spark.createDataFrame([("p1", "1"), (" ", "2")], "problem string, answer string").write.json(raw)
    first = datasets.register(spark, root, "d", "train[:2]", raw)
    shown = first.orderBy("ground_truth").select("question", "ground_truth", "data_source", "has_question")
    assert [tuple(r) for r in shown.collect()] == [("p1", "1", "d", True), (None, "2", "d", False)]
    assert sorted(r["source_idx"] for r in first.collect()) == [0, 1]
    found, key = datasets.lookup(spark, root, "d", "train[:2]")
    assert key == "train-2" and found.count() == 2
    assert datasets.lookup(spark, root, "d", "test") == (None, "test")
    other = f"{root}/other.jsonl"
    spark.createDataFrame([("p3", "3")], "problem string, answer string").write.json(other)
    assert datasets.register(spark, root, "d", "train[:2]", other).count() == 2
    assert datasets.register(spark, root, "d", "train[:2]", other, force=True).count() == 1


def test_transcripts_and_sinks(spark):
    steps = spark.createDataFrame(
        [("u", "generator", 1, "b"), ("u", "generator", 0, "a"), ("u", "verifier", 0, "v")],
        "uid string, role string, turn_index bigint, student_response string",
    ).withColumns({n: F.lit(None).cast("string") for n in (
        "student_response_raw", "generator_message", "generator_message_raw", "teacher_target", "chat_completions")})
    tasks = spark.createDataFrame([("u", "é?", None)], "uid string, question string, ground_truth string")
    path = new_folder(spark, "transcripts")
    store.dump_json(store.transcripts(steps, tasks), path)
    line = json.loads(spark.read.text(path).first()["value"])
    assert line["task"] == {"uid": "u", "question": "é?", "ground_truth": None}
    assert [[s["student_response"] for s in t["steps"]] for t in line["trajectories"]] == [["a", "b"], ["v"]]
    mirror = new_folder(spark, "mirror")
    for _ in range(2):
        store.append_json(tasks, mirror)
    assert spark.read.schema(tasks.schema).json(mirror).count() == 2


def test_lost_answers_become_empty(spark):
    asked = spark.createDataFrame([("u", "generator", 0), ("w", "generator", 0)], "uid string, role string, turn_index bigint")
    answers = spark.createDataFrame([("u", "generator", 0, " x ")], "uid string, role string, turn_index bigint, text string")
    got = {r["uid"]: r["text"] for r in joins.join_responses(asked, answers).collect()}
    assert got == {"u": "x", "w": ""}


def test_work_folder_is_the_configured_one(spark):
    assert work_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert new_folder(spark, "a") != new_folder(spark, "a")
