"""JSON lists read by blocks, against the json module on the whole file."""

import json
import random

import pytest

from colloquy.operators.ordinals import read_indexed
from colloquy.session import new_folder
from colloquy.sources import datasets, json_list, store


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that strings, escapes and objects lie across them."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}

    def size(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")

    yield size
    for n, v in old.items():
        spark.conf.set(n, v)


def read(spark, path):
    rows = json_list.elements(spark, str(path)).collect()
    return [r["value"] for r in sorted(rows, key=lambda r: (r["file"], r["block"], r["seq"]))]


def value(draw, depth=0):
    kind = draw.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(draw.choice('a,"\\]}{[ é😀\n:') for _ in range(draw.randrange(12)))
    if kind < 4:
        return draw.choice([0, -1.5, True, None, "", "\\", '"', "\\\\,\\", 12345678901])
    if kind == 4:
        return [value(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {f"k{i}{draw.choice(',]')}": value(draw, depth + 1) for i in range(draw.randrange(4))}


@pytest.mark.parametrize("size", [7, 90, 1 << 20])
def test_any_values_across_blocks(spark, tmp_path, small_blocks, size):
    small_blocks(size)
    draw = random.Random(size)
    wanted = [value(draw) for _ in range(60 if size > 10 else 5)]
    for name, indent in (("a.json", None), ("b.json", 3)):
        (tmp_path / name).write_text("﻿ \n" * (name == "b.json") + json.dumps(wanted, indent=indent, ensure_ascii=name == "a.json") + "\n \n", encoding="utf-8")
        assert [json.loads(v) for v in read(spark, tmp_path / name)] == wanted
        assert store.count_rows(spark, str(tmp_path / name)) == len(wanted)


@pytest.mark.parametrize("size", [3, 1 << 20])
@pytest.mark.parametrize("text, wanted", [("[]", []), (" [ \n ] ", []), ("[[]]", [[]]), ('["]"]', ["]"]), ("[1]", [1]), ('[",", {"a,": ","}]', [",", {"a,": ","}])])
def test_small_lists(spark, tmp_path, small_blocks, size, text, wanted):
    small_blocks(size)
    (tmp_path / "x.json").write_text(text)
    assert [json.loads(v) for v in read(spark, tmp_path / "x.json")] == wanted


@pytest.mark.parametrize("size", [4, 1 << 20])
@pytest.mark.parametrize("text", ["[1, 2", '["a, 1]', "[1,]", "[,1]", "[1,,2]", "[1], [2]", "[1] x", "[{]}", "[1]]", "x [1]", "[a, b]"])
def test_what_is_not_a_list_raises(spark, tmp_path, small_blocks, size, text):
    small_blocks(size)
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="list|JSON"):
        json_list.count_elements(spark, str(tmp_path / "x.json"))


def test_scan_tells_lists_from_lines(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"a": 1, "b": "x,y"},\n {"a": 2, "c": [1, 2]}]')
    (tmp_path / "lines.json").write_text('{"a": 1, "b": "x,y"}\n{"a": 2, "c": [1, 2]}\n')
    (tmp_path / "one.json").write_text('{"a": 1,\n "b": "x"}')
    (tmp_path / "numbers.json").write_text("[1, 2]")
    rows = [(1, "x,y", None), (2, None, [1, 2])]
    for name in ("list.json", "lines.json"):
        got = datasets.scan(spark, str(tmp_path / name)).orderBy("a")
        assert got.columns == ["a", "b", "c"] and [tuple(r) for r in got.collect()] == rows
    got = datasets.scan(spark, str(tmp_path / "list.json"), "a bigint").orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1,), (2,)]
    assert [tuple(r) for r in datasets.scan_json_list(spark, str(tmp_path / "one.json")).collect()] == [(1, "x")]
    assert datasets.scan_json_list(spark, str(tmp_path / "list.json")).count() == 2
    with pytest.raises(ValueError, match="not JSON objects"):
        datasets.scan(spark, str(tmp_path / "numbers.json"))


def test_large_documents_that_are_no_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LARGEST_JSON_VALUE", 10)
    (tmp_path / "one.json").write_text(json.dumps({"a": list(range(50))}))
    (tmp_path / "broken.json").write_text(json.dumps({"a": list(range(50))})[:-1])
    assert store.count_rows(spark, str(tmp_path / "one.json")) == 1
    with pytest.raises(ValueError, match="left open"):
        store.count_rows(spark, str(tmp_path / "broken.json"))


def test_written_lists_read_back(spark):
    path = f"{new_folder(spark, 'lists')}.json"
    rows = spark.range(100).selectExpr("id", "concat('a,\"', id) AS s", "CASE WHEN id % 2 = 0 THEN id END AS n").repartition(7)
    json_list.dump_lists(rows, path)
    assert sorted(map(tuple, datasets.scan(spark, path).select("id", "s", "n").collect())) == sorted(map(tuple, rows.collect()))
    json_list.dump_lists(rows.limit(0), path)
    assert store.count_rows(spark, path) == 0


@pytest.mark.parametrize("suffix", ["", ".jsonl", ".json"])
@pytest.mark.parametrize("size", [4000, 1 << 27])
def test_index_follows_files(spark, tmp_path, small_blocks, suffix, size):
    """Three files, the second by far the largest: row 0 is the first row of the first file."""
    wanted, folder = [], tmp_path / f"raw{suffix}"
    folder.mkdir()
    for f, n in (("f1", 5), ("f2", 1000), ("f3", 50)):
        rows = [{"problem": f"{f}-{i}", "answer": str(i)} for i in range(n)]
        wanted += [r["problem"] for r in rows]
        if suffix == "":
            spark.createDataFrame([tuple(r.values()) for r in rows], "problem string, answer string").coalesce(1).write.parquet(f"{folder}/{f}.parquet")
        else:
            (folder / f"{f}{suffix}").write_text(json.dumps(rows) if suffix == ".json" else "\n".join(map(json.dumps, rows)))
    small_blocks(size)
    root = new_folder(spark, "registry")
    path = str(folder) if suffix else f"{folder}/*"
    got = datasets.register(spark, root, "uneven", "train", path, schema="problem string, answer string")
    assert [r["problem"] for r in got.orderBy("source_idx").collect()] == wanted
    assert sorted(r["source_idx"] for r in got.collect()) == list(range(1055))
    version = datasets.lookup(spark, root, "uneven", "train")[0]
    assert version.columns == got.columns and read_indexed  # nothing of the scan's own columns is kept
    assert not [c for c in got.columns if c.startswith("__")]


def test_register_any_question_shape(spark, tmp_path):
    chat = [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "hi"}]
    rows = {
        "chat": [{"question": chat}],
        "parts": [{"messages": [{"role": "user", "content": [{"from": "human", "text": "nested"}]}, {"role": "assistant", "content": [{"text": "\\boxed{7}"}]}]}],
        "object": [{"question": {"prompt": "asked", "input": "x"}}],
        "problem": [{"problem": "p", "messages": chat}],
        "truth": [{"problem": "p", "answer": {"v": [1]}}],
    }
    got = {}
    for name, data in rows.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
        found = datasets.register(spark, new_folder(spark, "registry"), name, "train", str(tmp_path / f"{name}.json"))
        got[name] = tuple(found.select("question", "ground_truth").first())
    assert got["chat"] == ("hello", None) and got["object"] == ("asked", None) and got["truth"] == ("p", '{"v":[1]}')
    assert got["parts"][0] == "nested" and got["problem"] == ("p", "hi")
