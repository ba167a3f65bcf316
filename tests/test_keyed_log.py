"""The keyed log: appends write their own rows only, filters spare reading keys, buckets are compacted by themselves."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from colloquy.session import new_folder
from colloquy.sources import keyed_log, store
from colloquy.sources.keyed_log import KeyedLog


def rows(spark, items):
    df = spark.createDataFrame([(k, s, f"v{s}") for k, s in items], "key string, seq long, value string")
    return df.withColumn("h", F.sha1("key"))


def table(df):
    return {r["key"]: (r["seq"], r["value"]) for r in df.collect()}


def files(home):
    return {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(home) for n in names if n.endswith(".parquet")}


@pytest.mark.parametrize("position", ["last", "first"])
@pytest.mark.parametrize("file_format", ["parquet", "json"])
def test_many_appends_equal_one_dictionary(spark, position, file_format):
    draw, held, first = random.Random(1), {}, {}
    log = KeyedLog(spark, new_folder(spark, "log"), "h", file_format, position)
    seq = 0
    for step in range(5):
        items = []
        for _ in range(30):
            key, seq = f"k{draw.randrange(40)}", seq + 1
            items.append((key, seq))
            held[key] = f"v{seq}"
            first.setdefault(key, seq)
        log.append(rows(spark, items), "seq")
        if step % 2:
            log.compact()
        got = table(log.read())
        assert {k: v for k, (_, v) in got.items()} == held
        if position == "first":
            assert {k: s for k, (s, _) in got.items()} == first
    assert log.read().columns == ["key", "seq", "value", "h"]


def test_an_append_writes_its_own_rows_only(spark):
    log = KeyedLog(spark, new_folder(spark, "log"), "h")
    log.append(rows(spark, [(f"k{i}", i) for i in range(20_000)]), "seq")
    before = files(log.home)
    log.append(rows(spark, [(f"k{i}", 10**6 + i) for i in range(5)]), "seq")
    assert log.compact() == []
    after = files(log.home)
    assert {f: after.get(f) for f in before} == before
    assert sum(after.values()) - sum(before.values()) < 0.1 * sum(before.values())
    got = table(log.read())
    assert len(got) == 20_000 and got["k3"][0] == 10**6 + 3 and got["k9"][0] == 9


def test_only_buckets_that_grew_are_compacted(spark):
    log = KeyedLog(spark, new_folder(spark, "log"), "h")
    log.append(rows(spark, [(f"k{i}", i) for i in range(400)]), "seq")
    hot = [f"k{i}" for i in range(400) if hashlib.sha1(f"k{i}".encode()).hexdigest()[0] == "7"]
    for step in range(1, 4):
        log.append(rows(spark, [(k, 1000 * step) for k in hot]), "seq")
    assert log.due() == ["7"]
    want, old = table(log.read()), log.current()
    assert log.compact() == ["7"] and log.due() == []
    assert table(log.read()) == want
    entries = log.current().tables["rows"]
    assert [sorted(e.buckets) for e in entries if "7" in e.buckets] == [["7"]]
    assert entries[0].path not in old.paths()


def test_failed_commit_changes_nothing(spark, monkeypatch):
    log = KeyedLog(spark, new_folder(spark, "log"), "h")
    log.append(rows(spark, [("a", 1)]), "seq")
    with monkeypatch.context() as m:
        m.setattr(KeyedLog, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            log.append(rows(spark, [("a", 2), ("b", 2)]), "seq")
    assert table(log.read()) == {"a": (1, "v1")}
    assert table(KeyedLog(spark, log.home, "h").read()) == {"a": (1, "v1")}


def test_of_two_writers_one_fails(spark, monkeypatch):
    log = KeyedLog(spark, new_folder(spark, "log"), "h")
    log.append(rows(spark, [("a", 1)]), "seq")
    stale = log.current()
    log.append(rows(spark, [("b", 2)]), "seq")
    other = KeyedLog(spark, log.home, "h")
    monkeypatch.setattr(KeyedLog, "current", lambda self: stale)
    with pytest.raises(RuntimeError, match="has been written to"):
        other.append(rows(spark, [("c", 3)]), "seq")


def test_readers_of_the_manifest_before_keep_their_files(spark):
    log = KeyedLog(spark, new_folder(spark, "log"), "h")
    for i in range(4):
        log.append(rows(spark, [("a", i), (f"b{i}", i)]), "seq")
    open_reader = log.read()
    log.compact(buckets=list(keyed_log.BUCKETS))
    assert len(table(open_reader)) == 5 and len(table(log.read())) == 5
    log.append(rows(spark, [("c", 9)]), "seq")
    log.append(rows(spark, [("d", 9)]), "seq")
    assert len(os.listdir(f"{log.home}/parts")) == 3 and len(table(log.read())) == 7  # the merged parts are gone


def stored_key_reads(spark, keys, log, monkeypatch):
    """(known keys, how many buckets of parts had their keys read)."""
    read = []
    original = KeyedLog.keys
    monkeypatch.setattr(KeyedLog, "keys", lambda self, places: read.extend(places) or original(self, places))
    found = log.known(keys)
    return (sorted(r["h"] for r in found.collect()) if found is not None else []), len(read)


@pytest.mark.parametrize("bits", [12, 1])
def test_membership(spark, monkeypatch, bits):
    """With one bit a key filters err often; the result is the same."""
    monkeypatch.setattr(keyed_log, "KEY_BITS", bits)
    log = KeyedLog(spark, new_folder(spark, "log"), "h")
    log.append(rows(spark, [(f"a{i}", i) for i in range(3000)]), "seq", label="one")
    log.append(rows(spark, [(f"b{i}", i) for i in range(2000)]), "seq", label="two")
    keys = rows(spark, [(f"{p}{i}", 0) for p in "abc" for i in range(50)]).select("h")
    got, read = stored_key_reads(spark, keys, log, monkeypatch)
    want = sorted(r["h"] for r in rows(spark, [(f"{p}{i}", 0) for p in "ab" for i in range(50)]).collect())
    assert got == want and read > 0
    assert sorted(r["h"] for r in log.known(keys, but="two").collect()) == sorted(r["h"] for r in rows(spark, [(f"a{i}", 0) for i in range(50)]).collect())


def test_new_keys_read_no_stored_key(spark, monkeypatch):
    log = KeyedLog(spark, new_folder(spark, "log"), "h")
    log.append(rows(spark, [(f"a{i}", i) for i in range(3000)]), "seq")
    assert stored_key_reads(spark, rows(spark, [("x", 0)]).select("h"), log, monkeypatch) == ([], 0)
    # a few of many new keys are let through by mistake: most buckets stay unread
    got, read = stored_key_reads(spark, rows(spark, [(f"n{i}", 0) for i in range(20)]).select("h"), log, monkeypatch)
    assert got == [] and read < 8


def test_filters_have_a_bounded_error(spark):
    log = KeyedLog(spark, new_folder(spark, "log"), "h")
    log.append(rows(spark, [(f"a{i}", i) for i in range(20_000)]), "seq")
    entry = log.current().tables["rows"][0]
    bits = spark.read.parquet(f"{log.home}/{entry.path}/_filter").withColumnRenamed("bits", "there")
    asked = rows(spark, [(f"n{i}", 0) for i in range(20_000)]).select("h", F.left("h", F.lit(1)).alias("bucket_"), *keyed_log._word(F.col("h"), entry.words))
    wrong = asked.join(bits, ["bucket_", "word"]).filter(F.col("there").bitwiseAND(F.col("bits")) == F.col("bits")).count()
    assert wrong < 0.05 * 20_000
    assert 8 * bits.count() < 20_000 * 40 / 8  # an eighth of the keys' own bytes


def test_tables_are_published_together(spark, monkeypatch):
    both = spark.createDataFrame([("m1", "generator", 1), ("m1", "verifier", 2), ("m2", "verifier", 3), ("m3", "other", 4), ("m1", "generator", 5)], "messages string, role string, seq int")
    prefix = new_folder(spark, "collect")
    store.write_by_role(both, prefix, "seq")
    got = {t: sorted((r["messages"], r["seq"]) for r in store.read_by_role(spark, prefix, t).collect()) for t in ("gen", "ver")}
    assert got == {"gen": [("m1", 5)], "ver": [("m1", 2), ("m2", 3)]}
    log = store.log_of(spark, prefix)
    assert len({e.path for own in log.current().tables.values() for e in own}) == 1  # one write
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="died"):
        m.setattr(KeyedLog, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        store.write_by_role(both.withColumn("seq", F.col("seq") + 10), prefix, "seq")
    assert {t: store.read_by_role(spark, prefix, t).agg(F.max("seq")).first()[0] for t in ("gen", "ver")} == {"gen": 5, "ver": 3}
    assert log.compact("ver", list(keyed_log.BUCKETS)) and store.read_by_role(spark, prefix, "ver").count() == 2
