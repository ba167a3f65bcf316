"""Document fingerprints: votes by plain loops, search by trying all pairs, neighbours in id order."""

import hashlib
import random

import numpy as np
import pytest
from conftest import DATA
from edge_tables import edges, nothing  # noqa: F401
from pyspark.sql import functions as F

from colloquy.llm import simhash as sh
from colloquy.llm.hashing import mixed


def by_loops(text):
    """The fingerprint as a set of bits, one term and one bit at a time."""
    terms, weights = sh._terms([text])
    votes = [0] * sh.BITS
    for term, weight in zip(terms, weights):
        for lane in range(sh.LANES):
            h = int(mixed(mixed(np.array([int(term) * (2 * sh.LANES + 1) + lane], np.uint64)))[0])
            for bit in range(64):
                votes[64 * lane + bit] += int(weight) if h >> bit & 1 else -int(weight)
    return {i for i, v in enumerate(votes) if v > 0}


@pytest.mark.parametrize("text", ["", " ", "x", "one two", "a b a b a b " * 40, " ".join(f"w{i * i % 700}" for i in range(900)), "日本語 😀 text"])
def test_votes(text):
    mark = sh.fingerprints(["other words here", text, ""])[1]
    assert {64 * lane + b for lane in range(sh.LANES) for b in range(64) if int(mark[lane]) >> b & 1} == by_loops(text)


def test_terms_weigh_by_how_often_they_occur():
    terms, weights = sh._terms([" ".join(["a b"] * 40), "a b"])
    first = weights[(terms >> np.uint64(44)) == 0]
    assert sorted(first) == [6, 6]  # 40 times a-b, 39 times b-a
    assert sorted(weights[(terms >> np.uint64(44)) == 1]) == [1, 4]  # its characters, and its pair


def by_order(rows):
    """(id, text, following text) in id order, null first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    return [(i, t or "", rows[(k + 1) % len(rows)][1] or "") for k, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("range_bytes", [4 << 20, 500])
def test_edges(spark, edges, nothing, range_bytes, monkeypatch):
    monkeypatch.setattr(sh, "RANGE_BYTES", range_bytes)
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    got = sh.compared(edges, "doc_id", "text").collect()
    expected = []
    for i, own, following in by_order(rows):
        change = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        a, b, c = sh.fingerprints([own, change, following])
        expected.append((i, len(own), hashlib.sha256(change.encode()).hexdigest(), *sh.written([a, b]), *(float(sh.likeness(a[None], x[None])[0]) for x in (b, c))))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert sh.compared(nothing, "doc_id", "text").count() == 0
    assert {r["fingerprint"] for r in got if r["doc_id"] in (3, 4)} == {"0" * 64}
    single = sh.compared(edges.filter("doc_id = 6"), "doc_id", "text").collect()
    assert [(r["near_next"], r["near_edited"]) for r in single] == [(1.0, 1.0)]


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(sh, "RANGE_BYTES", 100_000)
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    rows = by_order([tuple(r) for r in docs.collect()])
    got = sorted(sh.op11(spark, f"{DATA}/sf0.01").collect())
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    for r, (_, own, following) in zip(got, rows):
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(sh.edited(own, following).encode()).hexdigest()
    marks = sh.fingerprints([own for _, own, _ in rows])
    assert [r["fingerprint"] for r in got] == sh.written(marks)
    alone = {r["doc_id"]: r["fingerprint"] for r in sh.with_fingerprints(docs, "doc_id", "text").collect()}
    assert alone == {r["doc_id"]: r["fingerprint"] for r in got}
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.99
    assert abs(np.mean([r["near_edited"] for r in got]) - 0.5) < 0.1 and np.mean([r["near_next"] for r in got]) < 0.1


@pytest.mark.parametrize("radius", [0, 3, 8])
def test_search_finds_all_pairs(spark, radius):
    draw = random.Random(radius)
    marks = [draw.getrandbits(sh.BITS) for _ in range(15)]
    for m in list(marks):
        for _ in range(6):
            flips = draw.sample(range(sh.BITS), draw.randrange(0, 2 * radius + 2))
            marks.append(m ^ sum(1 << f for f in flips))
    df = spark.createDataFrame([(i, f"{m:064x}") for i, m in enumerate(marks)], "doc_id long, fingerprint string")
    queries = df.filter(F.col("doc_id") % 2 == 0)
    got = [(int(r["query"], 16), int(r["fingerprint"], 16), r["distance"]) for r in sh.within(queries, df, radius).collect()]
    asked = {m for i, m in enumerate(marks) if i % 2 == 0}
    expected = {(a, b, (a ^ b).bit_count()) for a in asked for b in marks if a != b and (a ^ b).bit_count() <= radius}
    assert len(got) == len(set(got)) and set(got) == expected
    sizes = {int(r["fingerprint"], 16): (r["class_id"], r["n_docs"]) for r in sh.classes(df).collect()}
    assert all(sizes[m] == (marks.index(m), marks.count(m)) for m in marks)
    with pytest.raises(ValueError):
        sh.within(queries, df, 64)
