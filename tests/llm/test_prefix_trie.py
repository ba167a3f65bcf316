"""Conversation prefix trie against a trie of nested dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from colloquy.llm import prefix_trie as pt


def by_loops(rows):
    """Rows (conv, turn, role, text) to the nodes, as the contract words them."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * words
            leaves[node[:d]] += node not in children
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, c int").repartition(3)
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = pt.op12(spark, str(tmp_path))
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=str)


def conversations(seed, n, longest):
    """Few different turns, so that prefixes are shared; some conversations are copies, some are short."""
    draw = random.Random(seed)
    rows, made = [], []
    for c in draw.sample(range(-60, 400), n):
        turns = [(draw.choice(["user", "assistant", None]), draw.choice(["a b", "a  b c", "", None, f"own {c}"])) for _ in range(draw.randrange(1, longest))]
        if made and draw.random() < 0.3:
            turns = draw.choice(made)
        made.append(turns)
        rows += [(c, 7 * i if i else None, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("block", [pt.BLOCK, 3])
def test_tries(spark, tmp_path, monkeypatch, block):
    """Also with blocks shorter than the conversations, and with all parents met in a shuffle or broadcast."""
    monkeypatch.setattr(pt, "BLOCK", block)
    rows = conversations(block, 120, 12)
    assert run(spark, tmp_path, rows) == by_loops(rows)


def test_collisions_of_the_sketch_lose_no_node(spark, tmp_path, monkeypatch):
    """With few counters, prefixes that occur once look shared although what they continue was proven single."""
    monkeypatch.setattr(pt, "SLICE", 256)
    monkeypatch.setattr(pt, "MOST_COUNTERS", 256)
    rows = [(c, t, "user", f"turn {t} of {c}") for c in range(30) for t in range(8)]
    assert run(spark, tmp_path, rows) == by_loops(rows)


def test_edges(spark, tmp_path):
    hot = [(400 + 20 * i, t, "user", x) for i in range(30) for t, x in enumerate(["same", "same again"])]  # one group of copies
    rows = [
        (1, None, None, None), (1, 3, "user", "late"), (1, 3, "user", "late"), (1, 3, "assistant", "late"),  # ties and repeats
        (None, 1, "user", "no conversation"), (2, 1, "user", "x " * 20_000), (3, 0, "", ""), (5, 0, "a", "b"), (25, 0, "a", "b"),
        *hot, (7, 0, "us", "er"), (8, 0, "u", "ser"),
    ]
    assert run(spark, tmp_path, rows) == by_loops(rows)
    assert run(spark, tmp_path, []) == []
    assert run(spark, tmp_path, [(None, 1, "user", "x")]) == []


def test_turnless_conversations_belong_to_the_root(spark, tmp_path):
    lonely = next(c for c in range(20, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lonely, 0, "user", "one"), (lonely, 1, "user", "two")]  # its base is absent
    assert run(spark, tmp_path, rows) == by_loops(rows) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]


def test_one_very_long_conversation_and_its_copy(spark, tmp_path):
    rows = [(c, t, "user", f"turn {t} of many") for c in (20, 40) for t in range(9000)]
    got = run(spark, tmp_path, rows)
    assert len(got) == 9001
    top = next(r for r in got if r[1] == 0)
    assert top[:6] == (20, 0, None, 2, 1, 1) and top[6] == 9000 * 4


def test_sketch_never_misses_a_shared_digest(spark):
    rows = [(i % 700, i % 700 * 31) for i in range(1000)]
    df = spark.createDataFrame(rows, "d1 long, d2 long").repartition(5)
    sketch = pt.sketched(df)
    import numpy as np

    d1 = np.arange(700, dtype=np.uint64)
    maybe = sketch.maybe_shared(d1, d1 * np.uint64(31))
    assert maybe[:300].all() and maybe[300:].mean() < 0.05
    assert sketch.counters == pt.SLICE and pt.sketched(df.limit(0)).bits.sum() == 0


def test_lists_of_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 50)
    ids = random.Random(1).sample(range(-(10**6), 10**6), 500)
    df = spark.createDataFrame([(1, 2, 3 if i % 2 else 4, c) for i, c in enumerate(ids)], "depth long, d1 long, d2 long, c long").repartition(7)
    got = {r["d2"]: r["ends_sha256"] for r in pt.ends_digests(df).collect()}
    for d2, own in ((3, ids[1::2]), (4, ids[::2])):
        assert got[d2] == hashlib.sha256(",".join(map(str, sorted(own))).encode()).hexdigest()
