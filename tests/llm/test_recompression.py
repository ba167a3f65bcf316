import hashlib
import random

import numpy as np
from conftest import DATA
from edge_tables import edges, nothing  # noqa: F401

from colloquy.llm import recompression as rc
from colloquy.llm.hashing import _BASES, mixed


def by_hand(rows, size=20):
    """Walks all windows in order of ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        gone = bytearray(len(words))
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(window)
        out[doc] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g))
    return out


def test_documents(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = by_hand(rows)
    got = rc.op2(spark, f"{DATA}/sf0.01").collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept).hexdigest())
    assert sum(w[1] for w in want.values()) > 1000


def test_small_alphabets(spark):
    """Runs, periods and overlaps, where symbols of all rounds matter."""
    random.seed(11)
    pool = [" ".join(random.choice("abc") for _ in range(random.randrange(18, 60))) for _ in range(6)]
    pool += ["a " * 70, "a b " * 40, "a b c a " * 20, "z " * 19, "q " * 20]
    rows = []
    for i in range(60):
        parts = [random.choice(pool) if random.random() < 0.5 else " ".join(random.choice("abcdefgh") for _ in range(15)) for _ in range(4)]
        rows.append((i, " ".join(parts)))
    want = by_hand(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for r in rc.deduplicated(df).collect():
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["text"]) == (n, gone, kept.decode())


def test_edges(edges, nothing):
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in rc.deduplicated(edges).collect()]
    by_id = {k: sorted(x[1:] for x in got if x[0] == k) for k in {x[0] for x in got}}
    assert len(got) == 12
    assert by_id[1] == [(24, 0), (24, 0)] and by_id[2] == [(24, 24)]
    assert by_id[3] == by_id[4] == by_id[5] == [(0, 0)] and by_id[6] == [(1, 0)] and by_id[None] == [(0, 0), (4, 0)]
    assert by_id[8] == [(500, 499)]
    long = [x for x in got if x[0] == 7]
    assert long[0][1] == 30_001 and long[0][2] == 0
    assert rc.deduplicated(nothing).count() == 0


def test_least_rank_over_places():
    draw = np.random.default_rng(4)
    for n, most in ((1, 1), (7, 3), (500, 20), (500, 33)):
        hi = draw.integers(0, n, 2 * n)
        lo = np.maximum(hi - draw.integers(0, most, 2 * n), 0)
        rank = draw.integers(0, 1 << 60, 2 * n).astype(np.uint64)
        want = [min((int(r) for r, a, b in zip(rank, lo, hi) if a <= i <= b), default=(1 << 64) - 1) for i in range(n)]
        assert rc._least(rank, lo, hi, n, most).tolist() == want


def test_words_are_hashed_in_the_lanes_that_are_used():
    rows = [{"text": "a bc é " + "long" * 200}, {"text": None}, {"text": "bc " * 30}]
    for lanes in (1, 2):
        words = rc._cut(rows, 20, 2, lanes)[0]
        assert len(words.hash) == lanes
        for lane in range(lanes):
            value = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * lane)).tolist()
            for a, b, got in zip(words.start, words.end, words.hash[lane]):
                total = 0
                for byte in words.data[a:b].tolist():
                    total = (total * _BASES[lane] + value[byte]) % (1 << 64)
                assert mixed(np.array([total], np.uint64))[0] == got
