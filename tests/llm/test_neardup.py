import random

import numpy as np
from conftest import DATA
from edge_tables import edges, nothing  # noqa: F401

from colloquy.llm import neardup as nd
from colloquy.llm.graph import components


def by_hand(rows, n, per_cent=80):
    """All pairs that share a shingle; smallest id of each component."""
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    for d, s in sets.items():
        for other in {o for x in s for o in where[x] if o < d}:
            both = len(s & sets[other])
            if 100 * both >= per_cent * (len(s) + len(sets[other]) - both):
                a, b = sorted((find(d), find(other)))
                root[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def answer(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_documents(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert answer(nd.op8(spark, f"{DATA}/sf0.01")) == by_hand(rows, 2)


def test_chains_and_large_groups(spark):
    """Near copies of one text, chains whose ends are not similar, and texts just below the threshold."""
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(120):
        copy = list(base)
        for k in random.sample(range(200), 6):
            copy[k] = word()
        rows.append((1000 + i, " ".join(copy)))
    chain = [word() for _ in range(150)]
    for i in range(40):
        for k in range(2):
            chain[(i * 7 + k) % 150] = word()
        rows.append((3000 - i, " ".join(chain)))
    for i in range(60):
        rows.append((5000 + i, " ".join(base[:120] + [word() for _ in range(80)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert answer(nd.near_duplicates(df, n=5)) == by_hand(rows, 5)


def test_estimate_follows_similarity():
    draw = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8, 0.95):
        both, n = int(1000 * share), 1000
        own = (n - both) // 2
        x = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        left, right = x[: both + own], np.concatenate([x[:both], x[both + own :]])
        hashes, bounds = np.concatenate([left, right]), np.array([0, len(left), len(left) + len(right)])
        r = nd.registers(hashes, bounds)
        est = nd.estimate(r[:1], r[1:], np.array([len(left)]), np.array([len(right)]))[0]
        assert abs(est - share) < 0.15
        # registers of a union are the maxima of its parts'
        union = nd.registers(x, np.array([0, len(x)]))
        assert (np.maximum(r[0], r[1]) == union[0]).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (20, 21), (5, 5)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 5)}, **{8: 8, 9: 8, 10: 8, 20: 20, 21: 20}, **{100 + i: 100 for i in range(50)}}


def test_edges(edges, nothing):
    got = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in nd.near_duplicates(edges, n=2).collect())
    assert len(got) == 12
    assert [g for g in got if g[0] in "1"] == [("1", 22, "1", True)] * 2 or [g[2:] for g in got if g[0] == "1"] == [("1", True)] * 2
    assert [g[2:] for g in got if g[0] == "2"] == [("1", False)]
    assert [g[1:] for g in got if g[0] in "345"] == [(0, "3", True), (0, "4", True), (0, "5", True)]
    assert [g[1:] for g in got if g[0] == "None"] == [(0, "None", True), (3, "None", True)]
    kept = nd.deduplicated(edges, n=2)
    assert kept.columns == edges.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "8", "9", "None", "None"]
    assert nd.near_duplicates(nothing).count() == 0 and nd.deduplicated(nothing).count() == 0


def test_different_texts_of_one_id_stay(spark):
    a, b, c = (f"text {x} " * 3 + " ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "p"), (2, a, "q"), (2, b, "r"), (3, c, "s"), (3, c + " more", "t"), (3, c, "s"), (4, b, "u"), (5, None, "v"), (5, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string").repartition(3)
    got = sorted((r["doc_id"], r["text"] or "") for r in nd.deduplicated(df, n=2).collect())
    assert [g for g in got if g[0] != 3] in ([(1, a), (2, b), (5, ""), (5, "")], [(1, a), (4, b), (5, ""), (5, "")])
    assert [g for g in got if g[0] == 3] in ([(3, c)], [(3, c + " more")])


def test_pairs_below_the_threshold_are_not_asked_one_by_one(spark, monkeypatch):
    """A group whose members share most bands and hardly a link: far fewer pairs are asked than it has."""
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(200)], []
    for i in range(240):
        copy = list(base)
        for k in random.sample(range(200), random.choice((2, 4, 12, 14, 16, 18, 20))):
            copy[k] = word()
        rows.append((i, " ".join(copy)))
    asked, likely = [], nd.likely
    monkeypatch.setattr(nd, "likely", lambda pairs, *more: asked.append(pairs.count()) or likely(pairs, *more))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = by_hand(rows, 2)
    assert answer(nd.near_duplicates(df, n=2)) == want
    assert len({root for _, root, _ in want.values()}) > 100
    assert sum(asked) < 10 * len(rows)


def test_heads_hold_every_pair_at_the_threshold(spark):
    random.seed(10)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, i, " ".join(random.sample(words[: random.choice((30, 60))], random.randrange(1, 30)))) for i in range(150)]
    for i in range(150):  # and near copies of them, sets of one shingle, sets without one
        text = rows[i][2].split()
        text[random.randrange(len(text))] = f"x{i % 3}"
        rows.append((150 + i, 150 + i, " ".join(text)))
    rows += [(300, 300, ""), (301, 301, "one"), (302, 302, "one"), (303, 303, None)]
    df = spark.createDataFrame(rows, "doc long, root long, text string").repartition(3)
    got = {tuple(sorted(r)) for r in nd.near_heads(nd.heads(df, 1, 80), 80).collect()}
    sets = {d: set((t or "").split()) for d, _, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(want) > 50 and want <= got
