import collections
import itertools
import math

import numpy as np
import pytest
from conftest import DATA
from edge_tables import edges, nothing  # noqa: F401

from colloquy.llm import segmentation as s


@pytest.fixture(scope="module")
def vocabulary():
    return s.Vocabulary.load()


@pytest.fixture(scope="module")
def lattice(vocabulary):
    return s.Lattice(vocabulary)


def every_path(vocabulary, text):
    """All paths of a short text and their probabilities, by recursion."""
    piece = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i] == 0}

    def paths(rest):
        if not rest:
            yield (), 1.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in piece:
                for tail, p in paths(rest[n:]):
                    yield (piece[rest[:n]], *tail), p * vocabulary.weights[piece[rest[:n]]]

    out = dict(paths(" " + text))
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def keys(n):
    return s.mixed(np.arange(n).astype(np.uint64))


def test_is_a_sample_without_replacement(vocabulary, lattice):
    text, n = "than it", 20_000
    exact = every_path(vocabulary, text)
    got = s.sampled([text] * n, keys(n), 2, lattice)
    pairs = collections.Counter(tuple(tuple(p["ids"].tolist()) for p in g) for g in got)
    firsts = collections.Counter(tuple(g[0]["ids"].tolist()) for g in got)
    top = sorted(exact, key=exact.get)[-4:]
    for a in top:
        assert abs(firsts[a] / n - exact[a]) < 4 * math.sqrt(exact[a] / n)
    for a, b in itertools.permutations(top, 2):
        p = exact[a] * exact[b] / (1 - exact[a])
        assert abs(pairs[a, b] / n - p) < 4 * math.sqrt(p / n) + 1e-3
    for g in got[:300]:
        assert g[0]["perturbed"] > g[1]["perturbed"] and not np.array_equal(g[0]["ids"], g[1]["ids"])
        for p in g:
            assert math.isclose(p["log_prob"], math.log(exact[tuple(p["ids"].tolist())]), abs_tol=1e-6)
    weighted = np.mean([sum(math.exp(p["log_prob"]) / p["inclusion"] for p in g) for g in got])
    assert abs(weighted - 1) < 0.02  # inclusion scores make the sample unbiased


def test_all_paths_when_k_exceeds_them(vocabulary, lattice):
    exact = every_path(vocabulary, "abc")
    got = s.sampled(["abc"], keys(1), 1000, lattice)[0]
    assert {tuple(p["ids"].tolist()) for p in got} == set(exact) and {p["inclusion"] for p in got} == {1.0}


@pytest.mark.parametrize("text", ["", " ", "  a\n\n b▁c 日本語😀é\x00x", "x" * 5000, "a\tb\r\n" * 50, "\ud7ff\ue000"])
def test_round_trip(vocabulary, lattice, text):
    for p in s.sampled([text], keys(1), 3, lattice)[0]:
        assert vocabulary.decode(p["ids"]) == text


def test_documents(spark):
    rows = s.op5(spark, f"{DATA}/sf0.001").collect()
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").count()
    assert len(rows) == 2 * docs and all(r["round_trip"] for r in rows)
    assert len({(r["doc_id"], r["ids_sha256"]) for r in rows}) == len(rows)


def test_same_paths_in_any_partition(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    answers = []
    for df in (docs.coalesce(1), docs.repartition(7)):
        answers.append({(r["doc_id"], r["rank"]): r["ids"] for r in s.encoded(df, k=2).collect()})
    assert answers[0] == answers[1]


def test_edges(edges, nothing):
    got = s.encoded(edges)
    back = s.decoded(got, "ids", name="back").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in edges.collect() if r["doc_id"] is not None}
    assert all(r["back"] == texts[r["doc_id"]] for r in back if r["doc_id"] is not None)
    assert {r["doc_id"] for r in back} == {r["doc_id"] for r in edges.collect()}
    assert s.encoded(nothing).count() == 0


def test_pieces_of_a_text(vocabulary, lattice):
    text = " wherethe  ofThe日本é▁ not"
    number = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i] == 0}
    n = len(text)
    want = {(a, b, number[text[a:b]]) for a in range(n) for b in range(a + 1, n + 1) if text[a:b] in number}
    codes, following = np.append(np.uint32(0), s.letters_of(text)), np.append(np.arange(1, n + 1), -1)
    got = set()
    for size, start, end, piece in lattice.walk(codes, following):
        assert (end - start == size).all()
        got |= {x for x in zip(start.tolist(), end.tolist(), piece.tolist()) if x[2]}
    assert got == want and len(want) > n


def test_each_word_is_built_once(lattice, monkeypatch):
    built, words = [], s.Words.__init__
    monkeypatch.setattr(s.Words, "__init__", lambda self, some, own: (built.extend(some), words(self, some, own))[1])
    texts = ["one thing and another", "and one more thing, another"]
    memory = s.Memory(lattice)
    got = [s.sampled([t], keys(1), 2, lattice, memory)[0] for t in (*texts, *texts)]
    assert len(built) == len(set(built)) == len({w for t in texts for w in s.words_of(t, lattice)})
    monkeypatch.setattr(s, "REMEMBERED", 0)  # what is forgotten is built again, with the same paths
    memory = s.Memory(lattice)
    again = [s.sampled([t], keys(1), 2, lattice, memory)[0] for t in (*texts, *texts)]
    for a, b in zip(got, again):
        assert [p["ids"].tolist() for p in a] == [p["ids"].tolist() for p in b]
        assert [p["log_prob"] for p in a] == [p["log_prob"] for p in b]


def test_random_numbers_next_to_one(vocabulary, lattice, monkeypatch):
    monkeypatch.setattr(s, "uniform", lambda x: np.full(len(x), 1 - 2.0**-30))  # one, in single precision
    for text in ("zqxj ononou, thn", "日本語 and more"):
        assert vocabulary.decode(s.sampled([text], keys(1), 1, lattice)[0][0]["ids"]) == text


def test_probabilities_of_long_words(vocabulary, lattice):
    text = "a" * 60 + " " + "=-" * 40 + "\U0010ffff" * 20 + "\n" + "x" * 90
    whole, weight = " " + text, {p: vocabulary.weights[i] for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i] == 0}
    byte = math.log(vocabulary.weights[vocabulary.byte_ids[0]])
    total = [0.0]  # logarithms of the sums over all paths to each end
    for end in range(1, len(whole) + 1):
        parts = [whole[begin:end] for begin in range(max(0, end - lattice.longest), end)]
        logs = [total[end - len(p)] + math.log(weight[p]) for p in parts if p in weight]
        if parts[-1] not in weight:
            logs.append(total[end - 1] + byte * len(parts[-1].encode()))
        total.append(float(np.logaddexp.reduce(logs)))
    for p in s.sampled([text], keys(1), 2, lattice)[0]:
        assert math.isclose(p["log_prob"], float(np.log(vocabulary.weights[p["ids"]]).sum()) - total[-1], abs_tol=1e-6)
