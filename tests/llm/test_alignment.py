"""Cross-tokenizer alignment against plain loops over both tokenizers' own output."""

import bisect
import collections
import hashlib
import itertools

import pytest
from conftest import DATA
from edge_tables import edges, nothing  # noqa: F401

from colloquy.llm import alignment as al

A, B = f"{al.FOLDER}/byte_bpe_50k.json", f"{al.FOLDER}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def aligner(spark):
    return al.load(spark, A, B)


def by_loops(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every text."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = al.byte_letters()
    found = []
    for text in texts:
        found.append(None)
        if not text:
            continue
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        a_bytes = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            continue
        a_ends, b_ends = (list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes))
        groups = {end: ([], []) for end in sorted(set(a_ends) & set(b_ends))}
        cuts = list(groups)
        for side, ids, ends in ((0, a, a_ends), (1, b, b_ends)):
            for i, e in zip(ids, ends):
                groups[cuts[bisect.bisect_left(cuts, e)]][side].append(i)
        at = collections.defaultdict(list)
        for i, e in zip(a, a_ends):
            at[e].append(i)
        found[-1] = (len(a), len(b), len(groups), [(i, j) for j, e in zip(b, b_ends) for i in at[e]], groups)
    count = collections.Counter(x for f in found if f for x in f[3])
    most = collections.Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f[4].values())
        out.append((*f[:3], len(f[3]), sum(count[x] == most[x[1]] for x in f[3]), sum(count[x] for x in f[3]), hashlib.sha256(text.encode()).hexdigest()))
    return out


def agree(got, expected):
    for g, e in zip(got, expected, strict=True):
        assert (g["n_a"], g["n_b"], g["n_groups"], g["n_links"], g["n_best"], g["count_sum"]) == e[:6]
        assert g["groups_sha256"] == e[6]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()
    got = {r["doc_id"]: r for r in al.op13(spark, f"{DATA}/sf0.01").collect()}
    assert len(got) == len(docs)
    agree([got[r["doc_id"]] for r in docs], by_loops([r["text"] for r in docs]))


@pytest.mark.parametrize("limit", [al.BROADCAST_PAIRS, 100, 0])
def test_edges_with_counts_sent_and_joined(spark, aligner, edges, nothing, limit):
    more = spark.createDataFrame(
        [(20, "a▁b", "x"), (21, "a <|endoftext|> </s> <0x0A> b", "x"), (22, "  two  spaces \n \n ends  ", "x"), (23, "ẞǆ é it's  we'll\x1c 12", "x")],
        "doc_id long, text string, lang string",
    )
    docs = edges.unionByName(more, allowMissingColumns=True)
    aligned = al.align(docs, "text", aligner, docs.columns)
    got = al.link_totals(aligned, al.pair_counts(aligned, aligner.base), limit).collect()
    agree(got, by_loops([r["row"]["text"] for r in got]))
    assert len(got) == 16 and sorted(got[0]["row"].asDict()) == sorted(docs.columns)
    assert {r["row"]["doc_id"] for r in got if r["n_a"] == 0} == {3, 4, 9, None, 20}
    none = al.align(nothing, "text", aligner, ["doc_id"])
    assert al.link_totals(none, al.pair_counts(none, aligner.base), limit).count() == 0


def test_whole_texts_when_words_cannot_be_cut(aligner):
    texts = ["some words  and\nmore, it's 日本語 again and again", "", None, "▁"]
    plain = al.Aligner(al.ByteTokenizer(aligner.a.file), al.PieceTokenizer(aligner.b.file))
    plain.a.by_words = False  # the general encoder, over whole texts
    mine, other = aligner.align(texts), plain.align(texts)
    assert mine["groups_sha256"] == other["groups_sha256"] and mine["links"].to_pylist() == other["links"].to_pylist()


def test_memory_of_words_is_bounded(aligner, monkeypatch):
    monkeypatch.setattr(al, "REMEMBERED", 5)
    texts = [f"word{i} and word{i + 1}" for i in range(20)]
    one_by_one = [aligner.align([t])["groups_sha256"][0] for t in texts]
    assert one_by_one == aligner.align(texts)["groups_sha256"]


def test_groups_cover_the_text(spark, aligner, edges):
    for r in al.groups_of(edges.select("doc_id", "text"), "text", aligner).collect():
        text = (" " + r["text"]).encode() if r["text"] else b""
        entries = aligner.a.entries, aligner.b.entries
        if r["groups"]:
            for g in r["groups"]:
                for ids, entry in zip((g["a"], g["b"]), entries):
                    assert b"".join(entry[i] for i in ids) == text[g["start"] : g["end"]]
            assert r["groups"][-1]["end"] == len(text)
        else:
            assert not r["text"] or "▁" in r["text"]
