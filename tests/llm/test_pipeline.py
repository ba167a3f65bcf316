import re

from conftest import DATA
from edge_tables import edges, nothing  # noqa: F401

import corpus_pipeline as cp
from colloquy.llm import decontamination, pii, quality, segmentation
from colloquy.llm.common import stored, table


def test_stages_against_by_hand(spark):
    from test_neardup import by_hand

    folder = f"{DATA}/sf0.001"
    docs = table(spark, folder, "documents")
    every = [docs]
    for name, stage in cp.STAGES:
        every.append(stored(stage(spark, every[-1], folder), "test-" + name.replace(" ", "-")))
    for before, after in zip(every[:-1], every[1:-1]):
        assert after.columns == docs.columns
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    # quality: what the ranking accepts, and little of label 1 is lost
    texts = [{r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in every[:5]]
    ranker = quality.learn(docs, table(spark, folder, "labels"))
    assert set(texts[1]) == {d for d, t in texts[0].items() if ranker.score([t])[0] >= quality.CUT}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in texts[1] for d in good) > 0.93 * len(good)
    # near duplicates: the smallest of each component
    assert set(texts[2]) == {d for d, (_, _, kept) in by_hand(list(texts[1].items()), 5).items() if kept}
    # decontamination: no window of ten words of any item
    word = re.compile(decontamination.WORD)
    cut = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in table(spark, folder, "benchmark").collect():
        w = cut(r["text"])
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(w) for w in windows}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [cut(t)] for n in sizes for i in range(len(w) - n + 1))
    assert set(texts[3]) == {d for d, t in texts[2].items() if not hit(t)} and len(texts[3]) < len(texts[2])
    # personal data: nothing strict is left, other texts are unchanged
    assert set(texts[4]) == set(texts[3])
    for d, t in texts[4].items():
        assert not pii.strict(t) and (t == texts[3][d] or "[" in t)
    # segmentations: two paths a document, both of its text
    vocabulary = segmentation.Vocabulary.load()
    rows = every[5].collect()
    assert len(rows) == 2 * len(texts[4])
    assert all(vocabulary.decode(r["ids"]) == texts[4][r["doc_id"]] for r in rows)


def test_empty_and_odd_documents(spark, edges, nothing):
    folder = f"{DATA}/sf0.001"
    shape = ["doc_id", "text", "lang", "source", "n_chars"]
    for given in (nothing, edges):
        docs = given.selectExpr("doc_id", "text", "lang", "cast(null as string) as source", "cast(null as long) as n_chars")
        for name, stage in cp.STAGES:
            assert docs.columns == shape
            docs = stored(stage(spark, docs, folder), "edge-" + name.replace(" ", "-"))
        assert docs.columns[0] == "doc_id" and (given is edges or docs.count() == 0)
