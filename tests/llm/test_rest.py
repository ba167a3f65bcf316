"""Quality, top-k, decontamination, URL rules: edges, and what SQL doesn't show."""

import zlib

import numpy as np
import pytest
from conftest import DATA
from edge_tables import edges, nothing  # noqa: F401
from pyspark.sql import functions as F

from colloquy.llm import decontamination as dc
from colloquy.llm import quality, topk, url_rules
from colloquy.llm.common import UPPER


def test_quality_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in quality.op7(spark, f"{DATA}/sf0.1").collect()}
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").collect()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[r["doc_id"]], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    good = np.array([g["score"] for g, q in held if q == 1])
    bad = np.array([g["score"] for g, q in held if q == 0])
    assert np.mean(good[:, None] > bad[None, :]) > 0.99
    assert np.mean([g["predicted"] == q for g, q in held]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_quality_learns_pairs():
    draw = np.random.default_rng(0)
    y = (draw.random(400) < 0.8).astype(int)
    x = draw.normal(size=(400, len(quality.FEATURES)))
    x[:, 0] += 3 * y
    ranker = quality.fit(x, y)
    worth = quality.expanded(x, ranker.mean, ranker.spread) @ ranker.weights
    assert np.mean(worth[y == 1][:, None] > worth[y == 0][None, :]) > 0.95
    assert np.isclose(np.mean(worth < ranker.threshold), np.mean(y == 0), atol=0.01)


def test_quality_learns_from_every_labelled_row(spark):
    """Sums over the tasks' rows give the same ranker as rows at hand, and rows beyond the first 8,000 count."""
    draw = np.random.default_rng(2)
    texts = [" ".join(draw.choice(["aa", "Bb", "c7", "dd.", "|"], draw.integers(1, 30))) for _ in range(9000)]
    y = [int(draw.random() < (0.2 if "|" in t else 0.9)) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int")
    ranker, local = quality.learn(docs, labels), quality.fit(np.array([quality.features(t) for t in texts]), np.array(y))
    assert np.allclose(ranker.weights, local.weights, atol=1e-6) and np.allclose(ranker.mean, local.mean)
    worth = quality.expanded(np.array([quality.features(t) for t in texts]), ranker.mean, ranker.spread) @ ranker.weights
    assert abs(np.quantile(worth, 1 - np.mean(y)) - ranker.threshold) < 1e-6


def test_quality_pairs_in_bins():
    """The slope of the loss of all pairs is nil at the weights."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, len(quality.FEATURES)))
    y = (draw.random(300) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    ranker = quality.fit(x, y)
    z = quality.expanded(x, ranker.mean, ranker.spread)
    diff = (z[y == 1][:, None] - z[y == 0][None, :]).reshape(-1, z.shape[1])
    slope = quality.DECAY * ranker.weights - diff.T @ (1 - quality._logistic(diff @ ranker.weights)) / len(diff)
    assert np.abs(slope).max() < 1e-3


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (9, 7), (None, 1)], "doc_id long, quality int")
    ranker = quality.learn(edges, labels)
    assert quality.score_documents(edges, ranker).count() == 12
    assert quality.accepted(edges, ranker).columns == edges.columns
    assert quality.learn(edges, labels.limit(0)) is None and quality.learn(nothing, labels) is None
    assert {r["score"] for r in quality.score_documents(edges, None).collect()} == {0.5}
    assert quality.accepted(nothing, None).count() == 0 and quality.accepted(edges, None).count() == 12


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as id", "1 as weights", "2 as q")
    return df.repartition(3)


def test_topk_by_hand(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(v) if draw.random() < 0.3 else 0.0 for v in draw.normal(size=draw.integers(0, 9))]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (None, [1.0]), (20, rows[20][1]), (7, rows[7][1])]
    got = topk.search(vectors(spark, rows), "vec_id", topk.quantised(F.col("embedding"), 64), F.col("vec_id") % 20 == 0, 5).collect()
    good = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows[:300] + rows[-2:]]
    for q in {i for i, _ in good if i % 20 == 0}:
        own = next(v for i, v in good if i == q)
        scores = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert mine == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]


def test_topk_exact_for_large_weights():
    draw = np.random.default_rng(5)
    for size in (100, 1 << 20, 1 << 29):
        q, c = draw.integers(-size, size, (5, 7)), draw.integers(-size, size, (50, 7))
        assert (topk.accumulate(q, c).astype(np.int64) == q @ c.T).all()


def test_topk_empty(spark):
    none = vectors(spark, [(1, [1.0])]).limit(0)
    assert topk.search(none, "vec_id", topk.quantised(F.col("embedding"), 64), F.col("vec_id") % 20 == 0, 5).count() == 0


@pytest.mark.parametrize("max_set", [dc.MAX_SET, 2])
def test_decontamination_both_ways(spark, edges, nothing, max_set):
    """The set inside the plan and the join give the same."""
    items = spark.createDataFrame(
        [(10, "Words HERE again, and again: to make a text of more"), (11, "x"), (12, None), (13, ""), (None, "NO id"), (14, "x")],
        "item_id long, text string",
    )
    windows = dc.item_windows(items, "item_id", "text")
    got = {}
    for r in dc.scan(edges, "text", windows, max_set).collect():
        got.setdefault(r["row"]["doc_id"], []).append((r["n_words"], [(f["at"], f["size"]) for f in r["found"]]))
    assert got[1] == [(24, [(1, 10), (2, 10)])] * 2 and got[6] == [(1, [(0, 1)])] and got[3] == [(0, [])]
    assert sorted(got[None]) == [(0, []), (4, [(0, 2)])]
    assert dc.scan(nothing, "text", windows, max_set).count() == 0


def test_decontamination_report_and_removal(spark, edges, nothing):
    items = spark.createDataFrame([(2, "again and again"), (10, "again and again"), (11, "X")], "item_id long, text string")
    got = {r["doc_id"]: r for r in dc.report(edges, "doc_id", "text", items, "item_id", "text").collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[6]["n_items"], got[4]["contaminated"]) == (3, 2, 1, False)
    windows = dc.item_windows(items, "item_id", "text")
    clean = dc.clean_documents(edges, "text", windows)
    assert clean.columns == edges.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == ["3", "4", "5", "7", "8", "9", "None", "None"]
    cut = {r["doc_id"]: r["text"] for r in dc.cut_spans(edges, "text", windows).collect()}
    assert cut[1].startswith("same words here to make") and cut[6] == "" and cut[3] is None and cut[5] == " \n\t "
    none = dc.item_windows(items.limit(0), "item_id", "text")
    assert dc.clean_documents(edges, "text", none).count() == 12


def test_url_rules(spark):
    rows = [
        ("http://WWW.Example.com/en/a", "www.example.com/en/", "allow"), ("http://x.example.com/en/", "example.com/en/", "block"),
        ("http://example.com/EN/", "com/", "allow"), ("http://badexample.com/en/", "com/", "allow"), ("http://a.net/es/?q", "net/es/", "block"),
        ("http://a.net/es", None, "allow"), ("http://com", None, "allow"), ("http://free-bets.org/x", None, "block"), (None, None, "allow"),
        ("no scheme", None, "allow"), ("", None, "allow"), ("http://alphabets.org/", None, "allow"), ("a://b://c.com/", None, "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], "h") for i, r in enumerate(rows)], "page_id long, url string, host string").repartition(3)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(df, "page_id", "url", [*url_rules.NAMED, *url_rules.OWN]).collect()}
    assert [got[i] for i in range(len(rows))] == [r[1:] for r in rows]
    assert url_rules.judge(df.limit(0), "page_id", "url", url_rules.NAMED).count() == 0


def test_url_rules_by_index_equal_all_rules_tried(spark):
    import random
    import re

    random.seed(6)
    words = ["ads", "shop", "news", "x1", "blog", "en"]
    rules = [url_rules.host_rule(random.choice(["allow", "block"]), f"{random.choice(words)}.org", "/" + random.choice(["", "en", "en/", "a/b/"])) for _ in range(40)]
    urls = [f"http://{random.choice(words)}.{random.choice(words)}.org/{random.choice(words)}/b/{i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_rules.judge(df, "page_id", "url", rules).collect():
        fits = sorted((x for x in rules if re.search(x.pattern, r["host"] + r["path"])), key=lambda x: x.order)
        assert (r["rule"], r["verdict"]) == ((fits[0].name, fits[0].action) if fits else (None, "allow"))
    assert len(UPPER) == 26
