import random
import re

from conftest import DATA
from edge_tables import edges, nothing  # noqa: F401

from colloquy.llm import pii

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def by_hand(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                kind == 0
                or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                or kind == 2 and 12 <= len(digits) <= 19 and luhn(digits)
                or kind == 3 and 9 <= len(digits) <= 15
            )
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_strict_expressions():
    random.seed(2)
    pieces = ["a", "b.", "@", ".", "-", " ", "+", "1", "22", "333", "0000255", "(", ")", "x@y.z", "4111 1111 1111 1111", "+1 (212) 555-0100", "10.0.0.1", "é"]
    for _ in range(4000):
        text = "".join(random.choice(pieces) for _ in range(random.randrange(1, 25)))
        assert pii.strict(text) == by_hand(text), text


def test_documents(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    got = pii.op3(spark, f"{DATA}/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        want = by_hand(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in want) for k in range(4)]
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert set(listed) <= set(r["spans"].split(","))


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "@" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii.strict(text)
        pii.lookalikes(text, [])


def test_contexts_find_unseen_identifiers(spark):
    random.seed(4)
    rows, words = [], ["oak", "elm", "fir", "ash", "yew"]
    for i in range(40):
        rows.append((i, f"{random.choice(words)} please call us at +1 (212) 555-{1000 + i} now {random.choice(words)}"))
    rows += [(100, "fir please call us at 212-555-0188 now oak"), (101, "please call us at (0)212 5550199 now")]
    rows += [(200 + i, f"{random.choice(words)} order number 77{i:02}55123 was shipped") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.spans(df).collect()}
    assert [s["kind"] for s in got[100]["spans"]] == [3] and not got[100]["base"]
    span = got[100]["spans"][0]
    assert rows[40][1][span["start"] : span["end"]] == "212-555-0188"
    assert len(got[101]["spans"]) == 1
    assert all(not got[200 + i]["spans"] for i in range(30))
    masked = {r["doc_id"]: r["text"] for r in pii.masked(df).collect()}
    assert masked[100] == "fir please call us at [PHONE] now oak" and "555" not in masked[3] and masked[205] == rows[47][1]


def test_edges(edges, nothing):
    got = pii.spans(edges)
    assert got.count() == 12 and pii.spans(nothing).count() == 0
    nine = [r for r in got.collect() if r["doc_id"] == 9][0]
    assert [(s["kind"], s["start"]) for s in nine["base"]] == [(0, 5), (1, 17)]
    masked = pii.masked(edges)
    assert masked.columns == edges.columns and masked.count() == 12
    by_id = {r["doc_id"]: r["text"] for r in masked.collect() if r["doc_id"] is not None}
    assert by_id[3] is None and by_id[4] == "" and by_id[9].startswith("mail [EMAIL] or [IP] and")
    assert pii.masked(nothing).count() == 0
