import html
import re

from conftest import DATA

from colloquy.llm import extraction as x


def plain(page):
    """The article of a page of the test tables, whose markup is known."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.sub(r"<[^>]*>", "\0", re.sub(r"</?b>", "", inner)).split("\0")
    return " ".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()}
    got = x.op1(spark, f"{DATA}/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == plain(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


SENTENCE = "one two three four five six seven eight nine ten eleven twelve. "


def test_other_markup():
    page = f"""<html><head><title>T</title></head><body><header><h1>Site</h1></header>
    <div class="nav-menu"><a href=/>home</a></div><div id=content><h2>Head&#233;r</h2><p>{SENTENCE}<i>in</i>line<br>next
    <div class="advert box"><p>buy <b>now</b></p></div><p>{SENTENCE}<form><p>name <input></form><aside>side</aside>
    <script>var a = "<p>no</p>"</script><ul><li>{SENTENCE}<li>last of the list is also long enough to stay in the text</ul></div>
    <section class=comments><p>nice {SENTENCE}</p></section><footer>foot {SENTENCE}</footer></body></html>"""
    weights = {"w:p": 0.9, "w:li": 0.9, "w:h2": 0.9, "<h2>": -0.1, "</h2>": -0.1, "<p>": -0.1, "</p>": -0.1, "<li>": -0.1, "#": -4.0}
    text = x.main_text(page, weights)
    s = SENTENCE.strip()
    assert text == f"Headér {s} inline next {s} {s} last of the list is also long enough to stay in the text"


def test_region_is_the_best_of_all():
    import random

    random.seed(3)
    for _ in range(200):
        scores = [random.choice([-3, -1, -0.5, 0.5, 1, 2]) for _ in range(random.randrange(12))]
        a, b = x.region(scores)
        best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert sum(scores[a:b]) == best


def test_broken_markup_is_linear():
    for page in ("<p" * 200_000, "<!--" * 50_000, "x <b \"" * 50_000, "<script>" * 50_000, "&" * 200_000):
        assert len(x.main_text(page, {})) <= len(page)


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a b"), (3, "u", "<p>a b"), (3, "u", "<p>a b"), (4, "u", "<nav>menu</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' as text", "1 as n_chars")
    weights = x.learn(pages, "html", "url", "page_id")
    assert weights == {}
    got = sorted((str(r[0]), r["text"], r["n_chars"]) for r in x.extract(pages, "page_id", "url", "html", weights).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("3", "", 0), ("3", "", 0), ("4", "", 0), ("None", "", 0)] or [g[1] for g in got] == [
        "", "", "a b", "a b", "", "a b"
    ]
    empty = pages.limit(0)
    assert x.extract(empty, "page_id", "url", "html", x.learn(empty, "html", "url", "page_id")).count() == 0
