"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, by weights learnt
from labelled pages: those that mark their own content with ``article`` or ``main``. One linear scan
finds the contiguous region with the highest sum; its blocks are the text. Elements that are not
reading matter by their name (menus, footers, forms, ...) count as one tag each: their words neither
score nor appear, also inside the region. So do blocks whose whole class name, id or role says so
(``comments``, ``nav-menu``), unless they hold most of the page's words. Where a hint is only a part of
a name (``related-work``, ``has-sidebar``), all words stay and have a learnt weight of their own.
An element ends where a browser ends it, also one that is never closed.

The weights come from the ``LABELLED`` labelled pages with the lowest hash of their URL and id; they are
a few numbers per kind of tag. All pages are cut where they lie, and whole.

Defined results: null or empty html, and pages without words outside of menus and the like, give an
empty text; broken, unclosed or cut-off markup is read as far as it goes; without labelled pages all
weights are even; white space is that of ``str.split``; repeated rows give equal texts; extra
columns stay out.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import by_chunks, table, text_size
from colloquy.llm.registry import query

#: Labelled pages that teach, the cost of a tag never seen in content, and the pages that smooth a count.
LABELLED, COST, SMOOTH = 1_000, 5.0, 2.0

CONTENT = frozenset("article main".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
SKIPPED = RAW | frozenset(
    "head nav header footer aside form menu dialog button select option svg canvas audio video datalist fieldset".split()
)
#: Words of a class, id or role that mark an element as no reading matter.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo sponsor sponsored sidebar menu navigation nav navbar "
    "breadcrumb breadcrumbs footer masthead comment comments disqus cookie cookies consent notice notices alert popup "
    "modal newsletter subscribe share sharing social related recommended widget toolbar pagination pager skip login "
    "search complementary contentinfo".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Tags with a weight of their own; all others share one.
KNOWN = INLINE | CONTENT | frozenset(
    "html body div section p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th caption blockquote pre "
    "figure address br hr center details summary".split()
)
#: What ends an open paragraph.
BLOCKS = (KNOWN | frozenset("nav header footer aside form menu dialog fieldset".split())) - INLINE - VOID
#: Elements without a closing tag: what a tag of the name ends, unless one of the others was opened since.
SELF_ENDING = {
    "p": (("p",), ()), "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "option": (("option",), ("select",)),
}

#: Elements that no hint can end up on.
PLAIN = INLINE | VOID | CONTENT | RAW | {"html", "body"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[/]?([A-Za-z][^\s/>"'<]*)((?:[^'"<>]++|"[^"]*+"|'[^']*+'|['"])*+)>?|<[!?][^<>]*+>?""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def hinted(attributes: str) -> int:
    """2 if a whole class name, id or role is made of hints, 1 if a part of one is a hint."""
    names = [n for m in _NAMED.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()]
    found = [[w in HINTS for w in _WORD.findall(n)] for n in names]
    return 2 if any(x and all(x) for x in found) else int(any(map(any, found)))


def parsed(page: str) -> tuple[list[tuple[str | None, bool, str]], dict[int, int]]:
    """(name, closing, attributes) of tags and (None, False, text) of texts in order, and for each block
    that opens the place behind its end. What lies in a raw element is left out.
    """
    parts: list[tuple[str | None, bool, str]] = []
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = defaultdict(list)
    for_raw = {}
    at = 0

    def last(names) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    def close(place: int) -> None:
        while len(stack) > place:
            name, i = stack.pop()
            places[name].pop()
            ends[i] = len(parts)

    while True:
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at and (text := entities.unescape(page[at:end])):
            parts.append((None, False, text))
        if m is None:
            close(0)
            return parts, ends
        at = m.end()
        if not m[1]:
            continue
        name, closing = m[1].lower(), page[m.start() + 1] == "/"
        ended, barrier = SELF_ENDING.get(name, ((name,), ()))
        if closing:
            place = last((name,))
            ends_one = place > last(barrier)
            if ends_one:
                close(place + 1)  # unclosed ones inside end before the tag, its own element behind it
            parts.append((name, True, ""))
            if ends_one:
                close(place)
            continue
        if stack and stack[-1][0] == "head" and name not in RAW and name not in VOID:
            close(len(stack) - 1)
        if stack and stack[-1][0] == "p" and name in BLOCKS:
            close(len(stack) - 1)
        if name in SELF_ENDING and (place := last(ended)) > last(barrier):
            close(place)
        if name in RAW and not (m[2].endswith("/") and (places["svg"] or places["math"])):
            stop = for_raw.get(name) or for_raw.setdefault(name, re.compile(rf"</{name}(?=[\s/>])", re.I))
            found = stop.search(page, at)
            behind = page.find(">", found.end()) if found else -1
            at = behind + 1 if behind >= 0 else len(page)
        elif name not in VOID and name not in INLINE:
            places[name].append(len(stack))
            stack.append((name, len(parts)))
        parts.append((name, False, m[2]))


def tokens(page: str) -> list[tuple[str, str | None, bool]]:
    """(feature, text, content) in order: text for words, None for tags; content where the page says so.

    Features: ``w:block`` of words in a kind of block, ``h:block`` inside an element with a hint in its name,
    ``l:block`` inside a link, ``<name>`` and ``</name>`` of tags, ``#`` of a skipped element.
    """
    parts, ends = parsed(page)
    words = [0, *accumulate(0 if name else len(said.split()) for name, _, said in parts)]
    out: list[tuple[str, str | None, bool]] = []
    block, link, inside = "flow", False, 0
    skipped = hint_ends = 0
    for i, (name, closing, said) in enumerate(parts):
        if i < skipped:
            if not (name in CONTENT and not closing or name == "body"):
                continue
            skipped = i
        if name is None:
            out.append((("l:" if link else "h:" if i < hint_ends else "w:") + block, said, inside > 0))
            continue
        if not closing:
            own, hint, end = name in SKIPPED and not (name == "header" and inside), 0, ends.get(i, i + 1)
            if not own and said and name not in PLAIN:
                hint = hinted(said)
                if hint and 2 * (words[end] - words[i]) > words[-1]:
                    hint = 0  # it holds most of the page's words
            if own or hint == 2:
                if not _after_skipped(out):
                    out.append(("#", None, inside > 0))
                skipped = end
                continue
            if hint:
                hint_ends = max(hint_ends, end)
        feature = f"</{name}>" if closing else f"<{name}>"
        if name in CONTENT:
            inside = max(0, inside - 1) if closing else inside + 1
        out.append((feature if name in KNOWN else "<?>", None, inside > 0 or name in CONTENT))
        if name == "a":
            link = not closing
        elif name not in INLINE:
            link = False
            if name not in VOID:
                block = "flow" if closing else name if name in KNOWN else "other"
    return out


def _after_skipped(out: list[tuple[str, str | None, bool]]) -> bool:
    """Whether nothing but white space has come since a skipped element: neighbours count as one."""
    last = -2 if len(out) > 1 and out[-1][1] is not None and not out[-1][1].strip() else -1
    return bool(out) and out[last][0] == "#"


def counted(page: str) -> dict[str, list[int]]:
    """Of a labelled page: (in content, outside) by feature; words count one by one."""
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for feature, text, content in tokens(page):
        out[feature][not content] += 1 if text is None else len(text.split())
    return out


def learn(pages: DataFrame, html: str, url: str, page_id: str) -> dict[str, float]:
    """Weights of the features, from a bounded sample of the pages that mark their content."""
    marked = pages.filter(F.col(html).rlike(r"(?i)<(article|main)[\s>]"))
    marked = marked.select(F.col(html).alias("html"), F.struct(F.col(url).alias("u"), F.col(page_id).alias("p")).alias("key"))
    # the sample is drawn by its keys, so that no task gathers pages
    drawn = marked.select("key").orderBy(F.xxhash64("key"), "key").limit(LABELLED).distinct()
    sample = marked.join(F.broadcast(drawn), marked["key"].eqNullSafe(drawn["key"]), "left_semi")

    def make(rows: list[dict]) -> dict:
        total: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for row in rows:
            for feature, (a, b) in counted(row["html"]).items():
                total[feature][0] += a
                total[feature][1] += b
        return {"feature": list(total), "yes": [v[0] for v in total.values()], "no": [v[1] for v in total.values()]}

    parts = by_chunks(sample, make, "feature string, yes long, no long", text_size("html"), 4 << 20)
    rows = parts.groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()  # a fixed set of features
    return {r["feature"]: weight(r["feature"], r["yes"], r["no"]) for r in rows}


def weight(feature: str, yes: int, no: int) -> float:
    share = (yes + SMOOTH / 2) / (yes + no + SMOOTH)
    return share if feature[0] in "wlh" else -COST * (1 - share)


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch with the highest sum (the first, then the shortest); empty without a positive one."""
    best, best_at, here, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if here <= 0:
            here, start = 0.0, i
        here += s
        if here > best:
            best, best_at = here, (start, i + 1)
    return best_at


def main_text(page: str | None, weights: dict[str, float]) -> str:
    found = tokens(page or "")
    scores = []
    for feature, text, _ in found:
        w = weights.get(feature)
        if w is None:
            w = weight(feature, 0, 0)
        scores.append(w if text is None else w * len(text.split()))
    a, b = region(scores)
    blocks: list[list[str]] = [[]]
    for feature, text, _ in found[a:b]:
        if text is not None:
            blocks[-1].append(text)
        elif feature.strip("</>") not in INLINE:
            blocks.append([])
    joined = (" ".join("".join(x).split()) for x in blocks)
    return " ".join(x for x in joined if x)


def extract(pages: DataFrame, page_id: str, url: str, html: str, weights: dict[str, float]) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    fields = [narrow.schema["page_id"], narrow.schema["url"]]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make(rows: list[dict]) -> dict:
        text = [main_text(r["html"], weights) for r in rows]
        return {"page_id": [r["page_id"] for r in rows], "url": [r["url"] for r in rows], "text": text, "n_chars": list(map(len, text))}

    return by_chunks(narrow, make, schema, text_size("html"), 1 << 20)


@query("op1_extraction")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract(pages, "page_id", "url", "html", learn(pages, "html", "url", "page_id"))
