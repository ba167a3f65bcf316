"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Test items become windows of ``n`` words; an item of fewer words, but not none, is one window.
Each training text is cut into words once; every window of it is hashed inside the row, the hash is
looked up in the hash set, and a hit is verified by its words, so a hash collision can't mark a
document. All of it is DataFrame and SQL functions; with the set, texts are never shuffled.

The hash set travels inside the plan, and only while it has at most ``max_set`` entries (checked);
beyond, the windows meet the test windows in a join on hash and words, with the same result.

Defined results: a null or empty text has no words and no hits; a null or empty item has no
windows; items that repeat count by their ids, a null id counts as hit but not as item; a repeated
training row is judged by itself; an empty benchmark leaves every document clean. Columns of the
input travel in a struct, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import LOWER, UPPER, ascii_lower, table
from colloquy.llm.registry import query

#: Runs of these are words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NGRAM = 10
#: Entries of the hash set that may travel inside the plan.
MAX_SET = 50_000

_FOUND = "array<struct<at:int,size:int,gram:string>>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, item_id: str, text: str, n: int = NGRAM) -> DataFrame:
    """Distinct (item, size, gram, hash) of all items; a gram is its words joined by one space."""
    words = items.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    sized = words.withColumn("size", F.least(F.size("w"), F.lit(n)))
    grams = F.expr("transform(sequence(0, size(w) - size), i -> slice(w, i + 1, size))")
    flat = sized.select("item", "size", F.explode(grams).alias("g"))
    return flat.select("item", "size", F.array_join("g", " ").alias("gram"), F.xxhash64("g").alias("hash")).distinct()


def scan(docs: DataFrame, text: str, windows: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """``(row, n_words, found)``: the columns of ``docs``, its words, and its verified hits.

    ``found`` holds (at, size, gram) by position of the first word, each window once.
    """
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()]  # at most n
    known = windows.select("hash", "gram").distinct().limit(max_set + 1).collect()
    cut = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("__text"))
    if len(known) > max_set:
        return _joined(cut.select("row", words_of(F.col("__text")).alias("w")), windows, sizes)
    found = [_hashed(s, hashes(known), grams(known)) for s in sizes if known]
    seen = cut.select("row", _bound(found).alias("seen"))
    return seen.select("row", F.col("seen.n_words").alias("n_words"), F.col("seen.found").alias("found"))


def _bound(parts: list[str]) -> Column:
    """Words and hits in one expression that cuts the text once, wherever the optimizer puts it."""
    lower = f"if(octet_length(__text) = char_length(__text), lower(__text), translate(__text, '{UPPER}', '{LOWER}'))"
    found = f"array_sort(concat(cast(array() as {_FOUND}){''.join(', ' + p for p in parts)}))"
    seen = f"named_struct('n_words', {_COUNT}, 'found', {found})"
    return F.expr(f"transform(array(regexp_extract_all({lower}, r'{WORD}', 0)), w -> {seen})[0]")


def hashes(known: list) -> str:
    return ",".join({f"{r['hash']}L" for r in known})


def grams(known: list) -> str:
    return ",".join({f"'{r['gram']}'" for r in known})  # words hold no quote and no backslash


_COUNT = "cast(greatest(coalesce(size(w), 0), 0) as bigint)"


def _hashed(size: int, hash_set: str | None, gram_set: str | None) -> str:
    """Windows of one size: all of them, or those in the set, verified by their words."""
    places = f"transform(sequence(0, size(w) - {size}), i -> (i as at, xxhash64(slice(w, i + 1, {size})) as h))"
    if hash_set:
        places = f"filter({places}, x -> x.h in ({hash_set}))"
    full = f"transform({places}, x -> (x.at as at, {size} as size, array_join(slice(w, x.at + 1, {size}), ' ') as gram))"
    if gram_set:
        full = f"filter({full}, x -> x.gram in ({gram_set}))"
    return f"cast(case when size(w) >= {size} then {full} else array() end as {_FOUND})"


def _joined(cut: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    tagged = cut.withColumn("tag", F.monotonically_increasing_id())
    flat = tagged.select("tag", F.explode(F.concat(*[F.expr(_hashed(s, None, None)) for s in sizes])).alias("f"))
    known = windows.select("gram", "size").distinct()
    met = flat.join(known, (F.col("f.gram") == known["gram"]) & (F.col("f.size") == known["size"]), "left_semi")
    found = met.groupBy("tag").agg(F.collect_list("f").alias("found"))  # at most the windows of one text
    back = tagged.select("tag", "row", F.expr(_COUNT).alias("n_words")).join(found, "tag", "left")
    return back.select("row", "n_words", F.array_sort(F.coalesce("found", F.array().cast(_FOUND))).alias("found"))


def hit_words(found: Column) -> Column:
    """Words covered by at least one window."""
    step = lambda acc, x: F.struct(
        F.greatest(acc["last"], x["at"] + x["size"]).alias("last"),
        (acc["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(acc["last"], x["at"]))).alias("n"),
    )
    start = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(found, start, step, lambda acc: acc["n"])


def report(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, n: int = NGRAM):
    """One row per document: words, words hit, items found, ids of the items, verdict."""
    windows = item_windows(items, item_id, item_text, n)
    seen = scan(docs.select(doc_id, text), text, windows)
    rows = seen.select(
        F.col("row")[doc_id].alias("doc_id"),
        "n_words",
        hit_words(F.col("found")).alias("n_hit"),
        F.array_distinct(F.col("found.gram")).alias("grams"),
        F.monotonically_increasing_id().alias("tag"),
    )
    flat = rows.select("tag", "doc_id", "n_words", "n_hit", F.explode_outer("grams").alias("gram"))
    named = flat.join(windows.select("gram", F.col("item").cast("string").alias("item")), "gram", "left")
    return named.groupBy("tag", "doc_id", "n_words", "n_hit").agg(F.collect_set("item").alias("items")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, text: str, windows: DataFrame) -> DataFrame:
    """The documents without a hit, with their columns."""
    return scan(docs, text, windows).filter(F.size("found") == 0).select("row.*")


def cut_spans(docs: DataFrame, text: str, windows: DataFrame) -> DataFrame:
    """Every document; where windows hit, ``text`` becomes its other words, joined by one space."""
    seen = scan(docs, text, windows)
    raw = F.regexp_extract_all(F.col("row")[text], F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    kept = F.filter(raw, lambda w, i: ~F.exists("found", lambda x: (x["at"] <= i) & (i < x["at"] + x["size"])))
    new = F.when(F.size("found") > 0, F.array_join(kept, " ")).otherwise(F.col("row")[text])
    return seen.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
place AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM doc, sizes, unnest(range(1, len(w) - size + 2)) AS u(i) WHERE len(w) >= size),
hit AS (SELECT p.doc_id, p.i, p.size, v.item_id FROM place p JOIN win v ON p.gram = v.gram AND p.size = v.size),
n_hit AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM hit, unnest(range(i, i + size)) AS u(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit,
  coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN n_hit h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""


@query("op9_decontamination", _SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return report(docs, "doc_id", "text", items, "item_id", "text")
