"""Personal data by bootstrapped contextual extraction.

Seeds are the entities that strict expressions find: addresses of mail, internet addresses, card
numbers that pass Luhn, and phone numbers. The words around seeds and around other identifier-like
tokens are lexical patterns; patterns and instances (distinct values) form a bipartite graph, which
Spark scores in rounds: a pattern's confidence is the belief in its instances of a kind over all its
instances, an instance's belief is that at least one of its trusted patterns is right, and instances
believed enough teach in the next round. Patterns of at least ``SUPPORT`` instances and ``TRUST``
confidence then mark the unseen identifiers they surround. Seeds always stay.

Only identifier-like tokens with their contexts leave the scan: values as hashes, texts never. The
graph is aggregated before each shuffle, so a context or value shared by many rows is one row a task.

Defined results: a null or empty text has no spans; spans of different kinds may overlap; repeated
rows get equal spans; extra columns stay out of ``spans`` and are kept by ``masked``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.llm.common import by_chunks, stored, table, text_size
from colloquy.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
#: Rounds of the graph, distinct instances of a kind behind a trusted pattern, and least confidence.
ROUNDS, SUPPORT, TRUST = 3, 5, 0.8
#: Characters on either side in which a pattern's words are looked for.
AROUND = 64

# The strict expressions. A run's later starts can't match where its first doesn't, so possessive
# repeats and look-behinds change no match and keep long runs linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Identifier-like tokens that need not be one of the above.
_LIKE = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9][0-9A-Za-z().:_/-]*+(?: [(]?[0-9][0-9().-]*+)*+")
_AT = re.compile(r"@|[(\[]at[)\]]")
_BEFORE_AT, _AFTER_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?$"), re.compile(r" ?[A-Za-z0-9-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]+)*")
_EDGE = "\"'.,;:!?()[]{}<>|=*#$%&"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            free = found.end()
            yield start, free
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def strict(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the seeds, in order."""
    spans = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def kind_like(value: str) -> int | None:
    """The kind a token may be of: what it holds decides, not how it is written."""
    digits = sum("0" <= c <= "9" for c in value)
    letters = sum(c.isalpha() for c in value)
    if _AT.search(value):
        return 0
    if letters or not 7 <= digits <= 19:
        return None
    if value.count(".") + value.count(":") >= 3:
        return 1
    return 2 if digits >= 12 else 3


def lookalikes(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of identifier-like tokens that touch no seed."""
    found = []
    for m in _AT.finditer(text):
        before, after = _BEFORE_AT.search(text[max(0, m.start() - AROUND) : m.start()]), _AFTER_AT.match(text, m.end())
        if before and after:
            found.append((m.start() - len(before[0]), 0, after.end()))
    if _DIGIT.search(text):
        for m in _LIKE.finditer(text):
            value = m[0].rstrip(".:_/-(")
            if (kind := kind_like(value)) is not None:
                found.append((m.start(), kind, m.start() + len(value)))
    found.sort()
    out, i, end = [], 0, 0
    for start, kind, stop in found:
        while i < len(taken) and taken[i][2] <= start:
            i += 1
        if start >= end and not (i < len(taken) and taken[i][0] < stop):
            out.append((start, kind, stop))
            end = stop
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before, and a word on either side."""
    word = lambda w: w.strip(_EDGE).lower() or w
    before = [word(w) for w in text[max(0, start - AROUND) : start].split()[-2:]]
    after = [word(w) for w in text[end : end + AROUND].split()[:1]]
    out = [f"{' '.join(before)} _"] if len(before) == 2 else []
    return out + [f"{before[-1]} _ {after[0]}"] if before and after else out


def contexts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``mark`` (of its text), seeds, look-alikes with patterns."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    one = T.StructType.fromDDL("start int, kind int, `end` int, seed boolean, value string, patterns array<string>")
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("mark", T.StringType()), T.StructField("found", T.ArrayType(one))])

    def make(rows: list[dict]) -> dict:
        out = {"doc_id": [], "mark": [], "found": []}
        for row in rows:
            text = row["text"] or ""
            seeds = strict(text)
            spans = [(s, True) for s in seeds] + [(s, False) for s in lookalikes(text, seeds)]
            out["doc_id"].append(row["doc_id"])
            out["mark"].append(_mark(text) if spans else None)
            out["found"].append([_instance(text, s, seed) for s, seed in spans])
        return out

    return by_chunks(narrow, make, schema, text_size(), 1 << 20)


def _mark(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def _instance(text: str, span: tuple[int, int, int], seed: bool) -> dict:
    start, kind, end = span
    value = hashlib.md5(text[start:end].lower().encode("utf-8", "surrogatepass")).hexdigest()
    return {"start": start, "kind": kind, "end": end, "seed": seed, "value": value, "patterns": patterns(text, start, end)}


def bootstrap(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """``value, kind`` of the look-alikes that trusted patterns surround."""
    flat = found.select(F.explode("found").alias("i")).select("i.value", "i.kind", "i.seed", F.explode("i.patterns").alias("pattern"))
    edges = stored(flat.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    believed = edges.filter("seed").select("value", "kind").distinct().withColumn("belief", F.lit(1.0))
    for _ in range(rounds):
        scored = edges.join(believed, ["value", "kind"], "left").groupBy("pattern", "kind").agg(
            F.sum("belief").alias("hits"), F.count("belief").alias("known"), F.count(F.lit(1)).alias("all")
        )
        trusted = scored.filter(F.col("known") >= support).select(
            "pattern", "kind", (F.col("hits") / F.col("all")).alias("confidence")
        ).filter(F.col("confidence") >= trust)
        # the chance that all its patterns are wrong, by sums of logarithms
        wrong = F.exp(F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999)))))
        new = edges.filter(~F.col("seed")).join(trusted, ["pattern", "kind"]).groupBy("value", "kind").agg(
            (F.lit(1.0) - wrong).alias("belief")
        )
        seeds = edges.filter("seed").select("value", "kind").distinct().withColumn("belief", F.lit(1.0))
        believed = stored(seeds.unionByName(new.join(seeds, ["value", "kind"], "left_anti")), "pii-belief")
    return believed.filter((F.col("belief") < 1) & (F.col("belief") >= trust)).select("value", "kind")


def discovered(found: DataFrame, values: DataFrame) -> DataFrame:
    """``doc_id, mark, extra``: spans of the believed values, per distinct text of a document."""
    flat = found.select("doc_id", "mark", F.explode("found").alias("i")).filter(~F.col("i.seed"))
    met = flat.select("doc_id", "mark", "i.start", "i.kind", "i.end", "i.value").join(values, ["value", "kind"], "left_semi")
    spans = F.collect_set(F.struct("start", "kind", "end")).alias("extra")  # at most the tokens of one text
    return met.groupBy("doc_id", "mark").agg(spans)


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans``: the seeds, and all spans, as arrays of (start, kind, end)."""
    found = stored(contexts(docs, doc_id, text), "pii-contexts")
    extra = discovered(found, bootstrap(found)).withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    seeds = F.transform(F.filter("found", lambda i: i["seed"]), lambda i: F.struct(i["start"], i["kind"], i["end"]))
    base = found.select("doc_id", "mark", seeds.alias("base"))
    met = base.join(extra, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return met.select("doc_id", "base", every.alias("spans"))


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; a null text stays null."""
    found = stored(contexts(docs, doc_id, text), "pii-contexts")
    extra = discovered(found, bootstrap(found)).withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.md5(F.col(text).cast("binary")).alias("m"))
    met = held.join(extra, F.col("id").eqNullSafe(F.col("__id")) & (F.col("m") == F.col("__mark")), "left")
    met = met.select("row", F.col("row")[text].alias("text"), "extra")
    schema = T.StructType([met.schema["row"], T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, more = part.column("text").to_pylist(), part.column("extra").to_pylist()
                new = [None if t is None else mask(t, e) for t, e in zip(texts, more)]
                yield pa.RecordBatch.from_arrays([part.column("row").cast(arrow[0].type), pa.array(new, pa.string())], schema=arrow)

    out = met.mapInArrow(run, schema)
    return out.select(*[(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def mask(text: str, extra: list[dict] | None) -> str:
    """Text with its spans replaced; of overlapping spans the first stands for the stretch."""
    every = sorted(strict(text) + [(e["start"], e["kind"], e["end"]) for e in extra or ()])
    out, at = [], 0
    for start, kind, end in every:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def listed(column: str) -> Column:
    """kind:start:end, comma-joined, in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(column, one), ",")


@query("op3_pii")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rows = spans(table(spark, folder, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select(
        "doc_id", *[count(k) for k in range(4)], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )
