"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, corpus-wide counted.

Tasks work on Arrow arrays. Token lists are flattened, parent indices tell the document, a cumulative sum of
token bytes less the document's base gives each token's end, and an Acero hash join on (document, end) finds
the pairs of occurrences that end together: the links. ``Table.group_by`` counts the linked id pairs of a task's
documents; Spark adds up these partial counts.

A document's links then meet the counts of their pairs. The pairs of the highest counts, at most ``BROADCAST_PAIRS``
(found from a histogram of counts), travel to the tasks as sorted arrays; the few links of all other pairs
are joined in a shuffle, so any number of pairs gives the same result.

Defined results: a null or empty text has no tokens, and neither has one whose joined token bytes differ from a
space and the text in either tokenizer (such as a text that itself holds U+2581): zeros and ''. Repeated rows and
null ids are documents of their own; they count in the corpus as often as they occur. An empty table gives no rows. Columns of
the input travel in a struct, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.llm.common import by_chunks, shared_bytes, stored, table, text_size
from colloquy.llm.registry import query

FOLDER = "/opt/tokenizers"
#: Characters of text in one chunk of a task.
CHUNK = 1 << 19
#: Pairs whose counts are sent to the tasks: 12 bytes each.
BROADCAST_PAIRS = 1 << 19
#: Words whose pieces a task remembers.
REMEMBERED = 200_000
#: Links counted by one group_by.
COUNTED = 1 << 21

_END = np.int64(1) << 33
_SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """A byte-level BPE given as a tokenizer file; special tokens' strings are plain text. A space goes before every text."""

    def __init__(self, file: bytes):
        self.file, self.spec = file, json.loads(file)

    @cached_property
    def entries(self) -> list[bytes]:
        letters = byte_letters()
        special = {t["id"]: t["content"] for t in self.spec["added_tokens"]}
        vocabulary = {i: t for t, i in self.spec["model"]["vocab"].items()}
        size = 1 + max([*vocabulary, *special])
        return [special[i].encode() if i in special else bytes(letters[c] for c in vocabulary.get(i, "")) for i in range(size)]

    @cached_property
    def by_words(self) -> bool:
        """Whether merges are in the order of their ids, texts are cut in the usual way and nothing else is done."""
        model = self.spec["model"]
        ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        first = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        more = [self.spec["normalizer"], model.get("ignore_merges", False), model["dropout"]]
        return ids == sorted(set(ids)) and more == [None, False, None] and first.items() <= self.spec["pre_tokenizer"].items()

    @cached_property
    def _encode(self):
        import tiktoken
        from tokenizers import Tokenizer

        if self.by_words:
            letters, special = byte_letters(), {t["content"] for t in self.spec["added_tokens"]}
            ranks = {bytes(letters[c] for c in t): i for t, i in self.spec["model"]["vocab"].items() if t not in special}
            # fixed value: how byte-level vocabularies cut texts
            words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            return tiktoken.Encoding("own", pat_str=words, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        general = Tokenizer.from_str(self.file.decode())
        general.encode_special_tokens = True
        return lambda text: general.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encode(" " + t) for t in texts]


class PieceTokenizer:
    """A SentencePiece model, which puts a space before a text."""

    def __init__(self, file: bytes):
        self.file = file

    @cached_property
    def model(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.file)

    @cached_property
    def pieces(self) -> list[str]:
        return self.model.id_to_piece(list(range(self.model.get_piece_size())))

    @cached_property
    def entries(self) -> list[bytes]:
        byte = [self.model.is_byte(i) for i in range(len(self.pieces))]
        return [bytes([int(p[3:5], 16)]) if b else p.replace(_SPACE, " ").encode() for p, b in zip(self.pieces, byte)]

    @cached_property
    def by_words(self) -> bool:
        """Whether pieces have spaces at their start only, and texts keep all their spaces."""
        kept = ["".join(self.model.encode(t, out_type=str)).replace(_SPACE, " ") == " " + t for t in ("a  b ", "  a", " ")]
        return all(kept) and all(re.fullmatch(f"{_SPACE}*[^{_SPACE}]*", p) for p in self.pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, sizes.sum()), sizes


class Aligner:
    """Both tokenizers, and what a chunk's alignment needs of their entries."""

    def __init__(self, a: ByteTokenizer, b: PieceTokenizer):
        self.a, self.b = a, b
        self._forget()

    def __getstate__(self):
        return self.a.file, self.b.file

    def __setstate__(self, files):
        self.__init__(ByteTokenizer(files[0]), PieceTokenizer(files[1]))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.memory = [(np.empty(0, np.int32), np.empty(0, np.int64)) for _ in range(2)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of both tokenizers: ids of all texts one after the other, and the tokens of each text.

        No token of theirs goes on over a single space between two other characters. So texts are cut there, and
        words that a task has met before are looked up.
        """
        if not (self.a.by_words and self.b.by_words):
            return [_flat(t.encode(texts)) for t in (self.a, self.b)]
        cut = [re.split(r"(?<=\S) (?=\S)", t) for t in texts]
        words = list(chain.from_iterable(cut))
        if len(self.known) > REMEMBERED:
            self._forget()
        new = list(set(words).difference(self.known))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum([len(w) for w in cut], dtype=np.int64)])
        out = []
        for i, tokenizer in enumerate((self.a, self.b)):
            more = _flat(tokenizer.encode(new))
            ids, counts = self.memory[i] = tuple(np.concatenate(x) for x in zip(self.memory[i], more))
            sizes = counts[numbers]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = np.arange(ends[-1]) + np.repeat((np.cumsum(counts) - counts)[numbers] - ends[:-1], sizes)
            out.append((ids[at], np.diff(ends[first])))
        return out

    @cached_property
    def bytes(self) -> tuple[pa.Array, pa.Array]:
        return pa.array(self.a.entries, pa.binary()), pa.array(self.b.entries, pa.binary())

    @cached_property
    def written(self) -> pa.Array:
        """Ids as text with what follows: ``,`` or ``|`` after ids of A; ``,``, ``;`` or nothing after ids of B."""
        n, m = len(self.a.entries), len(self.b.entries)
        return pa.array([f"{i}{s}".encode() for size, ends in ((n, ",|"), (m, [",", ";", ""])) for s in ends for i in range(size)], pa.binary())

    @property
    def base(self) -> int:
        return len(self.b.entries)

    def align(self, texts: list[str | None]) -> dict:
        """Columns ``n_a, n_b, n_groups, groups_sha256, links`` of the texts; links hold A id * (ids of B) + B id."""
        held = [i for i, t in enumerate(texts) if t]
        whole = [(" " + texts[i]).encode("utf-8", "surrogatepass") for i in held]
        encoded = self.encode([texts[i] for i in held])
        equal = [_joined_equal(entry, *x, whole) for entry, x in zip(self.bytes, encoded)]
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids)) for ids, sizes in encoded]
        if not all(same := [p and q for p, q in zip(*equal)]):  # others have no tokens, in either tokenizer
            held, lists = [h for h, s in zip(held, same) if s], [x.filter(pa.array(same)) for x in lists]
        a, b = (_Tokens(x, entry) for x, entry in zip(lists, self.bytes))
        left = pa.table({"end": a.ends, "a": a.ids})
        right = pa.table({"end": b.ends, "b": b.ids})
        met = left.join(right, "end", join_type="inner", use_threads=False).sort_by([("end", "ascending"), ("a", "ascending"), ("b", "ascending")])
        ends = met["end"].to_numpy()
        pairs = met["a"].to_numpy().astype(np.int64) * self.base + met["b"].to_numpy()
        cuts = ends[np.concatenate([[True], ends[1:] != ends[:-1]])] if len(ends) else ends
        docs = np.arange(len(held) + 1, dtype=np.int64) * _END
        out = {k: np.zeros(len(texts), np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        for name, values in (("n_a", a.sizes), ("n_b", b.sizes), ("n_groups", np.diff(np.searchsorted(cuts, docs))), ("n_links", np.diff(np.searchsorted(ends, docs)))):
            out[name][held] = values
        digests = [""] * len(texts)
        for i, digest in zip(held, self._digests(a, b, cuts, docs)):
            digests[i] = digest
        offsets = pa.array(np.concatenate([[0], np.cumsum(out["n_links"])]), pa.int32())
        return out | {"groups_sha256": digests, "links": pa.ListArray.from_arrays(offsets, pa.array(pairs, self.link_type))}

    @property
    def link_type(self) -> pa.DataType:
        return pa.int32() if len(self.a.entries) * self.base < 1 << 31 else pa.int64()

    def _digests(self, a: _Tokens, b: _Tokens, cuts: np.ndarray, docs: np.ndarray) -> list[str]:
        """The groups of each document, ids written out in order, hashed."""
        n, m = len(self.a.entries), len(self.b.entries)
        group = [np.searchsorted(cuts, np.asarray(t.ends)) for t in (a, b)]
        count = [np.bincount(g, minlength=len(cuts)) for g in group]
        before = [np.cumsum(c) - c for c in count]
        last = [np.concatenate([g[1:] != g[:-1], [True]]) if len(g) else g.astype(bool) for g in group]
        final = np.zeros(len(b.ids), bool)
        final[np.cumsum(b.sizes)[b.sizes > 0] - 1] = True
        which = np.empty(len(a.ids) + len(b.ids), np.int64)
        which[np.arange(len(a.ids)) + before[1][group[0]]] = np.asarray(a.ids) + n * last[0]
        which[np.arange(len(b.ids)) + (before[0] + count[0])[group[1]]] = 2 * n + np.asarray(b.ids) + m * (last[1].astype(np.int64) + final)
        written = self.written.take(pa.array(which))
        at = np.frombuffer(written.buffers()[1], np.int32, len(written) + 1) if len(written) else np.zeros(1, np.int32)
        data = memoryview(written.buffers()[2]) if len(written) else memoryview(b"")
        bounds = at[np.concatenate([[0], np.cumsum(a.sizes + b.sizes)])]
        return [hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(bounds[:-1], bounds[1:])]


class _Tokens:
    """Tokens of many documents: ids, and the place where each ends, as document * 2^33 + byte."""

    def __init__(self, lists: pa.ListArray, entry: pa.Array):
        self.ids = pc.list_flatten(lists)
        parent = pc.list_parent_indices(lists)
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.binary_length(entry).cast(pa.int64()).take(self.ids)
        total = pc.cumulative_sum(size).to_numpy(zero_copy_only=False)
        first = np.cumsum(self.sizes) - self.sizes
        base = np.concatenate([[0], total])[first]  # bytes of the documents before
        self.ends = pa.array(total - base[parent] + np.asarray(parent, np.int64) * _END)


def _joined_equal(entry: pa.Array, ids: np.ndarray, sizes: np.ndarray, whole: list[bytes]) -> list[bool]:
    if not len(ids):
        return [not w for w in whole]
    joined = entry.take(pa.array(ids))
    at = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)
    data = memoryview(joined.buffers()[2])
    bounds = at[np.concatenate([[0], np.cumsum(sizes)])]
    return [bytes(data[s:e]) == w for s, e, w in zip(bounds[:-1], bounds[1:], whole)]


def load(spark: SparkSession, a: str, b: str) -> Aligner:
    """The tokenizers of two files: a byte-level BPE (tokenizer file) and a SentencePiece model."""
    return Aligner(ByteTokenizer(shared_bytes(spark, a)), PieceTokenizer(shared_bytes(spark, b)))


def align(docs: DataFrame, text: str, aligner: Aligner, keep: list[str]) -> DataFrame:
    """``(serial, row, n_a, n_b, n_groups, n_links, groups_sha256, links)`` of every document, stored; ``row`` holds the columns kept."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    cut = docs.select(F.monotonically_increasing_id().alias("serial"), row.alias("row"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(aligner)
    link = T.LongType() if aligner.link_type == pa.int64() else T.IntegerType()
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([*cut.schema.fields[:2], *[T.StructField(c, T.LongType()) for c in counts], T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.ArrayType(link))])

    def make(rows: list[dict]) -> dict:
        return {"serial": [r["serial"] for r in rows], "row": [r["row"] for r in rows]} | shared.value.align([r["text"] for r in rows])

    return stored(by_chunks(cut, make, schema, text_size(), CHUNK), "alignment")


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """``(pair, count, best)`` of every linked id pair: its links, and whether no pair of its B id has more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted(values: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            links = pa.table({"pair": pa.chunked_array(values).cast(pa.int64())})
            out = links.group_by("pair", use_threads=False).aggregate([([], "count_all")])
            yield from out.select(["pair", "count_all"]).rename_columns(["pair", "n"]).combine_chunks().to_batches()

        for batch in batches:
            held.append(pc.list_flatten(batch.column(0)))
            size += len(held[-1])
            if size >= COUNTED:
                yield from counted(held)
                held, size = [], 0
        if size:
            yield from counted(held)

    total = aligned.select("links").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    total = stored(total, "pair-counts")
    best = total.groupBy((F.col("pair") % base).alias("b")).agg(F.max("count").alias("most"))  # a row for each id of B
    with_best = total.withColumn("b", F.col("pair") % base).join(best, "b")
    return stored(with_best.select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-best")


def most_linked(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs of at least the returned count, at most ``limit`` of them: sorted pairs, counts, best."""
    level = F.length(F.bin("count"))  # at most 63 levels: powers of two
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = 64, 0
    while least > 1 and total + sizes.get(least - 1, 0) <= limit:
        least -= 1
        total += sizes.get(least, 0)
    floor = 1 << (least - 1)
    top = counts.filter(F.col("count") >= floor) if floor < 1 << 63 else counts.limit(0)
    got = top.orderBy("pair").toArrow().combine_chunks()
    return *(got[c].to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")), floor


def link_totals(aligned: DataFrame, counts: DataFrame, limit: int = BROADCAST_PAIRS) -> DataFrame:
    """The aligned documents without their links, with ``n_best`` and ``count_sum`` over the links."""
    spark = aligned.sparkSession
    pairs, numbers, best, floor = most_linked(counts, limit)
    shared = spark.sparkContext.broadcast((pairs, numbers, best))
    fields = [f for f in aligned.schema.fields if f.name != "links"]
    partial = T.StructType([*fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("links", aligned.schema["links"].dataType)])
    arrow = to_arrow_schema(partial)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, numbers, best = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                links = batch.column("links")
                flat = pc.list_flatten(links).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(links).to_numpy(zero_copy_only=False))]).astype(np.int64)
                place = np.minimum(np.searchsorted(pairs, flat), len(pairs) - 1) if len(pairs) else np.zeros(len(flat), np.int64)
                found = pairs[place] == flat if len(pairs) else np.zeros(len(flat), bool)
                sums = []
                for values in (best, numbers):
                    total = np.concatenate([[0], np.cumsum(np.where(found, values[place], 0) if len(pairs) else found, dtype=np.int64)])
                    sums.append(pa.array(np.diff(total[ends])))
                left = np.concatenate([[0], np.cumsum(~found)])[ends]
                rest = pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(flat[~found], links.type.value_type))
                columns = [batch.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, *sums, rest], arrow)], schema=arrow)

    done = aligned.mapInArrow(look_up, partial)
    done = stored(done, "link-totals")
    rest = done.filter(F.size("links") > 0).select("serial", F.explode("links").alias("pair")).groupBy("serial", "pair").agg(F.count(F.lit(1)).alias("n"))
    rare = counts.filter(F.col("count") < floor) if floor < 1 << 63 else counts
    added = rest.join(rare, "pair").groupBy("serial").agg(F.sum(F.col("n") * F.col("count")).alias("__count"), F.sum(F.col("n") * F.col("best").cast("long")).alias("__best"))
    plus = lambda name, more: (F.col(name) + F.coalesce(F.col(more), F.lit(0))).alias(name)
    names = [f.name for f in fields]
    return done.join(added, "serial", "left").select(*names, plus("n_best", "__best"), plus("count_sum", "__count"))


def groups_of(docs: DataFrame, text: str, aligner: Aligner) -> DataFrame:
    """Every column of ``docs`` and ``groups``: the ids of both tokenizers and the byte range (of a space and the text) of each group."""
    schema = "row struct<{}>, groups array<struct<a:array<int>,b:array<int>,start:int,end:int>>".format(docs.schema.simpleString()[7:-1])
    shared = docs.sparkSession.sparkContext.broadcast(aligner)

    def make(rows: list[dict]) -> dict:
        aligner = shared.value
        out = []
        for r in rows:
            t = r["text"]
            ids = [x.encode([t])[0] if t else [] for x in (aligner.a, aligner.b)]
            ends = [np.cumsum([len(x.entries[i]) for i in own]).astype(int) for x, own in zip((aligner.a, aligner.b), ids)]
            whole = [b"".join(x.entries[i] for i in own) for x, own in zip((aligner.a, aligner.b), ids)]
            groups, at = [], [0, 0, 0]
            for end in np.intersect1d(*ends) if t and whole[0] == whole[1] == (" " + t).encode() else []:
                to = [int(np.searchsorted(e, end, "right")) for e in ends]
                groups.append({"a": ids[0][at[0] : to[0]], "b": ids[1][at[1] : to[1]], "start": at[2], "end": int(end)})
                at = [*to, int(end)]
            out.append(groups)
        return {"row": [r["row"] for r in rows], "groups": out}

    cut = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return by_chunks(cut, make, schema, text_size(), CHUNK).select("row.*", "groups")


@query("op13_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    aligner = load(spark, os.path.join(FOLDER, "byte_bpe_50k.json"), os.path.join(FOLDER, "piece_bpe_32k.model"))
    aligned = align(table(spark, folder, "documents"), "text", aligner, ["doc_id"])
    totals = link_totals(aligned, pair_counts(aligned, aligner.base))
    return totals.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
