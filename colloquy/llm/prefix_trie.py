"""Conversation prefix trie: shared prefixes grouped exactly, tails of one conversation left where they are.

Every turn becomes two 64-bit hashes; the digest of a conversation's first d turns is the exclusive or of its
turns' hashes, each mixed with its depth, 128 bits in all. A count-min sketch over all digests (``LANES`` rows of
counters that stop at two) is built in the tasks, added up in Spark by slices and sent back as bits. An estimate
of one proves that a prefix occurs once: its node is written at once. Only prefixes that may be shared are shuffled, as
digests, and grouped exactly. Texts never travel.

Sums over subtrees run along conversations: a node's own share lies with its smallest member, so each member
of a node brings what it holds from that depth on. A conversation is worked on in blocks of ``BLOCK`` turns, so a very long
one spreads over many tasks; what very many conversations share (at most 1,000 nodes, those with a thousandth of the
rows or more) is broadcast, and all others meet in a shuffle.

The sketch has 2^16 to 2^26 counters a row, at least four for each prefix up to 2^24 prefixes: 25 MB of bits at most. With
more prefixes fewer tails are proven single; the result is the same.

Defined results: a null conversation id takes no part; null role or text is empty; turns ascend, null first, and rows of
one turn follow each other by role, then by their hashes; a conversation without turns (left) is a member of the root; no
conversations give no nodes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import stored, table
from colloquy.llm.registry import query
from colloquy.operators.ordinals import rank_rows

BLOCK = 4096
#: Rows of the sketch; counters in a slice of one.
LANES, SLICE = 3, 1 << 16
MOST_COUNTERS = 1 << 26
#: Digests that a task adds to the sketch at once.
HELD = 1 << 21
#: A node with this share of the rows travels to every task.
HEAVY = 1000
#: Characters of one piece of a list of conversations.
PIECE = 1 << 16

_NODE = ["depth", "d1", "d2"]


def turns_of(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(c, pos, a, b, words)``: the turns of every conversation, numbered from 0, as hashes; stored."""
    r, x = (F.coalesce(F.col(name), F.lit("")) for name in (role, text))
    hashed = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).cast("long").alias("turn"), r.alias("r"),
        F.xxhash64(F.lit(1), r, x).alias("a"), F.xxhash64(F.lit(2), x, r).alias("b"),
        F.size(F.regexp_extract_all(x, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long").alias("words"),
    )
    return stored(rank_rows(hashed, ["c"], ["turn", "r", "a", "b"], "pos").select("c", "pos", "a", "b", "words"), "trie-turns")


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation ``c - c % every``, then c's own after its first h.

    h is the CRC-32 of c in decimal digits modulo ``most``. Returns the turns (``c, block, depth, a, b, words, last``) and the
    conversations (``c, total``).
    """
    head = F.array_sort(F.collect_list(F.struct("pos", "a", "b", "words")))  # at most most - 1 turns
    heads = turns.filter((F.col("c") % every == 0) & (F.col("pos") < most - 1)).groupBy(F.col("c").alias("base")).agg(head.alias("head"))
    own = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    h = (F.crc32(F.col("c").cast("string")) % most).cast("int")
    based = own.withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % every).join(heads, "base", "left")
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,words:bigint>>"))
    convs = based.select("c", "n", "h", taken.alias("head"))
    total = F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = stored(convs.withColumn("total", total), "trie-conversations")
    blocks = convs.select("c", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {BLOCK}"))).alias("block"), "h", F.size("head").alias("m"), "total")
    placed = turns.withColumn("block", F.expr(f"pos div {BLOCK}")).join(blocks, ["c", "block"]).filter(F.col("pos") >= F.col("h"))
    first = convs.select("c", F.lit(-1).cast("long").alias("block"), F.posexplode("head").alias("pos", "t"), "total")
    rest = ["a", "b", "words"]
    rebuilt = first.select("c", "block", (F.col("pos") + 1).cast("long").alias("depth"), *[F.col(f"t.{x}") for x in rest], "total").unionByName(
        placed.select("c", "block", (F.col("pos") - F.col("h") + F.col("m") + 1).cast("long").alias("depth"), *rest, "total")
    )
    return rebuilt.withColumn("last", F.col("depth") == F.col("total")).drop("total"), convs.select("c", "total")


def along(df: DataFrame, order: list[Column], back: bool, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Add running aggregates of conversations ``c`` in order (blocks descending if ``back``): name -> ("sum" or "bit_xor", column).

    The stored ``df`` has a column ``block``; rows are ordered inside blocks, and blocks' totals are added up on their own.
    """
    fold = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    inside = Window.partitionBy("c", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = Window.partitionBy("c").orderBy(F.desc("block") if back else F.asc("block")).rowsBetween(Window.unboundedPreceding, -1)
    run = lambda how, column, window: F.expr(f"{how}({column})").over(window)
    totals = df.groupBy("c", "block").agg(*[F.expr(f"{how}({column})").alias(name) for name, (how, column) in values.items()])
    before = totals.select("c", "block", *[F.coalesce(run(how, name, blocks), F.lit(0)).alias(f"__{name}") for name, (how, _) in values.items()])
    local = df.withColumns({name: run(how, column, inside) for name, (how, column) in values.items()})
    whole = {name: fold[how](F.col(name), F.col(f"__{name}")) for name, (how, _) in values.items()}
    return local.join(before, ["c", "block"]).withColumns(whole).drop(*[f"__{name}" for name in values])


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """``(c, depth, d1, d2, p1, p2, words, last)``: every prefix by its digest, with its parent's; stored."""
    mixed = rebuilt.select("c", "block", "depth", F.xxhash64(F.lit(3), "depth", "a", "b").alias("z1"), F.xxhash64(F.lit(4), "b", "depth", "a").alias("z2"), "words", "last")
    mixed = stored(mixed, "trie-rebuilt")
    chained = along(mixed, [F.asc("depth")], False, {"d1": ("bit_xor", "z1"), "d2": ("bit_xor", "z2")})
    parent = {f"p{i}": F.col(f"d{i}").bitwiseXOR(F.col(f"z{i}")) for i in (1, 2)}
    return stored(chained.withColumns(parent).select("c", *_NODE, "p1", "p2", "words", "last"), "trie-prefixes")


class Sketch:
    """Which counters of a count-min sketch have reached two."""

    def __init__(self, counters: int, bits: np.ndarray):
        self.counters, self.bits = counters, bits

    @staticmethod
    def places(d1: np.ndarray, d2: np.ndarray, counters: int) -> Iterator[np.ndarray]:
        first, step = d1.astype(np.uint64), d2.astype(np.uint64) | np.uint64(1)
        for lane in range(LANES):
            yield ((first + np.uint64(lane) * step) & np.uint64(counters - 1)).astype(np.int64)

    def maybe_shared(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """False where the estimate is one, so that the digest occurs once at most."""
        out = np.ones(len(d1), bool)
        for lane, at in enumerate(self.places(d1, d2, self.counters)):
            out &= (self.bits[lane, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def sketched(digests: DataFrame) -> Sketch:
    """The sketch of all rows ``(d1, d2)``."""
    n = digests.count()
    counters = min(MOST_COUNTERS, max(SLICE, 1 << max(0, 4 * n - 1).bit_length()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def part(held: list) -> Iterator[pa.RecordBatch]:
            d1, d2 = (np.concatenate(x) for x in zip(*held))
            for lane, at in enumerate(Sketch.places(d1, d2, counters)):
                place, often = np.unique(at, return_counts=True)
                piece = place // SLICE
                starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
                for s, e in zip(starts, [*starts[1:], len(place)]):
                    offset, more = (place[s:e] % SLICE).astype(np.uint16), often[s:e] > 1
                    row = [[lane], [int(piece[s])], [offset[~more].tobytes()], [offset[more].tobytes()]]
                    kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["lane", "slice", "once", "more"])

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2)])
            size += batch.num_rows
            if size >= HELD:
                yield from part(held)
                held, size = [], 0
        if size:
            yield from part(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, None

        def done() -> pa.RecordBatch:
            bits = np.packbits(count > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([bits], pa.binary())], names=["lane", "slice", "bits"])

        for batch in batches:
            for lane, piece, once, more in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (lane, piece) != now:
                    if now:
                        yield done()
                    now, count = (lane, piece), np.zeros(SLICE, np.uint8)
                at = np.frombuffer(once, np.uint16)
                count[at] = np.minimum(count[at] + 1, 2)
                count[np.frombuffer(more, np.uint16)] = 2
        if now:
            yield done()

    partial = digests.select("d1", "d2").mapInArrow(add, "lane int, slice int, once binary, more binary")
    merged = partial.repartition("lane", "slice").sortWithinPartitions("lane", "slice").mapInArrow(merge, "lane int, slice int, bits binary")
    bits = np.zeros((LANES, counters // 8), np.uint8)
    for r in merged.toLocalIterator():  # LANES * counters / 8 bytes in all
        at = r["slice"] * SLICE // 8
        bits[r["lane"], at : at + SLICE // 8] = np.frombuffer(r["bits"], np.uint8)
    return Sketch(counters, bits)


def screened(paths: DataFrame) -> DataFrame:
    """The prefixes with ``maybe`` and ``parent_maybe``: whether they, and their parents, may be shared; stored."""
    shared = paths.sparkSession.sparkContext.broadcast(sketched(paths))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d1, d2, p1, p2 = (b.column(x).to_numpy(zero_copy_only=False).view(np.uint64) for x in ("d1", "d2", "p1", "p2"))
            root = b.column("depth").to_numpy(zero_copy_only=False) == 1  # its parent is the root, which all share
            more = [shared.value.maybe_shared(d1, d2), shared.value.maybe_shared(p1, p2) | root]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, more)], names=[*b.schema.names, "maybe", "parent_maybe"])

    schema = T.StructType([*paths.schema.fields, T.StructField("maybe", T.BooleanType()), T.StructField("parent_maybe", T.BooleanType())])
    return stored(paths.mapInArrow(probe, schema), "trie-screened")


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(depth, d1, d2, ends_sha256)`` of rows ``(depth, d1, d2, c)``: the hash of each node's ids, ascending, comma-joined.

    Ids are sorted by ranges of (node, id) and written out in pieces, so a node of very many ids spreads over tasks; the
    hash then runs over a node's pieces as they come, never holding them all.
    """
    piece, names = "depth long, d1 long, d2 long, first long, text string", ["depth", "d1", "d2", "first", "text"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            columns = [pa.array([v], pa.int64()) for v in (*now, held[0])] + [pa.array([",".join(map(str, held))], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for *node, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (node != now or size >= PIECE):
                    yield out()
                    held, size = [], 0
                now = node
                held.append(c)
                size += 12
        if held:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out() -> pa.RecordBatch:
            columns = [pa.array([v], pa.int64()) for v in now] + [pa.array([state.hexdigest()], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=[*_NODE, "ends_sha256"])

        for batch in batches:
            for *node, _, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if node == now:
                    state.update(b"," + text.encode())
                    continue
                if now:
                    yield out()
                now, state = node, hashlib.sha256(text.encode())
        if now:
            yield out()

    pieces = ends.select(*_NODE, "c").repartitionByRange(*_NODE, "c").sortWithinPartitions(*_NODE, "c").mapInArrow(write, piece)
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digest, "depth long, d1 long, d2 long, ends_sha256 string")


def with_parents(rows: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Rows with ``parent_conv_id``, the smallest member of their parent; nodes of ``least`` members or more are broadcast.

    A parent that the sketch proved single is no node: the row, of one member then, gets null.
    """
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("rep").alias("parent_conv_id"), "n")
    key = ["depth", "p1", "p2"]
    heavy, light = F.broadcast(parents.filter(F.col("n") >= least).drop("n")), parents.filter(F.col("n") < least).drop("n")
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(*key), key, "left_anti").join(light, key, "left"))


def trie(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    tested = screened(prefixes(rebuilt))
    zero = F.lit(0).cast("long")
    roots = convs.select("c", *[zero.alias(x) for x in [*_NODE, "p1", "p2", "words"]], (F.col("total") == 0).alias("last"))
    shared = tested.filter("maybe").drop("maybe", "parent_maybe").unionByName(roots)
    single = tested.filter("not maybe")
    grouped = shared.groupBy(*_NODE).agg(
        F.count(F.lit(1)).alias("n"), F.min("c").alias("rep"), F.count_if("last").alias("ends"),
        F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    nodes = stored(grouped, "trie-nodes")
    least = max(1000, (nodes.agg(F.sum("n")).first()[0] or 0) // HEAVY)  # at most 1,000 nodes have as many members

    none = F.lit(None).cast("long")
    share = nodes.select(F.col("rep").alias("c"), "depth", none.alias("d1"), none.alias("d2"), ((F.col("n") - 1) * F.col("words")).alias("tokens"), (F.col("ends") == F.col("n")).cast("long").alias("leaf"))
    tails = single.filter("last").select("c", "depth", none.alias("d1"), none.alias("d2"), zero.alias("tokens"), F.lit(1).cast("long").alias("leaf"))
    members = shared.select("c", *_NODE, zero.alias("tokens"), zero.alias("leaf"))
    held = stored(members.unionByName(share).unionByName(tails).withColumn("block", F.expr(f"depth div {BLOCK}")), "trie-shares")
    below = along(held, [F.desc("depth"), F.col("d1").isNull().desc()], True, {"saved": ("sum", "tokens"), "leaves": ("sum", "leaf")})
    child = F.lit(1).cast("long").alias("children")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2"), zero.alias("saved"), zero.alias("leaves"), child]
    counted = below.filter("d1 is not null").select(*_NODE, "saved", "leaves", zero.alias("children"))
    counted = counted.unionByName(nodes.filter("depth > 0").select(*up)).unionByName(single.filter("parent_maybe").select(*up))
    totals = counted.groupBy(*_NODE).agg(*[F.sum(x).alias(x) for x in ("saved", "leaves", "children")])

    no_ends = F.sha2(F.lit(""), 256)
    digests = ends_digests(shared.filter("last"))
    full = nodes.join(totals, _NODE).join(digests, _NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", no_ends))
    full = stored(full, "trie-full")
    final = [F.col("c").alias("conv_id"), "depth", "parent_conv_id", F.lit(1).cast("long").alias("n_convs"), (~F.col("last")).cast("long").alias("n_children")]
    final += [F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("c").cast("string"), 256)).otherwise(no_ends).alias("ends_sha256")]
    alone = single.filter("not parent_maybe").withColumn("parent_conv_id", F.col("c")).select(*final)
    border = with_parents(single.filter("parent_maybe"), nodes, least).select(*final)
    of_node = [F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children")]
    of_node += [F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256"]
    inner = with_parents(full.filter("depth > 0"), nodes, least).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "rep")).select(*of_node)
    top = full.filter("depth = 0").withColumn("parent_conv_id", none).select(*of_node)
    return top.unionByName(inner).unionByName(border).unionByName(alone)


def _oracle() -> str:
    """Prefixes as lists of hashed turns, the members of each node through its smallest one's path."""
    step = "xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)"  # fixed value: the polynomial of CRC-32
    return rf"""WITH RECURSIVE tab(b, i, v) AS (
  SELECT b, 0, b::BIGINT FROM range(256) r(b) UNION ALL SELECT b, i + 1, {step} FROM tab WHERE i < 8),
crcs AS (SELECT list(v ORDER BY b) AS t FROM tab WHERE i = 8),
walk(c, p, crc) AS (
  SELECT DISTINCT conv_id, 1, 4294967295::BIGINT FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT c, p + 1, xor(t[(xor(crc, ascii(substr(c::VARCHAR, p, 1))) & 255) + 1], crc >> 8) FROM walk, crcs WHERE p <= length(c::VARCHAR)),
convs AS (SELECT c, xor(crc, 4294967295::BIGINT) % 4 AS h FROM walk WHERE p = length(c::VARCHAR) + 1),
own AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT v.c, 0 AS part, o.pos, r, x FROM convs v JOIN own o ON o.c = v.c - v.c % 20 AND o.pos < v.h
  UNION ALL SELECT v.c, 1, o.pos, r, x FROM convs v JOIN own o ON o.c = v.c AND o.pos >= v.h),
paths AS (
  SELECT c, row_number() OVER w AS depth, list(sha256(r || chr(1) || x)) OVER w AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
    count(*) OVER (PARTITION BY c) AS total FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
members AS (
  SELECT c, depth, md5(array_to_string(k, ',')) AS k, CASE WHEN depth = 1 THEN '' ELSE md5(array_to_string(k[:-2], ',')) END AS up, words, depth = total AS last FROM paths
  UNION ALL SELECT c, 0, '', NULL, 0, NOT EXISTS (SELECT 1 FROM rebuilt b WHERE b.c = v.c) FROM convs v),
nodes AS (SELECT depth, k, any_value(up) AS up, min(c) AS rep, count(*) AS n, any_value(words) AS words, count(*) FILTER (last) AS ends,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM members GROUP BY depth, k),
below AS (SELECT m.depth, m.k, sum((q.n - 1) * q.words) AS saved, count(*) FILTER (q.ends = q.n) AS leaves
  FROM nodes q JOIN members m ON m.c = q.rep AND m.depth <= q.depth GROUP BY m.depth, m.k),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n FROM nodes GROUP BY depth, up)
SELECT q.rep AS conv_id, q.depth, p.rep AS parent_conv_id, q.n AS n_convs, coalesce(kids.n, 0) AS n_children, b.leaves AS n_leaves,
  b.saved::BIGINT AS saved_tokens, q.ends_sha256
FROM nodes q JOIN below b ON b.depth = q.depth AND b.k = q.k LEFT JOIN nodes p ON p.depth = q.depth - 1 AND p.k = q.up
LEFT JOIN kids ON kids.depth = q.depth AND kids.k = q.k"""


@query("op12_prefix_trie", _oracle())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    turns = turns_of(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    return trie(*with_shared_heads(turns))
