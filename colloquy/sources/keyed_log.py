"""A table of keyed rows that grows by appends and is never rewritten as a whole.

An append writes its own rows as a part, dealt into buckets by the first digit of their key's hash, and then one
manifest, the only thing that makes the part count. Readers take the newest manifest, and merge a key's rows where a bucket has
several parts. A bucket that has collected many parts, or more new rows than old ones, is compacted by itself: it is
merged into a part of its own, and the next manifest takes it from there.

Each part has a filter, one 64-bit word for every few keys, built by an aggregate as the part is written. New
keys are tested against these words first; stored keys are read only of the parts and buckets where a filter says
that they may be, and of none if it never does.

One manifest may hold several tables, so a commit can publish rows of all of them or none. A job that dies before its
manifest leaves a folder nobody reads; manifests are created and never overwritten, so of two writers that started from
the same one the second fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators.dedupe import keep_last, union_rows
from colloquy.session import Files, new_folder

BUCKET, SINK, LAST = "bucket_", "sink_", "last_"
BUCKETS = "0123456789abcdef"
#: Parts of one bucket beyond which it is compacted.
MOST_PARTS = 8
#: Bits of the filter for each key, and how many of a word's 64 bits a key sets.
KEY_BITS, SET_BITS = 12, 4


@dataclass
class Entry:
    """Rows of one table in one part: where, and how many in each bucket."""

    label: str
    path: str
    schema: str
    buckets: dict[str, int]
    format: str = "parquet"
    words: int = 0  # of the filter of each bucket; 0 for a table without keys


@dataclass
class Manifest:
    number: int = -1
    tables: dict[str, list[Entry]] = field(default_factory=dict)
    order: str = ""  # the column that orders a key's rows

    def text(self) -> str:
        return json.dumps({"order": self.order, "tables": {t: [vars(e) for e in own] for t, own in self.tables.items()}})

    def paths(self) -> set[str]:
        return {e.path for own in self.tables.values() for e in own}


class KeyedLog:
    """Tables of rows with a hash column ``key`` and an ``order``; the row of greatest order counts.

    With ``position="first"`` a row shows the order of its key's first occurrence and the values of its last. Small
    tables may do with one bucket, and without filters where nobody asks for membership.
    """

    def __init__(
        self, spark: SparkSession, home: str, key: str, file_format: str = "parquet", position: str = "last",
        one_bucket: bool = False, filters: bool = True,
    ):
        self.spark, self.home, self.key = spark, home.rstrip("/"), key
        self.format, self.position = file_format, position
        self.one_bucket, self.filters = one_bucket, filters
        self._files = Files(spark, self.home)

    # ---- manifests ---------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        names = self._files.children(f"{self.home}/log")
        return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]

    def _load(self, number: int) -> Manifest | None:
        try:
            held = json.loads(self._files.read_text(f"{self.home}/log/{number:08d}.json") or "")
        except ValueError:  # its writer died half-way: it never counted
            return None
        return Manifest(number, {t: [Entry(**e) for e in own] for t, own in held["tables"].items()}, held["order"])

    def current(self) -> Manifest | None:
        for number in reversed(self._numbers()):
            if found := self._load(number):
                return found
        return None

    def _bucket(self) -> Column:
        return F.lit("0") if self.one_bucket else F.left(self.key, F.lit(1))

    def _commit(self, manifest: Manifest, tables: dict[str, list[Entry]], order: str) -> Manifest:
        taken = self._numbers()
        new = Manifest(max([manifest.number, *taken]) + 1, tables, order)
        if taken and self._load(taken[-1]) and taken[-1] != manifest.number:
            raise RuntimeError(f"{self.home} has been written to since this append began")
        self._files.create_text(f"{self.home}/log/{new.number:08d}.json", new.text())
        self._retire(new, manifest)
        return new

    def _retire(self, new: Manifest, before: Manifest) -> None:
        """Delete what neither this manifest nor the one before, which readers may have open, refers to."""
        older = [n for n in self._numbers() if n < before.number]
        gone = set().union(*[m.paths() for n in older if (m := self._load(n))]) - new.paths() - before.paths()
        for path in gone:
            self._files.delete(f"{self.home}/{path}")
        for n in older:
            self._files.delete(f"{self.home}/log/{n:08d}.json")

    # ---- writing -----------------------------------------------------------------------------

    def append(self, rows: DataFrame, order: str, label: str = "", sinks: Column | None = None, tables: list[str] = ["rows"]) -> str | None:  # noqa: B006
        """Write rows as one part and commit it; returns the part's folder, or ``None`` when there are no rows.

        ``sinks`` names the table of each row, all written in one pass and published by one commit. Rows of a
        label that is there already replace its rows.
        """
        manifest = self.current() or Manifest()
        path, found = self._write(self._reduced(rows, order, sinks), sinks is not None)
        kept = {t: [e for e in own if not label or e.label != label] for t, own in manifest.tables.items()}
        replaced = kept != manifest.tables
        if not found and not replaced:
            self._files.delete(f"{self.home}/{path}" if manifest.number >= 0 else self.home)
            return None
        for table, entry in found.items():
            entry.label = label
            kept.setdefault(table or tables[0], []).append(entry)
        self._commit(manifest, kept, order)
        return f"{self.home}/{path}"

    def _reduced(self, rows: DataFrame, order: str, sinks: Column | None) -> DataFrame:
        """One row a key (and sink), in its bucket; reduced before the shuffle, so a key that many rows share is no hot key."""
        if sinks is not None:
            rows = rows.withColumn(SINK, sinks)
        if self.key not in rows.columns:
            return rows.withColumn(BUCKET, F.lit("0"))
        if self.position == "first":
            rows = rows.withColumn(LAST, F.col(order))
        return self._merged(rows, order, [SINK] if sinks is not None else []).withColumn(BUCKET, self._bucket())

    def _merged(self, rows: DataFrame, order: str, by: list[str]) -> DataFrame:
        first = LAST in rows.columns  # a table of first positions
        if not first and not by:
            return keep_last(rows, self.key, order)
        keys = [*by, self.key]
        rest = [c for c in rows.columns if c not in keys]
        values = F.max_by(F.struct(*rest), F.col(LAST if first else order)).alias("__row")
        best = rows.groupBy(*keys).agg(values, F.min(order).alias("__first"))
        value = lambda c: F.col("__first") if c == order and first else F.col("__row")[c]
        return best.select(*keys, *[value(c).alias(c) for c in rest]).select(*rows.columns)

    def _write(self, rows: DataFrame, by_sink: bool) -> tuple[str, dict[str, Entry]]:
        """(folder, entry of each table) of a new part with its filters."""
        path = f"parts/{uuid.uuid4().hex}"
        folders = [SINK, BUCKET] if by_sink else [BUCKET]
        keyed = self.key in rows.columns
        writer = rows.hint("rebalance", *folders).write.partitionBy(*folders).format(self.format)
        if self.format == "json":
            writer = writer.option("ignoreNullFields", "false")
        writer.save(f"{self.home}/{path}")
        schema = T.StructType([f for f in rows.schema.fields if f.name not in folders])
        placed = schema if not by_sink else T.StructType([*schema.fields, T.StructField(SINK, T.StringType())])
        whole = T.StructType([*placed.fields, T.StructField(BUCKET, T.StringType())])
        written = self.spark.read.schema(whole).format(self.format).load(f"{self.home}/{path}")
        counts = written.groupBy(*folders).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a bucket
        found: dict[str, Entry] = {}
        for r in counts:
            entry = found.setdefault(r[SINK] if by_sink else "", Entry("", path, schema.json(), {}, self.format))
            entry.buckets[r[BUCKET]] = r["n"]
        if keyed and found and self.filters:
            most = max(n for e in found.values() for n in e.buckets.values())
            words = 1 << max(0, (most * KEY_BITS // 64).bit_length())
            sink = F.col(SINK) if by_sink else F.lit("")
            bits = written.select(sink.alias(SINK), BUCKET, *_word(F.col(self.key), words)).groupBy(SINK, BUCKET, "word").agg(F.bit_or("bits").alias("bits"))
            bits.write.parquet(f"{self.home}/{path}/_filter")
            for entry in found.values():
                entry.words = words
        return path, found

    # ---- reading -----------------------------------------------------------------------------

    def _load_rows(self, places: list[tuple[str, Entry, str]]) -> DataFrame | None:
        """Rows of some buckets (table, entry, bucket); those of one schema are read at once."""
        by_schema: dict[tuple[str, str], list[str]] = {}
        for table, entry, bucket in places:
            sink = f"{SINK}={table}/" if table != "rows" else ""
            by_schema.setdefault((entry.schema, entry.format), []).append(f"{self.home}/{entry.path}/{sink}{BUCKET}={bucket}")
        read = None
        for (schema, file_format), paths in by_schema.items():
            rows = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).format(file_format).load(paths)
            read = rows if read is None else union_rows(read, rows)
        return read

    def _places(self, table: str, buckets: str | list[str] = BUCKETS, label: str | None = None) -> list[list[tuple[str, Entry, str]]]:
        """For each bucket that holds rows, its places."""
        entries = [e for e in (self.current() or Manifest()).tables.get(table, []) if label is None or e.label == label]
        return [places for b in buckets if (places := [(table, e, b) for e in entries if b in e.buckets])]

    def read(self, *tables: str, merge: bool = True, label: str | None = None) -> DataFrame | None:
        """All rows of a table (of several, where keys tell them apart), one a key.

        ``merge`` may be left out where appends never repeat a key. With a label, what its last append left of
        its rows (those that a compaction has not moved).
        """
        buckets = [own for t in tables or ["rows"] for own in self._places(t, label=label)]
        alone = [p for own in buckets if len(own) == 1 or not merge for p in own]
        several = [p for own in buckets if len(own) > 1 and merge for p in own]  # these meet by key
        found = [r for r in (self._load_rows(alone), self._load_rows(several)) if r is not None]
        if not found:
            return None
        if several and self.key in found[-1].columns:
            found[-1] = self._merged(found[-1], self.current().order, [])
        rows = found[0] if len(found) == 1 else union_rows(*found)
        return rows.drop(LAST)

    def labelled(self, label: str) -> list[str]:
        """Tables that hold rows appended under a label."""
        return [t for t, own in (self.current() or Manifest()).tables.items() if any(e.label == label for e in own)]

    def keys(self, places: list[tuple[str, Entry, str]]) -> DataFrame:
        return self._load_rows(places).select(self.key)

    # ---- membership --------------------------------------------------------------------------

    def known(self, keys: DataFrame, table: str = "rows", but: str = "") -> DataFrame | None:
        """Those of ``keys`` that are stored (under another label than ``but``); ``None`` where no filter has any.

        ``keys`` should be persisted: they are tested first, and compared only with what the filters leave.
        """
        manifest = self.current() or Manifest()
        entries = {e.path: e for e in manifest.tables.get(table, []) if e.words and (not but or e.label != but)}
        tested = None
        for path, entry in entries.items():
            bits = self.spark.read.schema(f"{SINK} string, {BUCKET} string, word long, bits long").parquet(f"{self.home}/{path}/_filter")
            bits = bits.filter((F.col(SINK) == ("" if table == "rows" else table)) & F.col(BUCKET).isin(list(entry.buckets))).withColumnRenamed("bits", "there")
            asked = keys.select(self.key, self._bucket().alias(BUCKET), *_word(F.col(self.key), entry.words))
            maybe = asked.join(bits, [BUCKET, "word"]).filter(F.col("there").bitwiseAND(F.col("bits")) == F.col("bits"))
            maybe = maybe.select(self.key, BUCKET, F.lit(path).alias("path"))
            tested = maybe if tested is None else tested.unionByName(maybe)
        if tested is None:
            return None
        tested = tested.persist()
        try:
            places = [(table, entries[r["path"]], r[BUCKET]) for r in tested.select("path", BUCKET).distinct().collect()]  # parts times 16
            if not places:
                return None
            stored = self.keys(places)
            found = new_folder(self.spark, "known-keys")
            tested.select(self.key).distinct().join(stored, self.key, "left_semi").write.parquet(found)
            return self.spark.read.schema(f"{self.key} string").parquet(found)
        finally:
            tested.unpersist()

    # ---- compaction --------------------------------------------------------------------------

    def due(self, table: str = "rows", most_parts: int = MOST_PARTS) -> list[str]:
        """Buckets with too many parts, or with more rows added than their largest part holds."""
        found = []
        for places in self._places(table):
            bucket, sizes = places[0][2], sorted(e.buckets[b] for _, e, b in places)
            if len(sizes) > most_parts or len(sizes) > 2 and sum(sizes[:-1]) > sizes[-1]:
                found.append(bucket)
        return found

    def compact(self, table: str = "rows", buckets: list[str] | None = None) -> list[str]:
        """Merge the buckets that are due into a part of their own; the others stay where they are."""
        manifest = self.current() or Manifest()
        buckets = self.due(table) if buckets is None else buckets
        places = [p for own in self._places(table, buckets) for p in own]
        if not places:
            return []
        rows = self._load_rows(places)
        if self.key in rows.columns:
            rows = self._merged(rows, manifest.order, []).withColumn(BUCKET, self._bucket())
        else:
            rows = rows.withColumn(BUCKET, F.lit("0"))
        by_sink = table != "rows"
        path, found = self._write(rows.withColumn(SINK, F.lit(table)) if by_sink else rows, by_sink)
        rest = []
        for e in manifest.tables[table]:
            left = {b: n for b, n in e.buckets.items() if b not in buckets}
            if left:
                rest.append(Entry(e.label, e.path, e.schema, left, e.format, e.words))
        self._commit(manifest, manifest.tables | {table: [*found.values(), *rest]}, manifest.order)
        return buckets


def _word(key: Column, words: int) -> list[Column]:
    """The word of a filter where a key belongs, and the bits that it sets there."""
    where, which = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(which, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(SET_BITS)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return [where.bitwiseAND(F.lit(words - 1).cast("long")).alias("word"), mask.alias("bits")]
