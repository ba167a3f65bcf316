"""Stores for training rows, transcripts and accuracy records.

Training rows grow by appends in a keyed log (``keyed_log``).  A small table that is rewritten keeps numbered
versions: the new one is written next to the old, and readers take the newest that is complete.  So no path is
overwritten while it is being read, and a job that dies half-way leaves the old version in force.
"""

from __future__ import annotations

import warnings

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.hashing import message_hash, text_hash
from colloquy.functions.messages import count_words, normalise_messages, truncate_tail
from colloquy.functions.text import py_strip
from colloquy.schema import MESSAGES_DDL
from colloquy.session import Files
from colloquy.sources import json_list
from colloquy.sources.keyed_log import KeyedLog

HASH = "msg_hash"


class Snapshots:
    """Numbered versions of a table below one folder."""

    def __init__(self, spark: SparkSession, home: str, marker: str = "_SUCCESS"):
        self.home = home.rstrip("/")
        self._files = Files(spark, self.home)
        self._marker = marker

    def _versions(self) -> list[str]:
        return [n for n in self._files.children(self.home) if n.startswith("v") and n[1:].isdigit()]

    def current(self) -> str | None:
        for name in reversed(self._versions()):
            if self._files.exists(f"{self.home}/{name}/{self._marker}"):
                return f"{self.home}/{name}"
        return None

    def next(self) -> str:
        taken = self._versions()
        return f"{self.home}/v{int(taken[-1][1:]) + 1 if taken else 0:06d}"

    def retire(self, keep: int = 1) -> None:
        """Delete all complete versions but the newest ``keep``."""
        whole = [n for n in self._versions() if self._files.exists(f"{self.home}/{n}/{self._marker}")]
        for name in whole[:-keep]:
            self._files.delete(f"{self.home}/{name}")


def with_hash(rows: DataFrame, messages: str = "messages") -> DataFrame:
    """Add the message hash; messages kept as text are hashed as they are."""
    is_text = dict(rows.dtypes)[messages] == "string"
    hashed = text_hash(F.col(messages)) if is_text else message_hash(F.col(messages))
    return rows.withColumn(HASH, hashed)


def log_of(spark: SparkSession, home: str, file_format: str = "parquet", position: str = "last") -> KeyedLog:
    """The training rows below ``home``, keyed by message hash."""
    return KeyedLog(spark, home, HASH, file_format, position)


def read_store(spark: SparkSession, home: str, file_format: str = "parquet", schema=None) -> DataFrame | None:
    log = log_of(spark, home)
    if log.current():
        rows = log.read()
        if schema is None or rows is None:
            return rows
        return rows.select(*(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).names)
    version = Snapshots(spark, home).current()
    if version is None:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(file_format).load(version)


def append_distinct(
    rows: DataFrame,
    home: str,
    order: str,
    messages: str = "messages",
    file_format: str = "parquet",
    position: str = "last",
    sinks: Column | None = None,
) -> str | None:
    """Append rows to a table and keep the last row of each message hash.

    ``order`` orders the rows across appends (it may be a struct).  With
    ``position="first"`` a hash keeps the place of its first occurrence and the values of
    its last.  Rows without messages are rejected, with a count.  A table without
    a ``messages`` column is not deduplicated.  No rows: nothing is written.  Only the new rows
    are written; stored ones move when their bucket is compacted.  ``sinks`` names the
    table of each row where several tables are published together.
    """
    log = log_of(rows.sparkSession, home, file_format, position)
    seen = Observation()
    dedupes = messages in rows.columns
    if dedupes:
        # counted on the way through, without a pass of its own
        rows = rows.observe(seen, F.count_if(F.col(messages).isNull()).alias("rejected"))
        rows = with_hash(rows.filter(F.col(messages).isNotNull()), messages)
    part = log.append(rows, order, sinks=sinks)
    for table in log.current().tables if part else []:
        log.compact(table)
    if dedupes and (rejected := _observed(seen)):
        warnings.warn(f"{rejected} rows without messages rejected")
    return part


def _observed(seen: Observation) -> int:
    try:
        return seen.get["rejected"]
    except Py4JJavaError:  # the plan was known to be empty, and nothing was observed
        return 0


def append_new_only(rows: DataFrame, home: str, order: str, part: str, messages: str = "messages") -> str | None:
    """Append the rows whose hash is not stored, under the label ``part``; returns the folder they lie in.

    The hashes are tested against the filters of the stored parts; stored hashes are read only where a filter
    says that one may be there.  Running the same part again replaces its rows, so a job that was cut
    short can be repeated.
    """
    log = log_of(rows.sparkSession, home)
    hashed = with_hash(rows.filter(F.col(messages).isNotNull()), messages)
    keys = hashed.select(HASH).distinct().persist()
    try:
        known = log.known(keys, but=part)
        fresh = hashed if known is None else hashed.join(known, HASH, "left_anti").select(*hashed.columns)
        written = log.append(fresh, order, label=part)
    finally:
        keys.unpersist()
    log.compact()
    return written


def _prepared(rows: DataFrame, max_tokens: int, counter) -> DataFrame:
    """Messages normalised and, with a limit, truncated."""
    kind = dict(rows.dtypes).get("messages")
    if kind is None:
        return rows
    messages: Column = F.col("messages")
    if kind == "string":
        messages = normalise_messages(messages)
    elif kind != MESSAGES_DDL:
        messages = normalise_messages(F.to_json(messages, {"ignoreNullFields": "false"}))
    if max_tokens > 0:
        messages = truncate_tail(messages, max_tokens, counter)
    return rows.withColumn("messages", messages)


def write_shard(
    rows: DataFrame, folder: str, label: str, round_idx: int, max_tokens: int = 0, counter=count_words
) -> None:
    """Add one round's rows, not deduplicated, as partition ``label=/round=``; no rows, no files.

    Other partitions are not touched; writing a round again replaces it, so a repeated
    round does not double its rows.
    """
    if rows.isEmpty():
        return
    prepared = _prepared(rows.drop("label", "round"), max_tokens, counter)
    prepared.write.mode("overwrite").parquet(f"{folder}/label={label}/round={round_idx}")


def write_latest(
    rows: DataFrame, folder: str, label: str, round_idx: int, max_tokens: int = 0, counter=count_words
) -> str | None:
    """Keep only this round's rows; without rows the old ones stay."""
    versions = Snapshots(rows.sparkSession, folder)
    if rows.isEmpty():
        return versions.current()
    target = versions.next()
    (
        _prepared(rows, max_tokens, counter)
        .withColumns({"label": F.lit(label), "round": F.lit(round_idx)})
        .write.parquet(target)
    )
    versions.retire()
    return target


def dump_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_json(rows: DataFrame, path: str) -> None:
    """Add JSON lines, not deduplicated."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_accuracy_records(records: DataFrame, folder: str, tag: str, round_idx: int) -> None:
    """Accuracy records of one tag and round; writing them again replaces them."""
    (
        records.write.mode("overwrite")
        .option("ignoreNullFields", "false")
        .json(f"{folder}/tag={tag}/round={round_idx}")
    )


def transcripts(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """One nested record per episode.  An episode holds at most ``max_turns`` steps per role."""
    fields = (
        "turn_index", "student_response", "student_response_raw", "generator_message",
        "generator_message_raw", "teacher_target", "chat_completions",
    )
    step = F.struct(*fields)
    of = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, step)))
    nested = steps.groupBy("uid").agg(of("generator").alias("__g"), of("verifier").alias("__v"))
    trajectory = lambda name, col: F.struct(F.lit(name).alias("name"), F.col(col).alias("steps"))
    return tasks.join(nested, "uid").select(
        F.col("uid").alias("episode_id"),
        F.struct("uid", "question", "ground_truth").alias("task"),
        F.array(trajectory("generator", "__g"), trajectory("verifier", "__v")).alias("trajectories"),
    )


def write_by_role(rows: DataFrame, prefix: str, order: str) -> None:
    """Generator and verifier rows into the tables ``gen`` and ``ver`` below ``prefix``.

    Rows are written once, dealt by role, and one commit publishes both tables or none.
    """
    table = F.when(F.col("role") == "generator", "gen").when(F.col("role") == "verifier", "ver")
    append_distinct(rows.filter(table.isNotNull()), prefix, order, sinks=table)


def read_by_role(spark: SparkSession, prefix: str, table: str) -> DataFrame | None:
    """One of the tables of ``write_by_role``: ``gen`` or ``ver``."""
    return log_of(spark, prefix).read(table)


# ---- counts ------------------------------------------------------------------------------------


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a file or folder: Parquet from footers, JSON lines by non-blank line, a JSON list
    by its length. What is missing counts 0; what cannot be read raises."""
    files = Files(spark, path)
    if not files.exists(path):
        return 0
    if path.lower().endswith(".jsonl"):
        return spark.read.text(path).filter(py_strip(F.col("value")) != "").count()
    if path.lower().endswith(".json"):
        first = json_list.first_character(spark, path)
        if first == "[":
            return json_list.count_elements(spark, path)
        if first and not files.is_folder(path) and files.size(path) > LARGEST_JSON_VALUE:
            json_list.starts(spark, path)  # raises where it is not whole
            return 1
        return _count_json_documents(spark, path)
    if not files.is_folder(path):
        if path.lower().endswith(".parquet"):
            return spark.read.parquet(path).count()
        return spark.read.text(path).filter(py_strip(F.col("value")) != "").count()
    if not files.has_parquet(path):
        return 0
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(path)
        .count()
    )


#: JSON documents other than lists are parsed as one value up to this size; of larger ones the brackets are counted
LARGEST_JSON_VALUE = 1 << 28


def _count_json_documents(spark: SparkSession, path: str) -> int:
    text = spark.read.text(path, wholetext=True)
    value = F.try_parse_json("value")
    empty = F.to_json(value).isin("{}", "null", "false", "0", '""')
    counted = (
        F.when(value.isNull() | empty, 0).otherwise(1)
    )
    broken = F.count_if(value.isNull() & (py_strip(F.col("value")) != ""))
    found = text.agg(F.coalesce(F.sum(counted), F.lit(0)).alias("n"), broken.alias("broken")).first()
    if found["broken"]:
        raise ValueError(f"{path} is not JSON")
    return found["n"]


def count_messages(spark: SparkSession, *paths: str) -> int:
    """Rows over several Parquet paths, reading no column but ``messages``."""
    return spark.read.parquet(*paths).select("messages").count()
