"""Scans and the dataset registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.coerce import with_question_and_truth
from colloquy.functions.messages import (
    count_words,
    messages_of,
    message,
    normalise_messages,
    truncate_tail,
)
from colloquy.functions.text import py_strip, split_key
from colloquy.operators.ordinals import PLACE, read_indexed, write_indexed
from colloquy.operators.sampling import HAS_QUESTION, has_question
from colloquy.session import Files
from colloquy.sources import json_list
from colloquy.sources.store import Snapshots

JSON_SUFFIXES = (".json", ".jsonl")


def scan(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet or JSON by suffix, JSON as lines or as one list a file; a JSON schema that is known saves a
    pass over the data."""
    return scan_in_order(spark, path, schema).drop(*PLACE)


def scan_in_order(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """``scan`` with the place of every row: its file, the block it was read from, and a number that ascends within it."""
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    if not path.lower().endswith(JSON_SUFFIXES):
        place = [file, F.lit(0).cast("long"), F.col("_metadata.row_index")]
        return spark.read.parquet(path).select("*", *[x.alias(n) for x, n in zip(place, PLACE)])
    if json_list.first_character(spark, path) == "[":
        return _list_rows(spark, path, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    place = [file, block, F.monotonically_increasing_id()]
    return reader.json(path).select("*", *[x.alias(n) for x, n in zip(place, PLACE)])


def _list_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    found = json_list.elements(spark, path)
    if schema is None:
        texts = getattr(found.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        schema = DataFrame(spark._jsparkSession.read().json(texts), spark).schema
        if "_corrupt_record" in schema.names:
            raise json_list.NotAList(f"{path} holds elements that are not JSON objects")
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    place = [F.col(x).alias(n) for x, n in zip(("file", "block", "seq"), PLACE)]
    return found.select(row.alias("__row"), *place).select("__row.*", *PLACE)


def scan_shards(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below a folder, at any depth, with every column any of them has; a single
    file as it is."""
    if not Files(spark, path).is_folder(path):
        return spark.read.parquet(path)
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .option("mergeSchema", "true")
        .parquet(path)
    )


def scan_json_list(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON files that hold a list of objects each, read by many tasks, or one object over several lines."""
    if json_list.first_character(spark, path) in ("[", ""):
        return _list_rows(spark, path, schema).drop(*PLACE)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("multiLine", "true").json(path)


def scan_jsonl_tolerant(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with blank and malformed lines left out."""
    lines = spark.read.text(path).filter(well_formed(F.col("value")))
    return lines.select(F.from_json("value", schema).alias("__row")).select("__row.*")


def well_formed(line: Column) -> Column:
    """Whether a line is one JSON value and nothing else.

    Spark's parsers stop after the first value and ignore what follows.  Inside brackets
    and inside braces a trailing rest is an error in at least one of the two.
    """
    listed = F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1
    wrapped = F.try_parse_json(F.concat(F.lit('{"x":'), line, F.lit("}"))).isNotNull()
    return (py_strip(line) != "") & F.coalesce(listed & wrapped, F.lit(False))


def count_malformed(spark: SparkSession, path: str) -> int:
    """Lines ``scan_jsonl_tolerant`` leaves out although they are not blank."""
    lines = spark.read.text(path).filter(py_strip(F.col("value")) != "")
    return lines.filter(~well_formed(F.col("value"))).count()


def jsonl_for_training(
    spark: SparkSession, path: str, out: str, max_tokens: int = 0, counter=count_words, columns: str | None = None
) -> str:
    """Convert an SFT file of JSON lines to Parquet with normalised and truncated messages.

    A file without ``messages`` gets one empty message per row; anything but JSON lines
    is returned as it is.  ``columns`` is the DDL of the other columns where known.
    """
    if not path.lower().endswith(JSON_SUFFIXES):
        return path
    if columns is None:
        found = spark.read.json(path).schema
    else:
        found = T.StructType.fromDDL(columns).add("messages", T.StringType())
    # messages are read as JSON text, whatever their shape
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "messages" else f.dataType) for f in found.fields]
    )
    rows = spark.read.schema(as_text).json(path)
    if "messages" in found.names:
        messages = normalise_messages(F.col("messages"))
        if max_tokens > 0:
            messages = truncate_tail(messages, max_tokens, counter)
    else:
        messages = messages_of(message(F.lit(None), F.lit(None)))
    rows.withColumn("messages", messages).write.mode("overwrite").parquet(out)
    return out


# ---- registry ------------------------------------------------------------------------------


def _home(root: str, name: str, key: str) -> str:
    return f"{root}/{name}/split={key}"


def lookup(spark: SparkSession, root: str, name: str, split: str) -> tuple[DataFrame | None, str]:
    """A registered dataset and the split key it was found under; ``None`` when missing.

    The split is tried as it is, then in its path-safe form.
    """
    safe = split_key(split)
    for key in dict.fromkeys([split, safe]):
        if key and not any(c in key for c in "/:[]"):
            version = Snapshots(spark, _home(root, name, key), marker="rows/_SUCCESS").current()
            if version:
                return read_indexed(spark, version), key
    return None, safe


def register(
    spark: SparkSession,
    root: str,
    name: str,
    split: str,
    path: str | None = None,
    force: bool = False,
    schema=None,
) -> DataFrame:
    """Coerce a dataset once, number its rows in file order and keep it; every original column stays.

    A dataset already there is used as it is unless ``force`` is set.
    """
    existing, key = lookup(spark, root, name, split)
    if existing is not None and not force:
        return existing
    if not path:
        raise RuntimeError(f"dataset {name!r} (split {split!r}) is not registered and no path was given")
    versions = Snapshots(spark, _home(root, name, key), marker="rows/_SUCCESS")
    target = versions.next()
    coerced = with_question_and_truth(scan_in_order(spark, path, schema), name)
    # a narrow flag, so that sampling need not read the questions to find the empty ones
    flagged = coerced.withColumn(HAS_QUESTION, has_question(F.col("question")))
    write_indexed(flagged, target)
    versions.retire()
    return read_indexed(spark, target)
