"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.session import new_folder

#: Letters of ``A-Z`` to ``a-z``; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Text of one byte a character takes the quick way, with the same result."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared work folder and read it back: lineage ends there."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes, such as a tokenizer's, from any path or URI that Spark can read."""
    uri = path if "://" in path else f"file://{path}"
    return bytes(spark.read.format("binaryFile").load(uri).select("content").first()["content"])


def by_chunks(
    df: DataFrame,
    make: Callable[[list[dict]], list[dict]] | Callable,
    schema: T.StructType | str,
    size: Callable[[dict], int],
    limit: int,
) -> DataFrame:
    """Apply ``make`` to lists of rows of about ``limit`` units of ``size`` each, within every task.

    ``make`` gets a list of dicts and returns a dict of columns (name -> list or array). Only one
    list is in memory at a time; a row larger than the limit is a list of its own.

    Sets the session's Arrow batches to 1,000 rows: texts travel to the tasks' Python by rows, not by size.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out(some):
            cols = make(some)
            arrays = [c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, type=f.type) for f in arrow]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    rows.append(row)
                    held += size(row)
                    if held >= limit:
                        yield out(rows)
                        rows, held = [], 0
        if rows:
            yield out(rows)

    return df.mapInArrow(run, schema)


def text_size(column: str = "text") -> Callable[[dict], int]:
    """Size of a row by its text, with a share for the row itself."""

    def of(row: dict) -> int:
        return 64 + len(row[column] or "")

    return of
