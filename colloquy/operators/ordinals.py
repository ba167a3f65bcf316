"""Ranks and running totals that do not put one key into one task.

A plain ``row_number() over (partition by key order by x)`` sorts all rows of a key in
a single task, and without a key it sorts the whole table there.  That is fine while the
range of the order column bounds a key's rows.  Beyond that, the integer order column is
cut into blocks of a fixed width.  Rows are ranked inside their
block (a window over ``(key, block)``, so a hot key spreads over many tasks), block
totals are added up on their own (one row per block, pre-aggregated before the
shuffle), and the two are joined.  Results equal those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_WIDTH = 1 << 16
HISTOGRAM_BUCKETS = 1 << 16


def _plain_keys(df: DataFrame, keys: list[str], level: int) -> dict[str, Column]:
    """Two columns per key that are never NULL and together equal for equal keys.

    Window and join then name the same plain columns, so the rows' one shuffle serves
    both; a null-safe join condition would ask for another one.
    """
    types = dict(df.dtypes)
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    made: dict[str, Column] = {}
    for i, key in enumerate(keys):
        value = F.col(key)
        default = F.lit(0) if types[key] in numbers else F.lit("")
        if types[key] not in numbers:
            value = value.cast("string")
        made[f"__key{level}_{i}"] = F.coalesce(value, default)
        made[f"__none{level}_{i}"] = F.col(key).isNull()
    return made


def _levels_for(df: DataFrame, order: str, width: int) -> int:
    """How often to cut into blocks, from the range of the order column (one small job).

    None while a key cannot hold more than ``width`` rows; else as often as it takes to leave
    at most ``width`` blocks per key, however sparse the column.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    span = 0 if low is None else int(high) - int(low) + 1
    levels = 0
    while span > width:
        span = span // width + 1
        levels += 1
    return levels


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    width: int | None = None,
    levels: int | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the key up to and including this one.

    ``order[0]`` must be an integer column; the remaining columns break ties, and together
    with ``keys`` they must be unique.  Block totals are themselves added up the same way,
    ``levels`` deep; a plain window serves where its groups are bounded by ``width``.
    """
    width = width or BLOCK_WIDTH
    if levels is None:
        levels = _levels_for(df, order[0], width)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    if levels == 0:
        plain_window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*so_far)
        return df.withColumn(out, F.sum(value.cast("bigint")).over(plain_window))
    block, before, own = f"__block{levels}", f"__before{levels}", f"__value{levels}"
    plain = _plain_keys(df, keys, levels)
    placed = df.withColumns(
        {**plain, block: F.expr(f"CAST(`{order[0]}` AS BIGINT) div {width}"), own: value.cast("bigint")}
    )
    by, whole = list(plain), [*plain, block]
    totals = placed.groupBy(*whole).agg(F.sum(own).alias(own))
    summed = running_total(totals, by, [block], F.col(own), before, width, levels - 1)
    # the first block of a key needs no offset, so short keys never reach the join
    offsets = summed.withColumn(before, F.col(before) - F.col(own)).filter(F.col(before) != 0)
    inside = Window.partitionBy(*whole).orderBy(*order).rowsBetween(*so_far)
    local = placed.withColumn(out, F.sum(own).over(inside)).drop(own)
    return (
        local.join(offsets.drop(own), whole, "left")
        .withColumn(out, F.col(out) + F.coalesce(F.col(before), F.lit(0)))
        .select(*df.columns, out)
    )


def rank_rows(df: DataFrame, keys: list[str], order: list[str], out: str, **kw) -> DataFrame:
    """Add ``out``: the position, from 0, of the row among the rows of its key."""
    return running_total(df, keys, order, F.lit(1), out, **kw).withColumn(out, F.col(out) - 1)


def _cumulated(df: DataFrame, bucket: str, *more: Column) -> DataFrame:
    """Histogram of a bucket column with ``__upto``, the rows up to each bucket's end.

    At most 65,536 rows, whatever the table holds, so the plain window is harmless.
    """
    upto = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.groupBy(bucket)
        .agg(F.count(F.lit(1)).alias("__size"), *more)
        .withColumn("__upto", F.sum("__size").over(upto))
    )


def smallest(
    df: DataFrame,
    bucket: Column,
    order: list[Column],
    n: int,
    position: str | None = None,
) -> DataFrame:
    """The ``n`` first rows by ``order``, without gathering candidates in one task.

    ``bucket`` must be an integer in [0, 65,536) that never decreases along ``order``.  One
    small job on the bucket's own columns finds the bucket where the n-th row lies.  Only
    rows up to that bucket are shuffled, about ``n`` of them, and they are ranked bucket by
    bucket.  With ``position`` the rows taken are numbered from 0.
    """
    b, rank = "__bucket", "__rank"
    placed = df.withColumn(b, bucket.cast("int"))
    cumulated = _cumulated(placed, b)
    edge = cumulated.agg(
        F.min(F.when(F.col("__upto") >= n, F.col(b))).alias("bucket"),
        F.max(F.when(F.col("__upto") < n, F.col("__upto"))).alias("below"),
    ).first()
    if edge["bucket"] is None and position is None:
        return df  # no more rows than wanted
    last = HISTOGRAM_BUCKETS if edge["bucket"] is None else edge["bucket"]
    ranked = placed.filter(F.col(b) <= last).withColumn(
        rank, F.row_number().over(Window.partitionBy(b).orderBy(*order))
    )
    taken = ranked.filter((F.col(b) < last) | (F.col(rank) <= n - (edge["below"] or 0)))
    if position is None:
        return taken.select(*df.columns)
    starts = cumulated.filter(F.col(b) <= last).select(
        F.col(b), (F.col("__upto") - F.col("__size")).alias("__start")
    )
    return (
        taken.join(F.broadcast(starts), b)
        .withColumn(position, (F.col("__start") + F.col(rank) - 1).cast("bigint"))
        .select(*df.columns, position)
    )


def furthest_needed(df: DataFrame, bucket: Column, offset: str, n: int) -> int:
    """Greatest ``offset`` up to the end of the bucket where the n-th row lies (of all rows when
    there are fewer); -1 when none is needed."""
    placed = df.select(bucket.cast("int").alias("__bucket"), offset)
    needed = _cumulated(placed, "__bucket", F.max(offset).alias("__last")).filter(
        F.col("__upto") - F.col("__size") < n
    )
    return needed.agg(F.coalesce(F.max("__last"), F.lit(-1)).alias("reach")).first()["reach"]


def hash_bucket(key: Column) -> Column:
    """Bucket of a hexadecimal sort key: its first four digits."""
    return F.conv(F.left(key, F.lit(4)), 16, 10).cast("int")


def scaled_bucket(offset: Column, size: int) -> Column:
    """Bucket of an offset in [0, size)."""
    return F.floor(offset / F.lit(-(-max(size, 1) // HISTOGRAM_BUCKETS))).cast("int")


#: columns that tell where a row was read: its file, the block of the file, a number that ascends within the block
PLACE = ["__file", "__block", "__seq"]
#: blocks whose offsets are broadcast, about 100 bytes each
BROADCAST_BLOCKS = 1 << 17


def write_indexed(rows: DataFrame, folder: str, out: str = "source_idx") -> None:
    """Write rows with a dense index from 0 as a stored column, in the order of the files they were read from.

    The rows have the columns ``PLACE`` of a scan, numbered without gaps within a block. Counting them reads no other
    column (of Parquet, only footers); the offsets between blocks have one row per block, or per file of Parquet. Each
    row is written once. Storing the index lets later scans skip row groups by it.
    """
    file, block, seq = PLACE
    counted = rows.groupBy(file, block).agg(F.count(F.lit(1)).alias("__n"), F.min(seq).alias("__first"))
    up_to_here = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = (F.sum("__n").over(up_to_here) - F.col("__n") - F.col("__first")).alias("__start")
    counted.select(file, block, start).write.mode("overwrite").parquet(f"{folder}/starts")
    starts = rows.sparkSession.read.parquet(f"{folder}/starts")
    few = starts.count() <= BROADCAST_BLOCKS
    placed = rows.join(F.broadcast(starts) if few else starts, [file, block])
    indexed = placed.withColumn(out, F.col("__start") + F.col(seq)).drop(*PLACE, "__start")
    # beside a broadcast, rows stay in the order they are read in
    (indexed if few else indexed.sortWithinPartitions(out)).write.mode("overwrite").parquet(f"{folder}/rows")


def read_indexed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows")
