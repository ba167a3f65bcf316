"""Grouping of requests into batches, and their routing to slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.operators.ordinals import rank_rows

def request_batches(
    df: DataFrame, keys: list[str], order: list[str], size: int, out: str = "batch"
) -> DataFrame:
    """Number the requests of each key in chunks of ``size``; not positive means one chunk."""
    if size <= 0:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    ranked = rank_rows(df, keys, order, "__rank")
    return ranked.withColumn(out, F.expr(f"__rank div {size}")).drop("__rank")


def parameter_key(df: DataFrame, params: str) -> Column:
    """Text equal for equal sampling parameters; absent, NULL and zero ones count as their default."""
    have = {f.name for f in df.schema[params].dataType.fields}
    parts = []
    for name, default in V.SAMPLING_DEFAULTS.items():
        kind = "double" if isinstance(default, float) else "bigint"
        given = F.col(params)[name].cast(kind) if name in have else F.lit(None).cast(kind)
        parts.append(F.coalesce(F.nullif(given, F.lit(0).cast(kind)), F.lit(default).cast(kind)).alias(name))
    none = F.array().cast("array<string>")
    stop = F.coalesce(F.col(params)["stop"], none) if "stop" in have else none
    return F.to_json(F.struct(*parts, stop.alias("stop")))


def param_batches(
    df: DataFrame, params: str, order: list[str], max_batch: int, out: str = "batch", key: str = "params_key"
) -> DataFrame:
    """Batches of at most ``max_batch`` requests with equal sampling parameters.

    A few parameter sets may cover the table; the ranks are computed in blocks, so no
    set is gathered in one task.
    """
    return request_batches(df.withColumn(key, parameter_key(df, params)), [key], order, max_batch, out)
