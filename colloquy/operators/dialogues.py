"""Contexts, history windows and token budgets over message rows.

A dialogue of any length is rows ``(keys, pos, role, content)``. Ranks and sums are built in blocks of
``pos`` (see ``ordinals``), so one dialogue that holds most of the rows spreads over many tasks, and
no dialogue is ever one value. The Column builders of ``functions.messages`` do the same within a row, for
contexts that are bounded anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ordinals import rank_rows, running_total


def clean_rows(rows: DataFrame) -> DataFrame:
    """Messages that have a role and a content."""
    return rows.filter((F.col("role") != "") & F.col("content").isNotNull())


def drop_trailing_assistant_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Without a dialogue's last message where the assistant said it."""
    last = rows.groupBy(*keys).agg(F.max_by("role", "pos").alias("__role"), F.max("pos").alias("__last"))
    said = last.filter(F.col("__role") == "assistant").select(*keys, F.col("__last").alias("pos"))
    return rows.join(said, [*keys, "pos"], "left_anti")


def _measured(rows: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Adds ``__n`` (messages), ``__head`` (whether this is a leading system message), ``__system`` (whether
    the dialogue has one), ``__size``, ``__headsize`` and ``__total`` (the sizes of all but the head)."""
    sized = rows.withColumn("__size", size.cast("bigint"))
    whole = sized.groupBy(*keys).agg(
        F.min("pos").alias("__first"),
        F.count(F.lit(1)).alias("__n"),
        F.sum("__size").alias("__all"),
        F.min_by("role", "pos").eqNullSafe("system").alias("__system"),
        F.min_by("__size", "pos").alias("__firstsize"),
    )
    met = sized.join(whole, keys)
    head = F.when(F.col("__system"), F.col("__firstsize")).otherwise(0)
    return met.withColumns(
        {
            "__head": F.col("__system") & (F.col("pos") == F.col("__first")),
            "__headsize": head.cast("bigint"),
            "__total": F.col("__all") - head,
        }
    )


def trim_history_rows(rows: DataFrame, keys: list[str], limits: list[int], out: str = "lim") -> DataFrame:
    """For each limit, the messages of a history window: a leading system message and the last ones.

    A limit that isn't positive keeps all, and so does one the system message alone would fill.
    """
    ranked = rank_rows(_measured(rows, keys, F.lit(0)), keys, ["pos"], "__rank")
    spread = ranked.withColumn(out, F.explode(F.array(*[F.lit(n).cast("bigint") for n in limits])))
    room = F.col(out) - F.col("__system").cast("int")
    whole = (F.col(out) <= 0) | (F.col("__n") <= F.col(out)) | (room == 0)
    kept = spread.filter(whole | F.col("__head") | (F.col("__n") - F.col("__rank") <= room))
    return kept.select(*keys, out, "pos", "role", "content")


def token_budget_rows(
    rows: DataFrame, keys: list[str], budgets: list[int], size: Column, fit_last: bool = False,
    tokens: Column | None = None, join: str = " ", out: str = "budget",
) -> DataFrame:
    """For each positive budget, the leading system message and the longest end whose sizes fit.

    ``size`` counts a message's tokens. With ``fit_last`` the last message is kept in any case, cut
    from the front to what fits of its ``tokens``.
    """
    measured = _measured(rows, keys, size)
    body = F.when(F.col("__head"), 0).otherwise(F.col("__size"))
    summed = running_total(measured, keys, ["pos"], body, "__upto")
    last = rank_rows(summed, keys, ["pos"], "__rank") if fit_last else summed.withColumn("__rank", F.lit(-1).cast("bigint"))
    spread = last.withColumn(out, F.explode(F.array(*[F.lit(n).cast("bigint") for n in budgets])))
    fits = F.col("__head") | (F.col("__headsize") + F.col("__total") - F.col("__upto") + F.col("__size") <= F.col(out))
    content = F.col("content")
    if not fit_last:
        return spread.filter(fits).select(*keys, out, "pos", "role", "content")
    final = F.col("__rank") == F.col("__n") - 1
    room = F.least(F.col("__size"), F.greatest(F.col(out) - F.col("__headsize"), F.lit(0)))
    cut = F.array_join(F.slice(tokens, F.size(tokens) - room.cast("int") + 1, room.cast("int")), join)
    shown = F.when(fits | (F.coalesce(content, F.lit("")) == ""), content).otherwise(cut)
    return spread.filter(fits | final).select(*keys, out, "pos", "role", shown.alias("content"))
