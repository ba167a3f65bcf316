"""Text builders: every function takes and returns a Column, nothing runs in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import fixed_values as V

BOX = "\\boxed{"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_present(*cols: Column) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def variant_kind(value: Column) -> Column:
    """First letter of a variant's type: ``A``rray, ``O``bject, ``S``tring, …"""
    return F.left(F.schema_of_variant(value), F.lit(1))


def py_strip(col: Column) -> Column:
    return F.btrim(col, F.lit(V.PYTHON_WHITESPACE))


def final_verdict(text: Column) -> Column:
    """Verdict named by the last run of ASCII letters, or NULL.

    The text is reversed so that the anchored pattern reads only its tail.
    """
    tail = F.regexp_extract(F.reverse(F.lower(text)), r"^[^a-z]*([a-z]+)", 1)
    return (
        F.when(tail == V.VERDICT_WRONG[::-1], V.VERDICT_INCORRECT)
        .when(tail == V.VERDICT_CORRECT[::-1], V.VERDICT_CORRECT)
        .when(tail == V.VERDICT_INCORRECT[::-1], V.VERDICT_INCORRECT)
    )


def strip_think(text: Column) -> Column:
    """What follows the first closing think tag, stripped; the text itself without one."""
    return F.coalesce(py_strip(F.get(F.split(text, re.escape(V.THINK_CLOSE), 2), F.lit(1))), text)


def think_incomplete(text: Column) -> Column:
    return F.coalesce(
        F.contains(text, F.lit(V.THINK_OPEN)) & ~F.contains(text, F.lit(V.THINK_CLOSE)), F.lit(False)
    )


def boxed_first(text: Column) -> Column:
    """Content of the first non-empty box, up to its first closing brace."""
    return blank_to_null(F.regexp_extract(text, V.BOXED_FIRST_PATTERN, 1))


def boxed_last(text: Column) -> Column:
    """Content of the last box whose braces balance, however deep; NULL when none, or when it is empty.

    Boxes are tried from the last one back, so a text whose last box is whole reads only its tail.
    """
    boxes = F.size(F.split(text, re.escape(BOX))) - 1
    tail = lambda i: F.call_function("substring_index", text, F.lit(BOX), (-i).cast("int"))
    tried = F.aggregate(
        F.sequence(F.lit(1), boxes),
        F.lit(None).cast("string"),
        lambda found, i: F.coalesce(found, _up_to_closing_brace(tail(i))),
    )
    return blank_to_null(F.when(boxes > 0, tried))


def _up_to_closing_brace(text: Column) -> Column:
    """What comes before the brace that closes one opened before ``text``; NULL when none does."""
    pieces = F.regexp_extract_all(text, F.lit(r"[{}]|[^{}]++"), F.lit(0))

    def read(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        further = F.struct(depth.alias("depth"), (state["size"] + F.when(depth > 0, F.length(piece)).otherwise(0)).alias("size"))
        return F.when(state["depth"] > 0, further).otherwise(state)

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))
    inside = lambda state: F.when(state["depth"] == 0, state["size"])
    return bind(F.aggregate(pieces, start, read, inside), lambda size: F.substring(text, F.lit(1), size))


def extract_tag(text: Column, tag: str) -> Column:
    """Stripped content of the first ``<tag>…</tag>``, any case; NULL when absent."""
    pattern = rf"(?isu)<{re.escape(tag)}>(.*?)</{re.escape(tag)}>"
    return py_strip(F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0)))


def fixed_answer(text: Column) -> Column:
    return extract_tag(text, V.FIXED_ANSWER_TAG)


def question_snippet(question: Column) -> Column:
    flat = F.replace(py_strip(F.coalesce(question, F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.when(
        F.length(flat) > V.SNIPPET_LENGTH,
        F.concat(F.left(flat, F.lit(V.SNIPPET_KEEP)), F.lit(V.SNIPPET_ELLIPSIS)),
    ).otherwise(flat)


def routing_slot(key: Column, slots: int) -> Column:
    """Stable slot of a key: CRC-32 of its UTF-8 bytes, modulo the number of slots."""
    return F.pmod(F.crc32(F.encode(key, "utf-8")), F.lit(slots))


def round_robin(index: Column, slots: int) -> Column:
    return F.pmod(index, F.lit(slots))


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def split_key(split: str) -> str:
    """A split name made safe for paths."""
    return split.translate(str.maketrans({"/": "_", ":": "-", "[": None, "]": None}))


def to_record_json(record: Column) -> Column:
    """JSON text of a record with its NULL fields written out and non-ASCII kept."""
    return F.to_json(record, {"ignoreNullFields": "false"})
