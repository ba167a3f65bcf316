"""Coercion of raw dataset rows: question and ground truth from whatever is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import fixed_values as V
from colloquy.functions.text import bind, boxed_last, first_present, py_strip, variant_kind


def is_userish(role: Column) -> Column:
    return F.coalesce(F.lower(role).isin(*V.USER_ROLES), F.lit(False))


def has_text(content: Column) -> Column:
    return F.coalesce(content != "", F.lit(False))


def _first_content(messages: Column, chosen) -> Column:
    return F.get(F.filter(messages, chosen), F.lit(0))["content"]


def first_user_content(messages: Column) -> Column:
    return _first_content(messages, lambda m: (F.lower(m["role"]) == "user") & (m["content"] != ""))


def first_user_value(messages: Column) -> Column:
    """The first user message's content of any type, if it has one."""
    return _first_content(messages, lambda m: (F.lower(m["role"]) == "user") & m["content"].isNotNull())


def first_assistant_content(messages: Column) -> Column:
    """Content of the first assistant message, which may be empty or NULL."""
    return _first_content(messages, lambda m: m["role"] == "assistant")


def coerce_question(problem: Column, messages: Column) -> Column:
    """The problem unless blank, else the first user message with content."""
    return F.when(py_strip(problem) != "", problem).otherwise(first_user_content(messages))


def question_or_query(question: Column, query: Column) -> Column:
    return F.coalesce(F.nullif(question, F.lit("")), query)


def coerce_ground_truth(*candidates: Column) -> Column:
    return first_present(*candidates)


def coerce_ground_truth_deep(candidates, messages: Column, nested) -> Column:
    """Candidates, else the first assistant message's answer or text, else the nested candidates."""
    said = bind(
        first_assistant_content(messages),
        lambda c: F.coalesce(boxed_last(c), F.nullif(c, F.lit(""))),
    )
    return F.coalesce(first_present(*candidates), said, first_present(*nested))


# ---- question text from a union of shapes ----------------------------------------------


def question_from_messages(messages: Column, role_field: str = "role", content_field: str = "content") -> Column:
    """Last user-like message with content, else the last with any content, else ``''``."""
    said = F.filter(messages, lambda m: has_text(m[content_field]))
    asked = F.filter(said, lambda m: is_userish(m[role_field]))
    last = lambda a: F.try_element_at(a, F.lit(-1))[content_field]
    return F.coalesce(last(asked), last(said), F.lit(""))


def question_from_strings(texts: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(texts, lambda t: py_strip(t) != ""), F.lit(-1)), F.lit(""))


def _field(value: Column, keys) -> Column:
    """First non-empty field of an object variant among ``keys``."""
    return first_present(*[F.try_variant_get(value, f"$.{k}", "string") for k in keys])


def question_from_variant(value: Column) -> Column:
    """Question text of a string, an object, or a list of both."""

    def described(e: Column) -> Column:
        text = F.try_variant_get(e["v"], "$", "string")
        as_object = F.struct(
            is_userish(_field(e["v"], V.ROLE_KEYS)).alias("asks"), _field(e["v"], V.CONTENT_KEYS).alias("content")
        )
        as_text = F.struct(F.lit(True).alias("asks"), F.when(py_strip(text) != "", text).alias("content"))
        empty = F.struct(F.lit(False).alias("asks"), F.lit(None).cast("string").alias("content"))
        return F.when(e["kind"] == "O", as_object).when(e["kind"] == "S", as_text).otherwise(empty)

    def listed(items: Column) -> Column:
        kinds = F.transform(items, lambda e: F.struct(variant_kind(e).alias("kind"), e.alias("v")))
        said = F.filter(F.transform(kinds, described), lambda d: d["content"].isNotNull())
        return bind(
            said,
            lambda s: F.coalesce(
                F.try_element_at(F.filter(s, lambda d: d["asks"]), F.lit(-1))["content"],
                F.try_element_at(s, F.lit(-1))["content"],
                F.lit(""),
            ),
        )

    def single(v: Column) -> Column:
        return F.coalesce(
            F.when(is_userish(_field(v, V.ROLE_KEYS[:3])), F.coalesce(_field(v, V.CONTENT_KEYS), F.lit(""))),
            _field(v, V.SINGLE_QUESTION_KEYS),
            F.lit(""),
        )

    def question(x: Column) -> Column:
        return (
            F.when(x["kind"] == "A", listed(F.try_variant_get(x["v"], "$", "array<variant>")))
            .when(x["kind"] == "O", single(x["v"]))
            .otherwise(F.coalesce(F.try_variant_get(x["v"], "$", "string"), F.lit("")))
        )

    return bind(F.struct(variant_kind(value).alias("kind"), value.alias("v")), question)


def question_text(value: Column, kind: T.DataType) -> Column:
    """Question text of a column of any type: text as it is, strings, messages, objects or lists of them."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.when(value.isNotNull(), question_from_strings(value))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(value.isNotNull(), question_from_variant(F.parse_json(F.to_json(value))))
    if isinstance(kind, T.VariantType):
        return F.when(value.isNotNull(), question_from_variant(value))
    return value.cast("string")


# ---- rows with open schemas ----------------------------------------------------------------


def _as_text(value: Column, kind: T.DataType) -> Column:
    """Text of a value; lists and objects as JSON."""
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
    return F.to_json(value) if nested else value.cast("string")


def _truth_columns(df: DataFrame) -> list[Column]:
    return [_as_text(F.col(k), df.schema[k].dataType) for k in V.GROUND_TRUTH_KEYS if k in df.columns]


def _nested_truth_columns(df: DataFrame) -> list[Column]:
    """The same keys inside a ``content`` column, a struct or a variant."""
    kind = df.schema["content"].dataType if "content" in df.columns else None
    if isinstance(kind, T.StructType):
        return [_as_text(F.col("content")[k], kind[k].dataType) for k in V.GROUND_TRUTH_KEYS if k in kind.names]
    if isinstance(kind, T.VariantType):
        return [F.try_variant_get("content", f"$.{k}", "string") for k in V.GROUND_TRUTH_KEYS]
    return []


def with_question_and_truth(df: DataFrame, data_source: str, accept_question: bool = True) -> DataFrame:
    """Add ``question``, ``ground_truth`` and ``data_source`` to rows of any schema.

    Columns that are absent count as NULL.  With ``accept_question`` an existing
    ``question`` (or ``query``) column serves as the last fallback.
    """
    from colloquy.functions.messages import no_messages

    have = {f.name: f.dataType for f in df.schema.fields}
    text = lambda k: question_text(F.col(k), have[k]) if k in have else F.lit(None).cast("string")
    listed = have.get("messages")
    item = listed.elementType if isinstance(listed, T.ArrayType) else None
    is_chat = isinstance(item, T.StructType) and {"role", "content"} <= set(item.names)
    messages, asked = (F.col("messages"), None) if is_chat else (no_messages(), None)
    if is_chat and not isinstance(item["content"].dataType, T.StringType):
        asked = question_text(first_user_value(messages), item["content"].dataType)
        said = lambda m: F.struct(m["role"].alias("role"), _as_text(m["content"], item["content"].dataType).alias("content"))
        messages = F.transform(messages, said)
    question = coerce_question(text("problem"), messages)
    if asked is not None:
        question = F.when(py_strip(text("problem")) != "", text("problem")).otherwise(asked)
    if accept_question:
        question = F.coalesce(question, question_or_query(text("question"), text("query")))
    none = [F.lit(None).cast("string")]
    truth = coerce_ground_truth_deep(
        _truth_columns(df) or none, messages, _nested_truth_columns(df) or none
    )
    return df.withColumns(
        {"question": question, "ground_truth": truth, "data_source": F.lit(data_source)}
    )
