"""Builders over ``ARRAY<STRUCT<role, content>>`` columns: one row holds one dialogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import fixed_values as V
from colloquy.functions.text import bind, variant_kind
from colloquy.schema import MESSAGES_DDL

WORD_PATTERN = r"[^ \t\n\r\f\x0B]+"


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.cast("string").alias("role"), content.cast("string").alias("content"))


def messages_of(*items: Column) -> Column:
    return F.array(*items).cast(MESSAGES_DDL)


def no_messages() -> Column:
    return F.array().cast(MESSAGES_DDL)


def append(messages: Column, *items: Column) -> Column:
    return F.concat(messages, messages_of(*items))


def has_system_head(messages: Column) -> Column:
    return F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))


def clean_context(messages: Column) -> Column:
    """Messages with a role and a content, reduced to those two fields; never NULL."""
    usable = F.filter(messages, lambda m: (m["role"] != "") & m["content"].isNotNull())
    return F.coalesce(F.transform(usable, lambda m: message(m["role"], m["content"])), no_messages())


def drop_trailing_assistant(messages: Column) -> Column:
    return bind(
        messages,
        lambda c: F.when(
            F.try_element_at(c, F.lit(-1))["role"] == "assistant", F.slice(c, F.lit(1), F.size(c) - 1)
        ).otherwise(c),
    )


def repair_generator_context(context: Column, question: Column) -> Column:
    """A context that ends in a user turn: rebuilt when empty, completed when it does not."""
    opening = messages_of(message("system", F.lit(V.GENERATOR_SYSTEM)), message("user", question))
    return bind(
        context,
        lambda c: F.when(F.size(c) == 0, opening)
        .when(
            F.coalesce(F.try_element_at(c, F.lit(-1))["role"] != "user", F.lit(True)),
            append(c, message("user", question)),
        )
        .otherwise(c),
    )


def with_target(context: Column, target: Column) -> Column:
    return append(context, message("assistant", target))


def _last(messages: Column, count: Column) -> Column:
    """The last ``count`` elements; ``count`` may be 0."""
    return F.slice(messages, F.size(messages) - count + 1, count)


def trim_history(messages: Column, limit: int | Column) -> Column:
    """At most ``limit`` messages: the system head, if any, and the newest others.

    A limit of 1 on a history with a system head leaves it whole, as it always has.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit

    def window(m: Column) -> Column:
        head = has_system_head(m)
        return (
            F.when((limit <= 0) | (F.size(m) <= limit) | (head & (limit == 1)), m)
            .when(head, F.concat(F.slice(m, 1, 1), _last(m, limit - 1)))
            .otherwise(_last(m, limit))
        )

    return bind(messages, window)


# ---- token budgets -----------------------------------------------------------------


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def count_words(text: Column) -> Column:
    """The default additive token counter."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def token_budget(max_model_len: int | Column, max_new_tokens: int | Column) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.greatest(
        F.lit(V.TOKEN_BUDGET_FLOOR), as_col(max_model_len) - as_col(max_new_tokens) - V.TOKEN_BUDGET_MARGIN
    )


def _token_counts(messages: Column, counter, per_message: int) -> Column:
    return F.transform(
        messages,
        lambda m: F.coalesce(counter(F.coalesce(m["content"], F.lit(""))), F.lit(0)).cast("int") + F.lit(per_message),
    )


def _longest_fitting_tail(counts: Column, budget: Column) -> Column:
    """How many trailing counts sum to at most ``budget``; one pass from the end."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def step(acc: Column, n: Column) -> Column:
        total = acc["total"] + n
        fits = acc["open"] & (total <= budget)
        return F.struct(
            total.alias("total"),
            (acc["kept"] + F.when(fits, 1).otherwise(0)).alias("kept"),
            fits.alias("open"),
        )

    return F.aggregate(F.reverse(counts), start, step, lambda acc: acc["kept"])


def truncate_tail(
    messages: Column,
    max_tokens: int | Column,
    counter=count_words,
    per_message: int = 0,
    per_dialogue: int = 0,
    counts: Column | None = None,
) -> Column:
    """Drop the oldest messages after the system head until the dialogue fits.

    Whole messages only; may leave the head alone, or nothing.  ``counter`` must be
    additive over messages; a chat template's constants go in ``per_message`` and
    ``per_dialogue``.  A tokenizer that needs Python gives ``counts``, a column of the rows with
    the token count of each message (add it with a ``pandas_udf`` over the messages first).
    """
    limit = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens

    def fit(m: Column) -> Column:
        def cut(c: Column) -> Column:
            head = has_system_head(m)
            head_tokens = F.when(head, F.get(c, F.lit(0))).otherwise(0)
            body = F.when(head, F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c)
            kept = _longest_fitting_tail(body, limit - head_tokens - per_dialogue)
            tail = bind(kept, lambda k: _last(m, k))
            return F.when(head, F.concat(F.slice(m, 1, 1), tail)).otherwise(tail)

        given = (
            _token_counts(m, counter, per_message)
            if counts is None
            else F.transform(counts, lambda n: n.cast("int") + F.lit(per_message))
        )
        return F.when((limit <= 0) | (F.size(m) == 0), m).otherwise(bind(given, cut))

    return bind(messages, fit)


def fit_token_budget(
    messages: Column,
    budget: int | Column,
    tokens=words,
    join: str = " ",
    per_message: int = 0,
    per_dialogue: int = 0,
    token_lists: Column | None = None,
) -> Column:
    """Fit a prompt to a budget: drop the oldest messages, and if even the last does
    not fit, keep its longest tail that does.

    ``tokens`` maps a text to an array of tokens; ``join`` puts a tail back together.  A
    tokenizer that needs Python gives ``token_lists``, a column of the rows with the tokens of
    each message as text.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    count = lambda text: F.size(tokens(text))
    own_tokens = (lambda last: tokens(last["content"])) if token_lists is None else (
        lambda last: F.try_element_at(token_lists, F.lit(-1))
    )

    def fit(m: Column) -> Column:
        def cut(c: Column) -> Column:
            head = has_system_head(m)
            head_tokens = F.when(head, F.get(c, F.lit(0))).otherwise(0)
            body = F.when(head, F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c)
            room = limit - head_tokens - per_dialogue
            kept = _longest_fitting_tail(body, room)
            head_only = F.when(head, F.slice(m, 1, 1)).otherwise(no_messages())

            def shorten(last: Column) -> Column:
                # an empty content has nothing to cut
                keep = F.greatest(room - per_message, F.lit(0))
                content = F.when(
                    F.coalesce(last["content"], F.lit("")) == "", last["content"]
                ).otherwise(
                    bind(
                        own_tokens(last),
                        lambda tk: F.array_join(_last(tk, F.least(F.size(tk), keep.cast("int"))), join),
                    )
                )
                return message(last["role"], content)

            return (
                F.when(F.size(body) == 0, head_only)
                .otherwise(
                    bind(
                        kept,
                        lambda k: F.when(k > 0, F.concat(head_only, _last(m, k))).otherwise(
                            F.concat(head_only, messages_of(shorten(F.try_element_at(m, F.lit(-1)))))
                        ),
                    )
                )
            )

        given = (
            _token_counts(m, count, per_message)
            if token_lists is None
            else F.transform(token_lists, lambda tk: F.size(tk) + F.lit(per_message))
        )
        return F.when((limit <= 0) | (F.size(m) == 0), m).otherwise(bind(given, cut))

    return bind(messages, fit)


# ---- shapes ----------------------------------------------------------------------------


def _variant_text(element: Column) -> Column:
    return F.try_variant_get(element, "$", "string")


def _described(items: Column) -> Column:
    """List elements with their kind, looked at once."""
    return F.transform(items, lambda e: F.struct(variant_kind(e).alias("kind"), e.alias("v")))


def _variant_message(element: Column) -> Column:
    as_object = message(
        F.try_variant_get(element["v"], "$.role", "string"), F.try_variant_get(element["v"], "$.content", "string")
    )
    as_text = message("user", _variant_text(element["v"]))
    return F.when(element["kind"] == "O", as_object).otherwise(as_text)


def _variant_messages(element: Column) -> Column:
    """Messages one list element stands for."""

    def nested(items: Column) -> Column:
        joined = F.array_join(F.transform(items, lambda x: _variant_text(x["v"])), " ", "None")
        return F.when(
            F.forall(items, lambda x: x["kind"] == "O"), F.transform(items, _variant_message)
        ).otherwise(messages_of(message("user", joined)))

    return F.when(
        element["kind"] == "A", bind(_described(F.try_variant_get(element["v"], "$", "array<variant>")), nested)
    ).otherwise(messages_of(_variant_message(element)))


def normalise_messages(text: Column) -> Column:
    """Messages of any JSON shape, held as text, into a non-empty message array.

    Arrays of objects, the usual shape, go through ``from_json``; only texts it
    rejects are parsed as variants.
    """
    usual = F.transform(
        F.from_json(text, MESSAGES_DDL), lambda m: F.coalesce(m, message("user", F.lit(None)))
    )

    def unusual(v: Column) -> Column:
        # a lone value is a list of one
        items = F.when(variant_kind(v) == "A", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
        return F.when(v.isNull(), messages_of(message("user", text))).otherwise(
            F.flatten(F.transform(_described(items), _variant_messages))
        )

    empty = messages_of(message(F.lit(None), F.lit(None)))
    parsed = F.coalesce(usual, bind(F.try_parse_json(text), unusual))
    return F.when(text.isNull(), empty).otherwise(
        bind(parsed, lambda m: F.when(F.size(m) == 0, empty).otherwise(m))
    )


