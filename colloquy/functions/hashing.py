"""Message hash: SHA-1 of a canonical JSON text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import bind


def json_string(text: Column) -> Column:
    """JSON literal of one string (``null`` for NULL)."""
    return bind(
        F.to_json(F.array(text), {"ignoreNullFields": "false"}),
        lambda j: F.substr(j, F.lit(2), F.length(j) - 2),
    )


def canonical_messages(messages: Column) -> Column:
    """Messages as JSON with sorted keys and a blank after each comma and colon."""
    one = lambda m: F.concat(
        F.lit('{"content": '), json_string(m["content"]), F.lit(', "role": '), json_string(m["role"]), F.lit("}")
    )
    return F.concat(F.lit("["), F.array_join(F.transform(messages, one), ", "), F.lit("]"))


def message_hash(messages: Column) -> Column:
    """Hash of an array of messages."""
    return F.sha1(canonical_messages(messages))


def text_hash(text: Column) -> Column:
    """Hash of messages kept as plain text, which are hashed as they are."""
    return F.sha1(text)
