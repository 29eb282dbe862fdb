"""Chat bodies: whole JSON documents of a chat, of which only the messages are known.

A body is taken apart as VARIANT, one level at a time, so fields this library has never
heard of pass through with their types. Only a body with something to clean is written
anew: its values are equal to the original's, numbers come in plain form and the keys of
inner objects in order. Any other body, a damaged one or null included, stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.text import strip_thinking

_OBJECT = "map<string,variant>"


def _text_of(message: Column, field: str) -> Column:
    """The field if it is text, else null."""
    path = F.lit(f"$.{field}")
    kind = F.schema_of_variant(F.try_variant_get(message, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(message, path, "string"))


def _cleaned(message: Column, role: str) -> Column:
    """The new content of a message that changes, else null."""
    content = _text_of(message, "content")
    new = strip_thinking(content)
    return F.when((_text_of(message, "role") == role) & (new != content), new)


def clean_message(message: Column, role: str = "assistant") -> Column:
    """A message without reasoning blocks, if it is of ``role`` and has text; else as it is.

    A list of parts, a missing content and anything that is no object stay.
    """
    new = _cleaned(message, role)
    fields = F.transform_values(
        message.try_cast(_OBJECT), lambda k, value: F.when(k == "content", new.cast("variant")).otherwise(value)
    )
    return F.when(new.isNotNull(), F.to_variant_object(fields)).otherwise(message)


def clean_body(body: Column, role: str = "assistant") -> Column:
    """The body with its assistant messages cleaned."""
    fields = F.from_json(body, _OBJECT)
    messages = fields["messages"].try_cast("array<variant>")
    affected = F.exists(messages, lambda m: _cleaned(m, role).isNotNull())
    new = F.to_variant_object(F.transform(messages, lambda m: clean_message(m, role)))
    written = F.to_json(F.transform_values(fields, lambda k, value: F.when(k == "messages", new).otherwise(value)))
    return F.when(affected, written).otherwise(body)


def clean(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Bodies with cleaned assistant messages; a projection, works on streams too."""
    return bodies.withColumn(column, clean_body(F.col(column)))
