"""Chat transcripts: (conv_id, turn, role, content), one row per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.text import strip_thinking, with_default


def when_role(df: DataFrame, role: str, changed: Column, column: str = "content") -> DataFrame:
    """Change ``column`` in the messages of one role; all others pass as they are."""
    kept = F.col(column)
    return df.withColumn(column, F.when(F.col("role") == role, changed).otherwise(kept))


def clean(chat: DataFrame) -> DataFrame:
    """Assistant messages without reasoning blocks; works on streams too."""
    return when_role(chat, "assistant", strip_thinking(F.col("content")))


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Missing fields get their defaults."""
    return df.withColumns({c: with_default(F.col(c), value) for c, value in defaults.items()})
