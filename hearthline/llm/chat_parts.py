"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is a list of parts: text, image, audio or document. A visitor
flattens them in order: text is escaped, any other part becomes a placeholder and is
recorded as an attachment with its reference and expanded token count. A turn reads

    <turn>role<body>content</turn>

Backslash and ``<`` inside roles and texts become ``\\b`` and ``\\l``, so ``<`` occurs
in control strings alone and reading back is exact. The loss mask lists the text
parts of assistant turns as (segment, start, length), counted in code points inside
the turn's segment.

Rows of a conversation are ordered by turn, then role, then parts; nulls come first.
Null roles and texts are empty. A null conversation id is a conversation. A null list
of parts is an empty one. Repeated rows are repeated turns. Further columns are
ignored. A conversation is one output row, so it must fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that a placeholder stands for where the part names no number.
EXPANDED = {"image": 256, "audio": 500, "document": 1000}
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text starts one of the two codes, so the order is safe."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """Parts of a plain text message."""
    return F.array(
        F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))
    ).cast(f"array<{PART}>")


def _shown(part: Column) -> Column:
    placeholder = F.concat(F.lit("<"), F.coalesce(part["kind"], F.lit("document")), F.lit("/>"))
    return F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(placeholder)


def _expanded(part: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in EXPANDED.items() for x in pair))
    return F.coalesce(part["tokens"], F.get(F.map_values(F.map_filter(known, lambda k, _: k == part["kind"])), F.lit(0)).cast("long"), F.lit(0).cast("long"))


def _segment(turn: Column) -> Column:
    shown = F.transform(turn["parts"], _shown)
    head = F.concat(F.lit("<turn>"), escape(turn["role"]), F.lit("<body>"))
    before = lambda i: F.char_length(head) + F.char_length(F.array_join(F.slice(shown, F.lit(1), i), ""))
    marks = F.transform(shown, lambda text, i: F.struct(before(i).alias("start"), F.char_length(text).alias("length"), F.get(turn["parts"], i)["kind"].alias("kind")))
    return F.struct(
        F.concat(head, F.array_join(shown, ""), F.lit("</turn>")).alias("text"),
        F.when(turn["role"] == "assistant", F.filter(marks, lambda m: m["kind"] == "text")).otherwise(F.array_compact(F.array(F.lit(None).cast("struct<start:int,length:int,kind:string>")))).alias("marks"),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments per conversation of ``rows`` (conv_id, turn, role, parts)."""
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts")
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    built = turns.select("conv_id", "turns", F.transform("turns", _segment).alias("segments"))
    spans = F.flatten(
        F.transform(
            "segments",
            lambda s, i: F.transform(s["marks"], lambda m: F.struct(i.alias("segment"), m["start"].alias("start"), m["length"].alias("length"))),
        )
    )
    attached = F.flatten(
        F.transform(
            "turns",
            lambda t: F.transform(
                F.filter(t["parts"], lambda p: ~p["kind"].eqNullSafe(F.lit("text"))),
                lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens")),
            ),
        )
    )
    return built.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        attached.alias("attachments"),
    )


def segments(formatted: Column) -> Column:
    """The turns of a formatted conversation, without their ends."""
    return F.filter(F.split(formatted, "</turn>"), lambda s: s != "")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: texts without placeholders, unescaped."""
    def one(segment: Column) -> Column:
        body = F.regexp_replace(F.substring_index(segment, "<body>", -1), "<[^<>]*/>", "")
        role = F.replace(F.substring_index(segment, "<body>", 1), F.lit("<turn>"), F.lit(""))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(segments(formatted), one)


def loss_text(cut: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between; ``cut`` as made by ``segments``."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.get(cut, s["segment"]), s["start"] + 1, s["length"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted text says, read back from it."""
    cut = chats.select("conv_id", "formatted", "loss_spans", segments(F.col("formatted")).alias("cut"), read_turns(F.col("formatted")).alias("turns"))
    read = cut.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        loss_text(F.col("cut"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
