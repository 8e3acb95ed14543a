"""Chat formatting with DataFrame expressions only.

Layout of one conversation::

    <|turn|>user<|text|>first text<|next|>second text<|end|><|turn|>assistant<|text|>...<|end|>

Adjacent turns of one role share a ``<|turn|>`` block and are parted by ``<|next|>``.
A ``<|`` inside a role or text becomes ``<\\|`` (one backslash more if backslashes already
stand between), so a marker in the output is always a real marker and every text can be
read back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``turns`` needs ``conv_id, turn, role, text``; other columns are ignored. Turns are
    sorted by (turn, role, text), so ties and repeated rows come out in a fixed order and
    every row stays. A null role or text counts as empty, a null turn comes first, rows with
    a null ``conv_id`` form one conversation, and an empty table gives no rows.
    ``loss_spans`` holds (start, length) in code points of ``formatted``, one span for each
    turn of a role in ``loss_roles``, markers left out.
    """
    clean = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            escape(F.coalesce("role", F.lit(""))).alias("role"),
            escape(F.coalesce("text", F.lit(""))).alias("text"),
            F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("loss"),
        ).alias("t"),
    )
    sorted_turns = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def lead(t: Column, i: Column) -> Column:
        """The markers before turn i: none but <|next|> if it continues the block."""
        before = F.get("turns", i - 1)
        block = F.concat(F.lit(TURN), t["role"], F.lit(TEXT))
        return (
            F.when(i == 0, block)
            .when(before["role"] == t["role"], F.lit(NEXT))
            .otherwise(F.concat(F.lit(END), block))
        )

    merged = sorted_turns.select(
        "conv_id",
        F.transform("turns", lambda t, i: F.struct(lead(t, i).alias("lead"), t["text"].alias("text"), t["loss"].alias("loss"))).alias("pieces"),
    )

    def step(acc: Column, p: Column) -> Column:
        start, length = acc["at"] + F.char_length(p["lead"]), F.char_length(p["text"])
        span = F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"))
        return F.struct(
            (start + length).cast("long").alias("at"),
            F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit([]).cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return merged.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(END)).alias("formatted"),
        F.aggregate("pieces", zero, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation, as array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        parts = F.split(F.regexp_replace(block, r"<\|end\|>$", ""), r"<\|text\|>")
        return F.transform(
            F.split(parts[1], r"<\|next\|>"),
            lambda text: F.struct(unescape(parts[0]).alias("role"), unescape(text).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns_of))


def read_loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between the spans."""
    return F.array_join(
        F.transform(
            loss_spans,
            lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
        ),
        "",
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from ``format_conversations``, as counts and digests."""
    read = formatted.select(
        "conv_id",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        read_turns(F.col("formatted")).alias("turns"),
        read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
