"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by (turn, role, text); adjacent turns of one role become
one block, and the blocks are concatenated:

    <|turn|>role<|says|>first text<|more|>second text<|end|>\\n

Control strings in roles and texts are escaped: every backslash is doubled, and a backslash is put after the first
character of a control string. Taking out one backslash of every backslash pair and every other backslash undoes it, so
a reader gets each text back, and no text can open or close a turn.

Defined results: null text or role counts as empty; null turns sort first; equal turns keep all copies, in order of role
and text; a null conv_id is a conversation of its own; extra columns are ignored; an empty table gives an empty result.
A conversation is one output value and so one row; its turns are sorted, and what follows is a pass over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, MORE, END = "<|turn|>", "<|says|>", "<|more|>", "<|end|>"
#: What a text must not contain as such: this template's own marks and those of common others.
CONTROL = (TURN, SAYS, MORE, END, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LOSS_ROLE = "assistant"


def _java(text: str) -> str:
    return re.sub(r"([\\\[\]|<>/])", r"\\\1", text)


def escape(text: Column, control=CONTROL) -> Column:
    marks = "|".join(f"(?<={_java(c[0])})(?={_java(c[1:])})" for c in control)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), marks, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE, control=CONTROL) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_mask.

    loss_mask tells for each block (block k starts at the k-th turn mark) what of it is trained on: where the first text of
    loss_role starts, in code points from the start of the block, and the lengths of its texts, between which stands MORE.
    A block of another role has no lengths."""
    piece = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    collected = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    place = F.sequence(F.lit(1), F.size("turns"))
    starts = F.filter(
        place, lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"])
    )
    collected = collected.withColumn("starts", starts)
    # Each run of one role: its first place and the place after its last.
    runs = F.zip_with(
        "starts",
        F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns") + 1)),
        lambda a, b: F.struct(a.alias("first"), b.alias("after")),
    )
    blocks = F.transform(
        runs,
        lambda run: F.struct(
            F.element_at("turns", run["first"])["role"].alias("role"),
            F.transform(F.slice("turns", run["first"], run["after"] - run["first"]), lambda t: escape(t["text"], control)).alias("texts"),
        ),
    )
    collected = collected.select("conv_id", F.size("turns").cast("long").alias("n_turns"), blocks.alias("blocks"))
    heads = lambda b: F.concat(F.lit(TURN), escape(b["role"], control), F.lit(SAYS))
    formatted = F.array_join(
        F.transform("blocks", lambda b: F.concat(heads(b), F.array_join(b["texts"], MORE), F.lit(END + "\n"))), ""
    )

    none = F.array().cast("array<int>")
    mask = F.transform(
        "blocks",
        lambda b: F.struct(
            F.length(heads(b)).alias("start"), F.when(b["role"] == loss_role, F.transform(b["texts"], lambda t: F.length(t))).otherwise(none).alias("lengths")
        ),
    )
    return collected.select("conv_id", "n_turns", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted conversation holds, in order: array of (role, text)."""
    blocks = F.filter(F.split(formatted, _java(TURN)), lambda b: b != "")
    # A block's role and texts are values of their own before the texts are gone through, so that a block is read once.
    read = F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.substring_index(b, SAYS, 1)).alias("role"),
            F.split(F.regexp_replace(F.substring_index(b, SAYS, -1), f"{_java(END)}\\n\\z", ""), _java(MORE)).alias("texts"),
        ),
    )
    return F.flatten(F.transform(read, lambda r: F.transform(r["texts"], lambda t: F.struct(r["role"].alias("role"), unescape(t).alias("text")))))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, in order and unescaped."""
    blocks = F.filter(F.split(formatted, f"(?={_java(TURN)})"), lambda b: b != "")
    texts = lambda b, m: F.split(F.substring(b, m["start"] + 1, F.length(b)), _java(MORE))
    # Of what follows the last text (the block's end) its length leaves nothing.
    return F.flatten(
        F.zip_with(
            blocks, mask, lambda b, m: F.when(F.size(m["lengths"]) > 0, F.zip_with(texts(b, m), m["lengths"], lambda t, n: unescape(F.substring(t, F.lit(1), n)))).otherwise(F.array().cast("array<string>"))
        )
    )


def chat_digests(chats: DataFrame) -> DataFrame:
    """Digests of what is read back from formatted conversations."""
    said = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(read_loss(F.col("formatted"), F.col("loss_mask")), "")
    return chats.select("conv_id", F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), said.alias("said"), trained.alias("trained"), "formatted").select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
