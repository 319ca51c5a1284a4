"""Chat examples by perspective rotation: the dialogue once per participant, who is then the assistant."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.skew import attach


@dataclass(frozen=True)
class ChatFormat:
    """`context`: roles that take no part; they open no perspective and are shown as they are.
    `block_turns`: turn numbers per rendered block; a longer dialogue gives several blocks, so that no
    dialogue has to fit into one task. `nameless` stands for a null role."""

    context: tuple[str, ...] = ("system",)
    block_turns: int = 256
    nameless: str = "unknown"


DEFAULT_FORMAT = ChatFormat()


def escaped(text: Column) -> Column:
    """Text that cannot open or close a marker."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def rotate(chats: DataFrame, style: ChatFormat = DEFAULT_FORMAT) -> DataFrame:
    """`conv_id, block, perspective, n_turns, text, masks` for conversations `conv_id, turn, role, text`.

    For every participant of a conversation its turns are rendered with that participant as
    `<|assistant|>`, the others as `<|user name=...|>` and context roles as `<|role|>`, each turn closed by
    `<|end|>`. `masks` are the spans to train on, array<struct<begin, end>> in code points of `text`: the
    content and closing marker of each own turn. Turns are in the order turn, role, text (ties and repeated
    rows keep all their rows). Block k holds the turns with number k * block_turns and on.

    Null texts are empty, a null role is `nameless`, a null turn comes first in block 0. A null
    conversation is no conversation: each such row is a dialogue of its own. Conversations with context
    roles alone have no participant and give no row, nor does an empty table. Other columns are not read.
    """
    turns = chats.select(
        chats["conv_id"], chats["turn"].cast("long").alias("turn"),
        F.coalesce(chats["role"], F.lit(style.nameless)).alias("role"),
        F.coalesce(chats["text"], F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / style.block_turns).cast("long"))
    spoken = ~F.col("role").isin(*style.context) if style.context else F.lit(True)
    whole, alone = turns.filter("conv_id IS NOT NULL"), turns.filter("conv_id IS NULL")
    # who takes part anywhere in the conversation, one row each: distinct within tasks first
    parts = whole.filter(spoken).select("conv_id", F.col("role").alias("perspective")).distinct()
    entry = F.struct("turn", "role", "text")
    # collected per block, so a task holds at most the turns of a few blocks
    blocks = whole.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    single = alone.filter(spoken).select("conv_id", "block", F.array(entry).alias("turns"), F.col("role").alias("perspective"))
    rows = attach(blocks, parts, ["conv_id"], how="inner").select("conv_id", "block", "turns", "perspective")
    rows = rows.unionByName(single)
    shown = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"),
                 F.array().cast("array<struct<begin:int,end:int>>").alias("masks")),
        lambda acc, t: _add(acc, t, style),
    )
    rows = rows.withColumn("_shown", shown)
    return rows.select(
        "conv_id", "block", "perspective", F.size("turns").alias("n_turns"),
        F.array_join(F.col("_shown.pieces"), "").alias("text"), F.col("_shown.masks").alias("masks"),
    )


def _add(acc: Column, turn: Column, style: ChatFormat) -> Column:
    own = turn["role"] == F.col("perspective")
    context = turn["role"].isin(*style.context) if style.context else F.lit(False)
    name = F.regexp_replace(turn["role"], r"[^\p{L}\p{N}_.-]", "_")
    head = (
        F.when(own, F.lit("<|assistant|>\n"))
        .when(context, F.concat(F.lit("<|"), name, F.lit("|>\n")))
        .otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    )
    body = F.concat(escaped(turn["text"]), F.lit("<|end|>\n"))
    begin = acc["at"] + F.length(head)
    end = begin + F.length(body)
    span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
    return F.struct(
        end.alias("at"),
        F.concat(acc["pieces"], F.array(head, body)).alias("pieces"),
        F.when(own, F.concat(acc["masks"], span)).otherwise(acc["masks"]).alias("masks"),
    )


def mask_text(masks: Column) -> Column:
    """`begin-end` of each span, comma-joined."""
    spans = F.transform(masks, lambda m: F.concat_ws("-", m["begin"].cast("string"), m["end"].cast("string")))
    return F.array_join(spans, ",")
