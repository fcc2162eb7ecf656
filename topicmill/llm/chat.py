"""Chat formatting by relational means.

A conversation's turns are collected as structs, sorted, and joined to one text:
adjacent turns of one role share a block, whose texts are parted by a mark. Texts
and roles are escaped so that no mark can occur inside them; ``read_back``
recovers the turns from the formatted text and its loss spans alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Every mark holds '#' or '<', which escaped texts never do.
OPEN, NAME_END, PART, CLOSE = "### ", ": ", "<next>", "</turn>\n"
#: In this order; the backslash comes first when escaping, and last when reading.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column, name: bool = False) -> Column:
    """``text`` without '#' and '<' (and ':' in a role's name), undone by ``unescape``."""
    for plain, coded in ESCAPES[: 4 if name else 3]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` (code points, end exclusive) of each conversation.

    Turns are ordered by ``turn``, then role and text where turns tie; null
    turns come first. Null texts and roles count as empty. Empty texts keep
    their turn. Repeated rows are turns of their own. Rows without a
    conversation id form one conversation. Other columns are not read.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("_t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))

    def pieces(ts: Column) -> Column:
        def piece(t: Column, i: Column) -> Column:
            goes_on = F.coalesce(F.get(ts, i - 1)["role"] == t["role"], F.lit(False))
            ends = ~F.coalesce(F.get(ts, i + 1)["role"] == t["role"], F.lit(False))
            head = F.when(goes_on, F.lit(PART)).otherwise(F.concat(F.lit(OPEN), escape(t["role"], name=True), F.lit(NAME_END)))
            return F.struct(
                head.alias("head"), escape(t["text"]).alias("body"), F.when(ends, F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"), (t["role"] == trained_role).alias("trained")
            )

        return F.transform(ts, piece)

    def spans(ps: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

        def step(acc: Column, p: Column) -> Column:
            begin = acc["at"] + F.length(p["head"])
            end = begin + F.length(p["body"])
            one = F.array(F.struct(begin.alias("start"), end.alias("end")))
            return F.struct((end + F.length(p["tail"])).alias("at"), F.when(p["trained"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(ps, start, step, lambda acc: acc["spans"])

    joined = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return (
        chats.select("conv_id", let(F.col("_turns"), pieces).alias("_pieces"))
        .select("conv_id", joined.alias("formatted"), spans(F.col("_pieces")).alias("loss_spans"))
    )


def read_back(chats: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (role and text structs), ``n_blocks`` and ``loss_text``, from formatted text and spans."""

    def block(b: Column) -> Column:
        name = F.substring_index(F.substring(b, len(OPEN) + 1, 1 << 30), NAME_END, 1)
        body = F.substring(b, F.lit(len(OPEN) + len(NAME_END) + 1) + F.length(name), F.lit(1 << 30))
        return F.transform(F.split(body, PART, -1), lambda t: F.struct(unescape(name).alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: F.length(b) > 0)
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.select("conv_id", "formatted", blocks.alias("_blocks"), F.array_join(loss, "").alias("loss_text")).select(
        "conv_id", "formatted", F.flatten(F.transform("_blocks", block)).alias("turns"), F.size("_blocks").cast("bigint").alias("n_blocks"), "loss_text"
    )
