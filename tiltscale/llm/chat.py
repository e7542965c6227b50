r"""Chat formatting, with DataFrame functions only.

A conversation becomes one string. Each block of adjacent turns of one role is
``<turn:ROLE>TEXT<next>TEXT<end>\n``. Inside roles and texts ``\`` is written ``\b``,
``<`` is written ``\l`` and ``>`` is written ``\g``, so an angle bracket in the output is
always a mark of the template and every text reads back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT, END = "<turn:", ">", "<next>", "<end>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and end in code points, start from 0).

    Turns are sorted by turn, then role and text (nulls first), so ties and repeated rows
    have one order. A null text or role is empty; turns of a null conv_id form one
    conversation. The spans cover the escaped texts of role ``learn`` and nothing else;
    an empty text has an empty span. An empty table gives no rows; other columns are ignored.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # what stands before each text: the opening of a block, or the seam of two merged turns
    pieces = F.transform(
        "t",
        lambda x, i: F.struct(
            F.when((i > 0) & (F.get("t", i - 1)["role"] == x["role"]), F.lit(NEXT))
            .otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(OPEN), escape(x["role"]), F.lit(CLOSE)))
            .alias("mark"),
            escape(x["text"]).alias("text"),
            (x["role"] == learn).alias("learn"),
        ),
    )
    chats = chats.select("conv_id", pieces.alias("p"))
    formatted = F.concat(F.array_join(F.transform("p", lambda x: F.concat(x["mark"], x["text"])), ""), F.lit(END))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def walk(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["mark"])
        end = begin + F.length(x["text"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return chats.select("conv_id", formatted.alias("formatted"), F.aggregate("p", start, walk, lambda acc: acc["spans"]).alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text), loss_texts: what the strings hold, unescaped."""
    blocks = F.filter(F.split("formatted", OPEN), lambda b, i: i > 0)
    parsed = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                # the block without its end mark, cut after the role and at the seams
                F.split(F.substring_index(F.substring(b, F.instr(b, CLOSE) + 1, F.length(b)), END, 1), NEXT),
                lambda text: F.struct(unescape(F.substring_index(b, CLOSE, 1)).alias("role"), unescape(text).alias("text")),
            ),
        )
    )
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.select("conv_id", "formatted", parsed.alias("turns"), masked.alias("loss_texts"))
