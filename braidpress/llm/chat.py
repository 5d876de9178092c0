"""Chat formatting with relational operators only.

Turns are collected as structs, sorted, adjacent turns of one role are merged by array aggregation, and the
text is concatenated with Spark expressions. A block is

    <|im_start|>ROLE \\n TEXT [<|im_sep|> TEXT ...] <|im_end|> \\n

where ``<|im_sep|>`` parts the texts of merged turns, so that the turns can be read back. Inside roles and
texts every ``<``, any run of ``~``, ``|`` gets one more ``~``, so no control string can stand in them; a line
feed in a role is written ``<|nl|>``. Both are undone exactly on reading.

Results by case: null text or role is empty; a null id names no conversation, so each such row is one of a
single turn, and no group is collected from them; null turns sort first; repeated turns all stay, ordered by turn, role and text; a conversation is one output row, so its
size is bounded by that of a string; extra input columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP, NL = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", r"<~$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NL))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NL), F.lit("\n")))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: the id, ``formatted`` and ``loss_spans``.

    ``loss_spans`` are (start, length) in code points of ``formatted``, one span for each turn of
    ``loss_role``: exactly the turn's escaped text, without markers.
    """
    src = df.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            escape_role(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    turns = src.where("conv IS NOT NULL").groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = turns.unionByName(src.where("conv IS NULL").select("conv", F.array("t").alias("turns")))

    # what stands before each turn's text, and the text: adjacent turns of one role share a block
    pieces = turns.select(
        "conv",
        F.transform(
            F.arrays_zip(F.col("turns").alias("t"), F.concat(F.array(F.lit(None).cast(src.schema["t"].dataType)), F.slice("turns", 1, F.size("turns") - 1)).alias("p")),
            lambda x: F.struct(
                F.when(x.p.isNull(), F.concat(F.lit(START), x.t.role, F.lit("\n")))
                .when(x.p.role == x.t.role, F.lit(SEP))
                .otherwise(F.concat(F.lit(END + "\n" + START), x.t.role, F.lit("\n")))
                .alias("before"),
                x.t.text.alias("text"),
                (x.t.role == escape_role(F.lit(loss_role))).alias("loss"),
            ),
        ).alias("pieces"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))
    spans = F.aggregate(
        "pieces",
        zero,
        lambda s, p: F.struct(
            (s["at"] + F.length(p.before) + F.length(p.text)).alias("at"),
            F.when(p.loss, F.concat(s.spans, F.array(F.struct((s["at"] + F.length(p.before)).alias("start"), F.length(p.text).cast("long").alias("length"))))).otherwise(s.spans).alias("spans"),
        ),
        lambda s: s.spans,
    )
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p.before, p.text)), ""), F.lit(END + "\n"))
    return pieces.select(F.col("conv").alias(conv), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Column of formatted text -> array<struct<role, text>>, the original turns in order."""
    blocks = F.slice(F.split(formatted, r"<\|im_end\|>\n"), 1, F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)

    def block(b: Column) -> Column:
        body = F.substr(b, F.lit(len(START) + 1))
        at = F.locate("\n", body)
        role = unescape_role(F.substr(body, F.lit(1), at - 1))
        return F.transform(F.split(F.substr(body, at + 1), r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, block))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped span by span, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")
