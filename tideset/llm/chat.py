"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A conversation renders as `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. A deterministic parser reads the text back; where the turns
that it recovers differ from the source (a text holds control strings, or what looks like an escaped one), the conversation is rendered
with escapes, read back and compared once more; were it not identical then, the job would fail rather than lose a turn. An escape puts one
more backslash into each `<|im_end|>`, `<\\|im_end|>` and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|(im_start|im_end)\|>", r"<$1\\|$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|(im_start|im_end)\|>", r"<$1|$2|>")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _head(turn: Column, escaped: bool) -> Column:
    return F.concat(F.lit(START), _escape_role(turn.role) if escaped else turn.role, F.lit("\n"))


def _body(turn: Column, escaped: bool) -> Column:
    return escape(turn.text) if escaped else turn.text


def render(turns: Column, escaped: bool) -> Column:
    """The text of an array of turns (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t, escaped), _body(t, escaped), F.lit(END + "\n"))), "")


def parse(formatted: Column) -> Column:
    """The array of turns (role, text) that a rendered text holds: a turn runs from a start mark to the first end mark."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, F.lit(2), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part))
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring_index(body, END, 1)).alias("text"))

    return F.transform(parts, turn)


def _spans(turns: Column, escaped: bool, learned: str) -> Column:
    """start and length, in code points, of each learned text within the rendered text."""

    def add(state: Column, t: Column) -> Column:
        head, body = F.length(_head(t, escaped)), F.length(_body(t, escaped))
        span = F.struct((state.at + head).cast("long").alias("start"), body.cast("long").alias("length"))
        return F.struct((state.at + head + body + len(END) + 1).cast("long").alias("at"), F.when(t.role == learned, F.array_append(state.spans, span)).otherwise(state.spans).alias("spans"))

    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return F.aggregate(turns, empty, add, lambda s: s.spans)


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = LEARNED) -> DataFrame:
    """One row (conv_col, turns, formatted, escaped, loss_spans) for each conversation.

    turns is the source in order, formatted its text, escaped whether the plain text did not read back identical; loss_spans are the start
    and length, in code points, of the texts to learn (those of role `learned`) within formatted.

    Defined cases: null texts and roles are empty. Turns are ordered by turn, then role, then text; null turns come first, repeated
    rows stay. A row with a null conversation is a conversation of its own. Other columns are ignored; an empty table gives no rows.
    """
    r = rows.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    whole = r.where("conv IS NOT NULL").groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t")).union(r.where("conv IS NULL").select("conv", F.array("t")))
    whole = whole.select("conv", F.transform("t", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))
    plain = whole.withColumn("plain", render(F.col("turns"), False))
    judged = plain.withColumn("escaped", parse(F.col("plain")) != F.col("turns"))
    choose = lambda f: F.when(F.col("escaped"), f(True)).otherwise(f(False))
    judged = judged.withColumn("form", F.when(F.col("escaped"), render(F.col("turns"), True)))
    lost = F.raise_error(F.concat(F.lit("turns are lost in conversation "), F.coalesce(F.col("conv").cast("string"), F.lit("null")))).cast("string")
    formatted = F.when(~F.col("escaped"), F.col("plain")).when(parse(F.col("form")) == F.col("turns"), F.col("form")).otherwise(lost)
    return judged.select(F.col("conv").alias(conv_col), "turns", formatted.alias("formatted"), "escaped", choose(lambda e: _spans(F.col("turns"), e, learned)).alias("loss_spans"))


def learned_text(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, one after the other, without their escapes."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")
