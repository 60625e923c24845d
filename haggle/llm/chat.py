"""Chat formatting with Spark expressions only.

A conversation becomes one string: adjacent turns of one role share a block
``<|im_start|>role\\ntext<|im_end|>\\n``, and inside a block the merged turns stand apart by
``<|im_sep|>``.  In texts a backslash is doubled and ``<|`` is written ``<\\|``, so no control
string can come from a text and reading back is exact; roles also write a newline as ``<|n|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
NEWLINE = "<|n|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    # Escaped text has no '<|' left, so the mark for a newline is no one else's.
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """Rows ``conv_id, formatted, loss_spans array<struct<start, length, turn>>`` (code points, and turns, from 0).

    ``loss_spans`` covers the escaped texts of role ``learn``: one span for each original turn.
    A null role or text reads as empty; turns with a null or an equal ``turn`` follow by role and
    text, nulls first; rows with a null ``conv_id`` form one conversation; an empty table gives an
    empty table; other columns are ignored.
    """
    one = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    # What stands before each turn's text: a turn of the role before it goes on in its block, and the first turn
    # has no block to close.
    before = lambda i: F.element_at("turns", F.greatest(i, F.lit(1)))["role"]
    step = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.when((i > 0) & (before(i) == t["role"]), F.lit(SEP))
            .otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), escape_role(t["role"]), F.lit("\n")))
            .alias("head"),
            escape(t["text"]).alias("text"),
            (t["role"] == learn).alias("learn"),
        ),
    )
    # Positions are a running sum over the turns of a conversation, which the grouping has left together, so
    # nothing is shuffled again and the work grows with the turns, not with their square.
    steps = sorted_turns.select("conv_id", F.posexplode(step).alias("turn", "s")).select("conv_id", "turn", "s.*")
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("text").cast("bigint")
    start = F.coalesce(F.sum(F.length("head") + length).over(so_far), F.lit(0)) + F.length("head")
    placed = steps.withColumn("start", start.cast("bigint"))
    span = F.struct("start", length.alias("length"), F.col("turn").cast("bigint").alias("turn"))
    merged = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.concat("head", "text").alias("piece")))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("learn"), span))).alias("loss_spans"),
    )
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: p["piece"]), ""), F.lit(END))
    return merged.select("conv_id", formatted.alias("formatted"), "loss_spans")


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read :func:`format_chats` back: ``conv_id, turns array<struct<role, text>>, loss_text``.

    The loss is taken from the turns that the spans name; a span whose length is not its turn's is an error."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    shown = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, "\n") + 1, F.length(b)), r"<\|im_sep\|>"),
                lambda t: F.struct(F.substring(b, F.lit(len(START) + 1), F.instr(b, "\n") - 1 - len(START)).alias("role"), t.alias("text")),
            ),
        )
    )
    found = formatted.select("conv_id", "formatted", "loss_spans", shown.alias("shown"))
    told = lambda s: F.element_at("shown", (s["turn"] + 1).cast("int"))["text"]
    wrong = F.lit("a loss span does not fit its turn")
    loss = F.transform("loss_spans", lambda s: F.when(F.length(told(s)) == s["length"], unescape(told(s))).otherwise(F.raise_error(wrong)))
    turns = F.transform("shown", lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    return found.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")


def chat_digests(turns: DataFrame) -> DataFrame:
    """Digest columns of formatted conversations, all taken from the output as read back."""
    back = read_chats(format_chats(turns))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
