"""Chat formatting with relational expressions only (operator 5).

A conversation's turns are collected as structs and sorted; adjacent turns of
one role become one block; blocks are concatenated between marks:

    <turn ROLE>text<more ROLE>text</turn>NEWLINE

``<more ROLE>`` stands where two merged turns meet, so formatting loses
nothing.  ``<`` is a mark wherever it stands: in texts and roles a backslash
becomes ``\\s``, ``<`` becomes ``\\l``, and in roles ``>`` becomes ``\\g``.
After that every backslash begins one of these pairs, so the replacements can
be undone one after the other.

The loss mask is a list of run lengths in code points, in turn outside and
inside the loss; inside are the texts of assistant turns.  There are two runs
for each mark, with the text that follows it.

``formatted`` holds the strings; ``read_back`` takes turns and loss text from
the string and the mask alone.

Edge cases: a null text or role is an empty one.  Turns with equal numbers are
ordered by role and text, null numbers come first, repeated rows are repeated
turns.  Rows with a null conv_id form one conversation.  Further columns are
ignored, whatever their names.  An empty table gives no rows.  A conversation
is one output string, so it is collected in one row; what holds of a long text
holds of a long conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange

LOSS_ROLE = "assistant"
CLOSE = "</turn>\n"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit(">"), F.lit("\\g")) if role else c


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def formatted(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row a conversation: ``conv_id``, ``formatted``, ``loss_runs``."""
    blank = F.lit("")
    conv, turn, role, text = map(exchange.quoted, (conv_col, turn_col, role_col, text_col))
    rows = conversations.select(conv.alias("conv_id"), F.struct(turn.alias("turn"), F.coalesce(role, blank).alias("role"), F.coalesce(text, blank).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).withColumn("n", F.size("turns"))
    # where a block begins; the last entry closes the list
    begins = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]))
    turns = turns.withColumn("begin", F.concat(begins, F.array("n")))
    blocks = F.transform(
        F.sequence(F.lit(0), F.size("begin") - 2),
        lambda b: F.struct(
            F.get("turns", F.get("begin", b))["role"].alias("role"),
            F.transform(F.slice("turns", F.get("begin", b) + 1, F.get("begin", b + 1) - F.get("begin", b)), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    turns = turns.select("conv_id", blocks.alias("blocks"))
    body = F.transform("blocks", lambda b: F.concat(F.array_join(F.transform(b["texts"], lambda t, i: F.concat(F.when(i == 0, "<turn ").otherwise("<more "), escape(b["role"], True), F.lit(">"), t)), ""), F.lit(CLOSE)))

    def runs(b: Column) -> Column:
        """Of one block: what is outside and inside of each text with its mark, and of the closing mark."""
        mark = F.char_length(escape(b["role"], True)) + 7  # "<turn " or "<more ", the role, ">"
        inside = b["role"] == loss_role
        each = F.transform(b["texts"], lambda t: F.when(inside, F.array(mark, F.char_length(t))).otherwise(F.array(mark + F.char_length(t), F.lit(0))))
        return F.concat(F.flatten(each), F.array(F.lit(len(CLOSE)), F.lit(0)))

    return turns.select("conv_id", F.array_join(body, "").alias("formatted"), F.flatten(F.transform("blocks", runs)).alias("loss_runs"))


def read_back(out: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id``, ``formatted``, ``turns`` (role and text) and ``loss_text``, from string and mask.

    The string is cut at its marks once, and each piece meets its two runs, so
    the work grows with the string's length.  Fails if they do not fit.
    """
    cut = out.select("conv_id", "formatted", "loss_runs", F.split("formatted", "<").alias("all")).withColumn("pieces", F.slice("all", 2, F.size("all") - 1))
    marks = F.filter("pieces", lambda s: s.startswith("turn ") | s.startswith("more "))
    turns = F.transform(marks, lambda s: F.struct(unescape(F.substring_index(F.substr(s, F.lit(6)), ">", 1)).alias("role"), unescape(F.substr(s, F.position(F.lit(">"), s) + 1)).alias("text")))
    wrong = F.raise_error(F.lit("the loss mask does not fit the text")).cast("string")

    def loss(s: Column, i: Column) -> Column:
        outside, inside = F.get("loss_runs", 2 * i), F.get("loss_runs", 2 * i + 1)
        # a piece lacks the "<" before it
        return F.when(outside + inside == F.char_length(s) + 1, F.substr(s, outside, inside)).otherwise(wrong)

    return cut.select("conv_id", "formatted", turns.alias("turns"), unescape(F.array_join(F.transform("pieces", loss), "")).alias("loss_text"))
