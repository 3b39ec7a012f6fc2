"""Chat formatting with prefix-target expansion: every assistant turn becomes an example of its own.

Everything here is built of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import column

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """A text without control strings: each "<", backslashes, "|" gets one backslash more. unescape() takes it away."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("%3C|"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def expand_targets(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One example for each assistant turn: conv_id, target, formatted, loss_start, loss_end.

    formatted has all turns up to the target, the turns in order of turn, then role and text; only the target's text
    is trainable: the code points from loss_start up to but not including loss_end (counted from 0). What follows
    the last assistant turn, or all of a conversation that has none, makes one more example with an empty loss
    range, so that no turn is lost. target is the place of the turn in its conversation, from 0. Null roles and
    texts count as empty, a null conv_id is a conversation too. An empty table gives no examples.

    The examples of one conversation together are as long as its length times its assistant turns: that is what the
    method asks for. Conversations are grouped once, and their turns are all that a group holds.
    """
    role, text = F.coalesce(column(role_col), F.lit("")), F.coalesce(column(text_col), F.lit(""))
    convs = turns.groupBy(column(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(column(turn_col).alias("turn"), role.alias("role"), text.alias("text")))).alias("turns"))
    coded = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("reply")))
    convs = convs.select("conv_id", coded.alias("turns"))
    whole = lambda t: F.concat(t["head"], t["body"], F.lit(f"{END}\n"))
    targets = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["reply"] | (i == F.size("turns")))
    convs = convs.select("conv_id", "turns", F.explode(targets).alias("i"))
    last = F.element_at("turns", F.col("i"))
    prompt = F.concat(F.array_join(F.transform(F.slice("turns", 1, F.col("i") - 1), whole), ""), last["head"])
    parts = convs.select("conv_id", (F.col("i") - 1).cast("long").alias("target"), prompt.alias("prompt"), last["body"].alias("body"), last["reply"].alias("reply"))
    start = F.char_length("prompt").cast("long")
    return parts.select(
        "conv_id", "target", F.concat("prompt", "body", F.lit(f"{END}\n")).alias("formatted"), start.alias("loss_start"), F.when(F.col("reply"), start + F.char_length("body")).otherwise(start).alias("loss_end")
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples say of each conversation: conv_id, turns (role and text), losses (target and text), formatted_chars.

    The turns are cut out of the longest example by its control strings, the losses out of each by its range.
    """
    loss = F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)")
    convs = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "target").alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("loss_end") > F.col("loss_start"), F.struct("target", unescape(loss).alias("text"))))).alias("losses"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    pieces = F.filter(F.split("longest", r"<\|im_end\|>\n", -1), lambda p: p != "")
    bare = F.transform(pieces, lambda p: F.substring(p, len(START) + 1, 1 << 30))
    turn = lambda p: F.struct(_unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.regexp_replace(p, r"^[^\n]*\n", "")).alias("text"))
    return convs.select("conv_id", F.transform(bare, turn).alias("turns"), "losses", "formatted_chars")
