r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all earlier turns as context, and its
text as the only trainable part. Turns after the last assistant turn would be in no
example, so they close the conversation as one more example without a trainable part.

A turn is `<|im_start|>role\ntext<|im_end|>\n`. Control strings inside a text get a
backslash after their first character, and those that have backslashes there get one more, so
a formatted text holds no control string but its own and reads back exactly. Roles are
URL-encoded for the same reason.

An example holds all earlier turns by definition, so the examples of a conversation take
space that grows with the square of its turns, and one row holds a whole conversation;
what is gathered in one group is one conversation.

Defined results: null text and null role are empty; turns that share a number are ordered
by role, then text; repeated rows are turns of their own; a null conv_id is a
conversation; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Strings with a meaning in this or another common template.
CONTROL = [START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_QUOTED = "|".join(s[1:].replace("|", "\\|").replace("[", "\\[").replace("]", "\\]") for s in CONTROL)
ESCAPE, UNESCAPE = rf"([<\[])(\\*)({_QUOTED})", rf"([<\[])\\(\\*)({_QUOTED})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def examples(turns: DataFrame, conv: str = "conv_id", trained: str = "assistant") -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_length) per trained turn and per open end.

    The loss mask covers loss_length code points of `formatted` from loss_start (from 0).
    """
    empty = F.lit("")
    row = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    talks = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
    shown = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained).alias("on")))
    talks = talks.select("conv_id", shown.alias("shown"))
    ends = F.filter(F.sequence(F.lit(1), F.size("shown")), lambda i: (i == F.size("shown")) | F.element_at("shown", i)["on"])
    each = talks.select("conv_id", "shown", F.posexplode(ends).alias("example", "n_turns"))
    earlier = F.array_join(
        F.transform(F.slice("shown", 1, F.col("n_turns") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(f"{END}\n"))), ""
    )
    last = F.element_at("shown", F.col("n_turns"))
    opened = each.select(
        "conv_id", "example", "n_turns", F.concat(earlier, last["head"]).alias("before"), last["body"].alias("body"), last["on"].alias("on")
    )
    return opened.select(
        "conv_id", "example", "n_turns", F.concat("before", "body", F.lit(f"{END}\n")).alias("formatted"),
        F.when(F.col("on"), F.char_length("before")).alias("loss_start"), F.when(F.col("on"), F.char_length("body")).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted example."""
    pieces = F.slice(F.split(formatted, r"<\|im_end\|>\n"), 1, F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)

    def turn(p: Column) -> Column:
        line = F.locate("\n", p)
        role = F.url_decode(p.substr(F.lit(len(START) + 1), line - len(START) - 1))
        return F.struct(role.alias("role"), unescape(p.substr(line + 1, F.char_length(p))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, unescaped; empty without a mask."""
    return F.coalesce(unescape(formatted.substr(start + 1, length)), F.lit(""))


def summary(written: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from examples."""
    losses = F.sort_array(F.collect_list(F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"))))
    whole = written.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"), losses.alias("losses"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return whole.select("conv_id", read_turns(F.col("longest")).alias("turns"), loss.alias("loss"), "formatted_chars").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
