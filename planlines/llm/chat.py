"""Chat formatting: every assistant turn becomes an example with all turns before it as context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template, and of other common templates, which texts may hold.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
# End of fixed values.

_FIRST = "".join(sorted({re.escape(c[0]) for c in (OPEN, MIDDLE, CLOSE, *FOREIGN)}))
_TAILS = "|".join(re.escape(c[1:]) for c in sorted((OPEN, MIDDLE, CLOSE, *FOREIGN), key=len, reverse=True))
#: A control string, with any backslashes after its first character.
ESCAPE = rf"([{_FIRST}])(\\*)({_TAILS})"
UNESCAPE = rf"([{_FIRST}])\\(\\*)({_TAILS})"


def escape(text: Column) -> Column:
    """Put a backslash after the first character of every control string; one more where some are there.

    Afterwards no control string is left, and ``unescape`` gives the text back. No
    control string starts inside another, so one pass sees them all.
    """
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _segment(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(turn["role"]), F.lit(MIDDLE), escape(turn["text"]), F.lit(CLOSE))


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """One row for each assistant turn, with all preceding turns as its context.

    Takes ``conv_id, turn, role, text`` and returns ``conv_id, last_turn`` (position
    of the example's last turn), ``formatted``, ``loss_start, loss_end``: the half-open
    range of code points of ``formatted`` that is trainable, which is the reply
    alone. Turns after the last reply, or a conversation without replies, give one
    more row with an empty range, so the output holds every turn.

    Turns are ordered by ``turn`` (null first), ties by role and text; repeated rows
    are repeated turns. Null role and text are empty. Rows without ``conv_id`` are
    one conversation. Empty tables give no rows; other columns are ignored. The
    last example of a conversation is one row that holds it whole, so collecting
    the turns of a conversation asks for no more memory than its output.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = whole.select("conv_id", "turns", F.transform("turns", _segment).alias("segments"))
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get("turns", i)["role"] == "assistant") | (i == n - 1))
    rows = parts.select("conv_id", "turns", "segments", F.explode(replies).alias("last_turn"))
    last = F.get("turns", F.col("last_turn"))
    texts = F.array_join(F.slice("segments", 1, F.col("last_turn") + 1), "")
    rows = rows.select("conv_id", "last_turn", texts.alias("formatted"), last["role"].alias("role"), F.length(escape(last["text"])).alias("n"))
    end = F.length("formatted") - len(CLOSE)
    start = F.when(F.col("role") == "assistant", end - F.col("n")).otherwise(end)
    return rows.select("conv_id", "last_turn", "formatted", start.alias("loss_start"), end.alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """Array of ``role, text`` that a formatted text holds."""
    pieces = F.filter(F.split(formatted, _quoted(CLOSE), -1), lambda x: x != "")
    cut = lambda x: F.split(F.substring(x, F.lit(len(OPEN) + 1), F.length(x)), _quoted(MIDDLE), 2)
    return F.transform(
        F.transform(pieces, cut), lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text"))
    )


def _quoted(text: str) -> str:
    return re.escape(text)


def digests(examples: DataFrame) -> DataFrame:
    """What the formatted examples hold, read back from them by conversation."""
    span = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "last_turn").alias("formatted"),
        F.sort_array(F.collect_list(F.struct("last_turn", unescape(span).alias("text")))).alias("spans"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("spans", lambda x: x["text"]), "")
    read = whole.select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss.alias("loss"), "formatted_chars")
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
