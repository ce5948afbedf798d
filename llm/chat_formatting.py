"""Conversations in reply order, without quotes.

Method: quotation linking.  Leading ``>`` signs of a line tell its quote level.
Quoted lines are normalised (small letters, single spaces) and hashed, and so are the
lines that messages say themselves; a quoted line comes from the first message
of its conversation that says it.  A message replies to the earlier message that
most of its quoted lines come from, on the lowest level that links to any; of
equal ones to the latest.  Quotes of a higher level belong to messages further
up.  Following the replies gives each message the first one of its thread; a
conversation ordered by (root_turn, turn) has every reply after what it quotes.

Origins are grouped minima, one row for each line of a conversation, so a line
that all messages quote joins one row.  Links to roots are followed in doubling
steps.  DataFrame functions only.

A null text is empty; a null role is ``unknown``.  Messages without a
conversation or turn link with nothing.  Rows that repeat a turn are messages of
their own which share the links of their turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import stage

_QUOTED = r"^\s*+>"
_MARKS = r"^(?:\s*+>)++\s?"


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\r?\n")


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def _parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash) of every line that isn't blank."""
    lines = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(_lines()).alias("line"))
    marks = F.regexp_extract("line", r"^((?:\s*+>)*+)", 1)
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    normal = _normal(F.regexp_replace("line", _MARKS, ""))
    return lines.select("conv_id", "turn", level.alias("level"), normal.alias("normal")).where("normal <> ''").select(
        "conv_id", "turn", "level", F.xxhash64("normal").alias("hash")
    )


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_linked): the message that each quoting message replies to."""
    parsed = _parsed(messages)
    origins = parsed.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quoted = parsed.where("level > 0").groupBy("conv_id", "turn", "level", "hash").agg(F.count("*").alias("n"))
    found = quoted.join(origins, ["conv_id", "hash"]).where("origin < turn")
    votes = found.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("n"))
    best = F.max_by("origin", F.struct(-F.col("level"), F.col("n"), F.col("origin")))
    return votes.groupBy("conv_id", "turn").agg(best.alias("parent_turn"), F.sum("n").alias("n_linked"))


def _roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn) of the replies."""
    found = stage(links.select("conv_id", "turn", F.col("parent_turn").alias("root_turn")), "roots")
    while True:
        above = found.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("further"))
        stepped = stage(found.join(above, ["conv_id", "root_turn"], "left").select("conv_id", "turn", "root_turn", "further"), "roots")
        if stepped.where("further is not null").isEmpty():
            return found
        found = stepped.select("conv_id", "turn", F.coalesce("further", "root_turn").alias("root_turn"))


def linked_conversations(messages: DataFrame) -> DataFrame:
    """One row for each row of ``messages``: conv_id, turn, role, parent_turn, root_turn, n_quoted, n_linked, formatted."""
    links = stage(reply_links(messages), "links")
    says = F.filter(_lines(), lambda line: ~line.rlike(_QUOTED))
    body = F.trim(F.array_join(says, "\n"))
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    shown = messages.select(
        "conv_id",
        "turn",
        role.alias("role"),
        (F.size(_lines()) - F.size(says)).cast("bigint").alias("n_quoted"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), body).alias("formatted"),
    )
    known = links.join(_roots(links), ["conv_id", "turn"], "left")
    return shown.join(known, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        "n_quoted",
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        "formatted",
    )
