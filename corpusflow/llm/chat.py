"""Chat formatting with column expressions only: one text per conversation, a loss mask, and the way back to the turns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings around runs of turns of one role.

    A run is ``<s>[ROLE] role [/ROLE]`` text ``[SEP]`` text ... ``</s>``; for the user role the texts stand between
    ``[INST] `` and `` [/INST]`` instead.  Every control string starts with ``<`` or ``[`` and has no second one, so that
    no two of them overlap.
    """

    begin: str = "<s>"
    end: str = "</s>"
    role_open: str = "[ROLE]"
    role_close: str = "[/ROLE]"
    user_open: str = "[INST]"
    user_close: str = "[/INST]"
    separator: str = "[SEP]"
    user: str = "user"
    trained: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.end, self.role_open, self.role_close, self.user_open, self.user_close, self.separator)


def _tails(template: ChatTemplate) -> str:
    return "|".join(re.escape(c[1:]) for c in template.controls)


def escape(text: Column, template: ChatTemplate) -> Column:
    """Control strings get a backslash behind their first character; those that have some already get one more."""
    return F.regexp_replace(text, f"([<\\[])(\\\\*)({_tails(template)})", "$1\\\\$2$3")


def unescape(text: Column, template: ChatTemplate) -> Column:
    """The text that :func:`escape` was given."""
    return F.regexp_replace(text, f"([<\\[])\\\\(\\\\*)({_tails(template)})", "$1$2$3")


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """(conv_id, formatted, segments) from rows of (conv_id, turn, role, text, ...).

    Turns are collected per conversation and sorted by turn, equal turns by role and text; adjacent turns of one role
    share one run.  ``segments`` are the pieces of ``formatted`` in order, (text, loss); the pieces under the loss mask
    are the escaped texts of the trained roles.  Null texts and roles count as empty, null turns come first, a null
    conv_id is a conversation of its own, repeated rows are turns of their own, other columns are ignored.  A formatted
    conversation is one cell, so all of it has to fit into one.
    """
    row = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t")).withColumn("n", F.size("t"))
    t, n = F.col("t"), F.col("n")

    def pieces(x: Column, i: Column) -> Column:
        own = x["role"]
        opens = (i == 0) | (F.get(t, i - 1)["role"] != own)
        closes = (i == n - 1) | (F.get(t, i + 1)["role"] != own)
        user = own == template.user
        role = F.concat(F.lit(f"{template.begin}{template.role_open} "), escape(own, template), F.lit(f" {template.role_close}"))
        head = F.when(user, F.lit(f"{template.begin}{template.user_open} ")).otherwise(role)
        tail = F.when(user, F.lit(f" {template.user_close}{template.end}")).otherwise(F.lit(template.end))
        return F.array(
            F.struct(F.when(opens, head).otherwise(F.lit(template.separator)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"], template).alias("text"), own.isin(*template.trained).alias("loss")),
            F.struct(F.when(closes, tail).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")),
        )

    segments = F.filter(F.flatten(F.transform(t, pieces)), lambda s: s["text"] != "")
    chats = chats.select("conv_id", segments.alias("segments"))
    return chats.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns (role, text) of a formatted conversation, from its text alone."""
    size = lambda s: F.lit(len(s))
    cut = lambda x, head, tail: F.substr(x, size(head) + 1, F.length(x) - len(head) - len(tail))
    runs = F.filter(F.split(formatted, re.escape(template.end)), lambda r: r != "")

    def run(r: Column) -> Column:
        user_head, user_tail = f"{template.begin}{template.user_open} ", f" {template.user_close}"
        role_head, role_tail = f"{template.begin}{template.role_open} ", f" {template.role_close}"
        user = r.startswith(user_head)
        parts = F.split(r, re.escape(role_tail), 2)
        role = F.when(user, F.lit(template.user)).otherwise(unescape(cut(parts[0], role_head, ""), template))
        body = F.when(user, cut(r, user_head, user_tail)).otherwise(F.get(parts, F.lit(1)))
        texts = F.split(body, re.escape(template.separator))
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x, template).alias("text")))

    return F.flatten(F.transform(runs, run))
