"""Chat formatting: a finite-state machine over roles and a declarative template.

The template is data: the control strings that open a turn, end its role and close it, and the roles under the loss. The
machine is data too: which role may follow which. Formatting a conversation gives text segments, each with a loss
flag; the formatted text is the segments in order. Control strings inside texts are escaped by a backslash after their
first character, backslashes are doubled; so no text can open or close a turn, and `turns` and `loss_text` read back
exactly what went in. All of it is DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "<|turn|>"
    role_end: str = "<|text|>"
    close: str = "<|end|>"
    # Control strings of this and other common templates; none may stand in a text as it is.
    control: tuple[str, ...] = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    # The machine: state -> roles that may come next.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})


def escape(text: Column, template: Template) -> Column:
    tails = sorted(template.control, key=len, reverse=True)
    found = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in tails)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), found, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, in_order: one row per conversation.

    Rows sort by turn, then role and text, so ties and repeated rows have one order; a null turn comes first. Null role
    and text are empty. Rows with a null conv_id form one conversation. in_order: the machine accepts the roles. Turns out of
    order are formatted all the same, so no row is lost. Very long texts are escaped and kept whole. Extra columns are ignored; an empty table gives no row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    loss = lambda t: t["role"].isin(*template.loss_roles)
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    head = lambda t: F.concat(F.lit(template.open), escape(t["role"], template), F.lit(template.role_end))
    segments = F.flatten(F.transform("turns", lambda t: F.array(piece(head(t), F.lit(False)), piece(escape(t["text"], template), loss(t)), piece(F.lit(template.close), F.lit(False)))))
    accept = lambda state, role: F.coalesce(*(F.when((state == s) & role.isin(*n), role) for s, n in template.follows.items()), F.lit("!"))
    last = F.aggregate("turns", F.lit(""), lambda state, t: accept(state, t["role"]))
    out = turns.select("conv_id", segments.alias("segments"), (last != "!").alias("in_order"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "in_order")


def turns(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read from a formatted text."""
    parts = F.filter(F.split(formatted, re.escape(template.close)), lambda p: p != "")
    halves = lambda p: F.split(F.substr(p, F.lit(len(template.open) + 1)), re.escape(template.role_end))
    return F.transform(parts, lambda p: F.struct(unescape(F.get(halves(p), F.lit(0))).alias("role"), unescape(F.get(halves(p), F.lit(1))).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
