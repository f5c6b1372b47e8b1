"""Chat messages, captions and text lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

END = "EOS"
SYSTEM = "You are a helpful assistant."
INSTRUCTION = "Design a piece of wooden furniture as boxes. Write one box per line, as nine whole numbers: sizes dx dy dz, centre cx cy cz, rotation rx ry rz in degrees. Description: "
_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"


def instruction(caption: Column) -> Column:
    return F.concat(F.lit(INSTRUCTION), caption)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def conversation(caption: Column, design: Column) -> Column:
    """The training conversation of a caption and its design."""
    return F.array(message("system", F.lit(SYSTEM)), message("user", instruction(caption)), message("assistant", design))


def of_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def not_of_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] != role)


def said(messages: Column, role: str = "assistant") -> Column:
    """The contents of all messages of a role, joined without a break."""
    return F.array_join(F.transform(of_role(messages, role), lambda m: m["content"]), "")


def lines(text: Column) -> Column:
    """The lines of a text; a final line break starts no line; the empty text has none."""
    even = F.regexp_replace(F.regexp_replace(text, _BREAKS, "\n"), r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(even, "\n"))


def prefix(parts: Column, n: Column) -> Column:
    """The first n lines, each with its line break."""
    return F.array_join(F.transform(F.slice(parts, F.lit(1), n), lambda x: F.concat(x, F.lit("\n"))), "")


def next_line(parts: Column, n: Column) -> Column:
    """The line after the first n, or the end mark."""
    return F.coalesce(F.get(parts, n), F.lit(END))
