"""Designs written as text: one piece per line, nine numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from joinery.functions.keys import strip

LINES = r"\r\n|[\n\r\u0085\u2028\u2029]"
_NUMBER = r"[+-]?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)"
PIECE = rf"^{_NUMBER}(?: {_NUMBER}){{8}}$"


def last_content(messages: Column, role: str = "assistant") -> Column:
    """The content of the last message of a role, case and outer white space of the role aside; null if there is none."""
    mine = F.filter(messages, lambda m: F.lower(strip(m["role"])) == role)
    return F.try_element_at(mine, F.lit(-1))["content"]


def piece_line(line: Column) -> Column:
    """A line's numbers divided by single blanks if it is exactly nine numbers, divided by white space or commas; else null."""
    flat = F.trim(F.regexp_replace(line, r"(?U)[\s,]+", " "))
    return F.when(flat.rlike(PIECE), flat)


def piece_numbers(flat: Column) -> Column:
    """The numbers of a piece line."""
    return F.split(flat, " ").cast("array<double>")
