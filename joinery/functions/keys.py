"""Column expressions that say when names, ids and numbers written in several ways are equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    """Without outer white space of any Unicode kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def hex_id(c: Column) -> Column:
    """The hexadecimal digits in order, lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_replace(c, "[^0-9A-Fa-f]", "")), F.lit(""))


def upload_key(c: Column) -> Column:
    """``up`` and its digits; null for blanks, placeholders and all-zero digits."""
    bare = F.lower(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    return F.when(bare.rlike("^up[0-9]*[1-9][0-9]*$"), bare)


def letters(c: Column) -> Column:
    """The letters, lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_replace(c, r"[^\p{L}]", "")), F.lit(""))


def number(c: Column) -> Column:
    """The number a text reads as, white space aside; null if it reads as none."""
    s = strip(c)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))
