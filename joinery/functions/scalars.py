"""Small scalar functions on columns: rounding, text and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from joinery.functions.keys import strip


def round_even(c: Column, digits: int = 0) -> Column:
    """Rounded half to even on the scaled value."""
    scale = 10.0**digits
    return F.rint(c * scale) / scale


def whole(c: Column) -> Column:
    """The integer a text is, white space aside; null if it is none (decimals are none)."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?[0-9]{1,18}$"), s.cast("bigint"))


def truncated(c: Column) -> Column:
    """To the integer next to zero."""
    return c.cast("bigint")


def linspace(start: Column, stop: Column, n: int) -> Column:
    """n evenly spaced numbers with both ends."""
    if n < 2:
        return F.slice(F.array(start), 1, n)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (stop - start) * i / (n - 1))


def grid_side(n: Column) -> Column:
    """The side of the smallest square grid that holds n cells."""
    return F.ceil(F.sqrt(n)).cast("int")


def title(c: Column) -> Column:
    """snake_case as a title."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def padded(c: Column, width: int = 3) -> Column:
    """An integer with leading zeros; never cut."""
    return F.format_string(f"%0{width}d", c)


def fixed(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", c)


def reviewer_of(file_name: Column) -> Column:
    """The reviewer a ratings file is named after: its stem without any `_ratings`."""
    return F.replace(stem(file_name), F.lit("_ratings"), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last extension, lower case, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


# Image types by extension.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}


def mime_type(path: Column) -> Column:
    """The image type of a file name; image/png for unknown extensions."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])[suffix(path)], F.lit("image/png"))


def is_digits(c: Column) -> Column:
    return c.rlike(r"^\p{N}+$")


def fenced(reply: Column) -> Column:
    """What stands in the first code fence of a reply, or the reply itself."""
    inside = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(reply.contains("```"), inside).otherwise(reply))


def json_or(c: Column, path: str, default: str) -> Column:
    """A field of a JSON text, with a default for a missing field and unreadable JSON."""
    return F.coalesce(F.get_json_object(c, path), F.lit(default))


def with_prompt(template: str, prompt: Column) -> Column:
    """A template with its `{prompt}` filled in."""
    return F.replace(F.lit(template), F.lit("{prompt}"), prompt)
