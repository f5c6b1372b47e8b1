"""Designs as tables of parts: parsing and writing text, normalising, pairwise measures.

A design text is strict: after outer white space every line must be nine whole numbers in decimal digits, divided by
white space, else the whole design is unreadable. Texts are written by height of the centre, lowest first, then in
the order of the parts; parts of which a rounded size is not positive are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.functions import geometry as G
from joinery.functions.keys import strip
from joinery.functions.scalars import round_even

_LINE = r"^\p{Nd}+(?: \p{Nd}+){8}$"
_BOXES = "array<struct<" + ", ".join(f"{f}: double" for f in G.FIELDS) + ">>"
#: Numbers per line of a design type.
TOKENS = {"cuboid": 9, "library": 7, "footprint": 8}


#: What a text of flat lines doesn't have: other characters than digits, blanks and line ends, and two of these together or outside.
_UNEVEN = r"[^0-9 \n]|[ \n][ \n]|\A[ \n]|[ \n]\z"


def flat_lines(text: Column) -> Column:
    """The lines of a stripped text, each with single blanks; the empty text is one empty line. Texts that are flat already are only split."""
    even = F.transform(F.split(strip(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.when(text.rlike(_UNEVEN), even).otherwise(F.split(text, "\n"))


def readable(text: Column, kind: str = "cuboid") -> Column:
    pattern = _LINE.replace("{8}", "{%d}" % (TOKENS[kind] - 1))
    return F.forall(flat_lines(text), lambda x: x.rlike(pattern))


def _read(text: Column) -> Column:
    """An array of the parts of a readable text, an array of box structs; else an empty array or null. Lines are read once, and split once."""
    tokens = F.transform(flat_lines(text), lambda x: F.when(x.rlike(_LINE), F.split(x, " ")))
    part = lambda x: F.when(x.isNotNull(), F.struct(*[F.get(x, F.lit(i)).try_cast("double").alias(f) for i, f in enumerate(G.FIELDS)]))
    return F.filter(F.array(F.transform(tokens, part)), lambda parts: F.forall(parts, lambda p: p["dx"].isNotNull()))


def parts_of(text: Column) -> Column:
    """The parts of a design text in text order, an array of box structs; null for unreadable and null texts."""
    return F.get(_read(text), F.lit(0))


def parse(designs: DataFrame, text: str = "design", keep: tuple[str, ...] = ("entry_id",)) -> DataFrame:
    """(keep, parts): readable designs with their parts in text order; others are left out."""
    return designs.select(*keep, F.explode(_read(F.col(text))).alias("parts"))  # not a filter, which would read the text again


def append_part(parts: Column, part: Column) -> Column:
    """A design with one part more; a null design is an empty one."""
    return F.array_append(F.coalesce(parts, F.array().cast(_BOXES)), part)


def box_extents(points: Column) -> dict[str, Column]:
    """Of an array of points in one row: wx, wy, wz, the size of their bounding box, and mx, my, mz, their mean."""
    axis = {a: points[a] for a in "xyz"}
    total = lambda a: F.aggregate(axis[a], F.lit(0.0), lambda n, x: n + x)
    return {f"w{a}": F.array_max(axis[a]) - F.array_min(axis[a]) for a in "xyz"} | {f"m{a}": total(a) / F.size(points) for a in "xyz"}


def part_rows(parsed: DataFrame, keep: tuple[str, ...] = ("entry_id",)) -> DataFrame:
    """(keep, part_idx, the nine fields): one row per part."""
    return parsed.select(*keep, F.posexplode("parts").alias("part_idx", "p")).select(*keep, "part_idx", "p.*")


def part_text(p: Column) -> Column:
    return F.concat_ws(" ", *[round_even(p[f]).cast("bigint").cast("string") for f in G.FIELDS])


def design_text(parts: Column) -> Column:
    """The text of an array of box structs."""
    solid = F.filter(parts, lambda p: F.least(*[F.rint(p[d]) for d in ("dx", "dy", "dz")]) > 0)
    rows = F.transform(solid, lambda p, i: F.struct(p["cz"].alias("z"), i.alias("i"), part_text(p).alias("t")))
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["t"]), "\n")


def library_text(part: Column, *numbers: Column) -> Column:
    """A line of a part by id: id, centre and rotation as whole numbers."""
    return F.concat_ws(" ", part.cast("string"), *[round_even(n).cast("bigint").cast("string") for n in numbers])


def footprint_text(part: Column, length: Column, *numbers: Column) -> Column:
    """A line of a footprint: id, length as it is, centre and rotation as whole numbers."""
    return F.concat_ws(" ", part.cast("string"), length.cast("string"), *[round_even(n).cast("bigint").cast("string") for n in numbers])


def library_parts(parsed_lines: DataFrame, line: str, kind: str = "library") -> DataFrame:
    """Adds `p`, the box struct of a library (id, centre, rotation) or footprint (id, length, centre, rotation) line; null for unreadable lines and unknown ids."""
    tokens = F.split(F.col(line), " ")
    ok = F.col(line).rlike(_LINE.replace("{8}", "{%d}" % (TOKENS[kind] - 1)))
    num = lambda i: F.get(tokens, F.lit(i)).try_cast("double")
    table = G.LIBRARY if kind == "library" else G.FOOTPRINTS
    sizes = F.get(F.array(*[F.array(*[F.lit(float(x)) for x in part]) for part in table]), num(0).cast("int"))
    dims = [F.get(sizes, F.lit(i)) for i in range(len(table[0]))] + ([num(1)] if kind == "footprint" else [])
    rest = [num(i + (1 if kind == "library" else 2)) for i in range(6)]
    box = F.struct(*[c.alias(f) for c, f in zip([*dims, *rest], G.FIELDS)])
    return parsed_lines.withColumn("p", F.when(ok & (num(0) < len(table)), box))


def neighbours(parsed: DataFrame, keep: tuple[str, ...] = ("entry_id",)) -> DataFrame:
    """(keep, i, a, b): each part with the one after it."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("parts") - 2), lambda i: F.struct(i.alias("i"), F.get(F.col("parts"), i).alias("a"), F.get(F.col("parts"), i + 1).alias("b")))
    return parsed.filter("size(parts) > 1").select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.i", "x.a", "x.b")


def with_gap(pairs: DataFrame) -> DataFrame:
    """Adds `gap`, the separating-axis gap of the box structs a and b."""
    names = pairs.columns
    return pairs.select("*", *G.axis_columns("a"), *G.axis_columns("b")).select(*names, G.sat_gap("a", "b").alias("gap"))


def extents(points: DataFrame, key: str) -> DataFrame:
    """(key, wx, wy, wz, volume, mx, my, mz): size of the points' bounding box per axis, its volume, and their mean."""
    w = {a: F.max(a) - F.min(a) for a in "xyz"}
    return points.groupBy(key).agg(*[w[a].alias(f"w{a}") for a in "xyz"], (w["x"] * w["y"] * w["z"]).alias("volume"), *[F.avg(a).alias(f"m{a}") for a in "xyz"])


def normalised(points: DataFrame, key: str) -> DataFrame:
    """The points turned from y-up to z-up, scaled so that the wider horizontal side is 100, centred, standing on z = 0.

    The bounds are one aggregation of the whole model, so that all its meshes move alike.
    """
    turned = points.withColumns({"y": -F.col("z"), "z": F.col("y")})
    b = turned.groupBy(key).agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    scale = F.lit(100.0) / F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y"))
    moved = turned.join(b, key).withColumn("_s", scale)
    out = moved.withColumns({"x": (F.col("x") - (F.col("lo_x") + F.col("hi_x")) / 2) * F.col("_s"), "y": (F.col("y") - (F.col("lo_y") + F.col("hi_y")) / 2) * F.col("_s"), "z": (F.col("z") - F.col("lo_z")) * F.col("_s")})
    return out.select(*points.columns)


def corner_points(parsed: DataFrame, keep: tuple[str, ...] = ("entry_id",)) -> DataFrame:
    """(keep, part_idx, pt_idx, x, y, z): the corners of all parts."""
    boxes = parsed.select(*keep, F.posexplode("parts").alias("part_idx", "p"))
    pts = boxes.select(*keep, "part_idx", "p", *G.axis_columns("p")).select(*keep, "part_idx", F.posexplode(G.corners("p")).alias("pt_idx", "c"))
    return pts.select(*keep, "part_idx", "pt_idx", "c.*")
