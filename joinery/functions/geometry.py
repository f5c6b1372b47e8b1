"""Geometry of boxes as column expressions: rotations, extents, gaps, catalogue fits.

Units are millimetres, z is up, angles are degrees. A rotation (rx, ry, rz) turns about the fixed x, then y, then z axis:
R = Rz * Ry * Rx. Boxes are structs of dx, dy, dz (sizes), cx, cy, cz (centre), rx, ry, rz.
"""

from __future__ import annotations

from itertools import permutations, product

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("dx", "dy", "dz", "cx", "cy", "cz", "rx", "ry", "rz")
# The work volume, and the library and footprint parts by id.
BOUNDS = (400.0, 400.0, 500.0)
LIBRARY = (
    (48, 24, 100), (48, 24, 150), (48, 24, 200), (48, 24, 250), (48, 24, 300), (48, 24, 350), (48, 24, 400), (48, 24, 450), (48, 24, 500),
    (28, 28, 100), (28, 28, 150), (28, 28, 200), (28, 28, 250), (28, 28, 300), (28, 28, 350), (28, 28, 400), (28, 28, 450), (28, 28, 500),
    (7, 100, 100), (7, 200, 100), (7, 300, 100), (7, 400, 100), (7, 500, 100), (7, 100, 200), (7, 300, 200), (7, 400, 200), (7, 500, 200),
)
FOOTPRINTS = ((48, 24), (28, 28), (7, 50), (7, 100), (7, 150), (7, 200), (7, 250), (7, 300), (7, 350), (7, 400), (7, 450), (7, 500))

Vector = tuple[Column, Column, Column]
Matrix = tuple[Vector, Vector, Vector]


def rotation(rx: Column, ry: Column, rz: Column) -> Matrix:
    """The rows of the rotation matrix."""
    (sx, sy, sz), (kx, ky, kz) = ([f(F.radians(a)) for a in (rx, ry, rz)] for f in (F.sin, F.cos))
    return (
        (kz * ky, kz * sy * sx - sz * kx, kz * sy * kx + sz * sx),
        (sz * ky, sz * sy * sx + kz * kx, sz * sy * kx - kz * sx),
        (-sy, ky * sx, ky * kx),
    )


def euler(m: Matrix) -> Vector:
    """The angles of a rotation matrix; where y is a right angle, z is 0."""
    flat = F.abs(m[2][0]) > 1 - 1e-9
    y = -F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m[2][0]))))
    x = F.when(flat, F.degrees(F.atan2(-m[1][2], m[1][1]))).otherwise(F.degrees(F.atan2(m[2][1], m[2][2])))
    z = F.when(flat, F.lit(0.0)).otherwise(F.degrees(F.atan2(m[1][0], m[0][0])))
    return x, y, z


def _wrap(a: Column) -> Column:
    return F.pmod(a + 180, F.lit(360)) - 180


def canonical(rx: Column, ry: Column, rz: Column) -> Vector:
    """Angles in [0, 180) that turn a box into the same solid."""
    y = _wrap(ry)
    steep = F.abs(y) > 90
    x, y, z = F.when(steep, rx + 180).otherwise(rx), F.when(steep, _wrap(180 - y)).otherwise(y), _wrap(F.when(steep, rz + 180).otherwise(rz))
    # turning the box half around its own x axis
    other = (y < 0) | ((y == 0) & (z < 0))
    x, y, z = F.when(other, -x).otherwise(x), F.when(other, -y).otherwise(y), F.when(other, _wrap(z + 180)).otherwise(z)
    # the other Euler triple of the same rotation
    below = z < 0
    x, y, z = F.when(below, x + 180).otherwise(x), F.when(below, 180 - y).otherwise(y), F.when(below, z + 180).otherwise(z)
    return F.pmod(x, F.lit(180)), F.pmod(y, F.lit(180)), F.pmod(z, F.lit(180))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def axis_columns(box: str) -> list[Column]:
    """The matrix of a box struct as nine named columns, to be selected before they are used several times."""
    m = rotation(*[F.col(f"{box}.{a}") for a in ("rx", "ry", "rz")])
    return [m[i][j].alias(f"{box}_{i}{j}") for i in range(3) for j in range(3)]


def sat_gap(a: str, b: str) -> Column:
    """The largest gap between two boxes over the 15 separating axes, 0 if they meet: at most their distance.

    Needs the columns of axis_columns(a) and axis_columns(b). Cross axes of (nearly) parallel edges are left out.
    """
    ua, ub = ([tuple(F.col(f"{s}_{i}{k}") for i in range(3)) for k in range(3)] for s in (a, b))
    ha, hb = ([F.col(f"{s}.{d}") / 2 for d in ("dx", "dy", "dz")] for s in (a, b))
    t = tuple(F.col(f"{b}.{c}") - F.col(f"{a}.{c}") for c in ("cx", "cy", "cz"))

    def gap(n: Vector) -> Column:
        reach = sum((h * F.abs(dot(u, n)) for h, u in zip(ha + hb, ua + ub)), F.lit(0.0))
        return F.abs(dot(t, n)) - reach

    terms = [gap(n) for n in ua + ub]
    for u, v in product(ua, ub):
        n = cross(u, v)
        size = F.sqrt(dot(n, n))
        terms.append(F.when(size > 1e-12, gap(n) / size).otherwise(F.lit(0.0)))
    return F.greatest(F.lit(0.0), *terms)


def aligned_overlap(a: str, b: str) -> Column:
    """The common volume of two boxes without rotation."""
    out = F.lit(1.0)
    for d, c in zip(("dx", "dy", "dz"), ("cx", "cy", "cz")):
        low = F.greatest(*[F.col(f"{s}.{c}") - F.col(f"{s}.{d}") / 2 for s in (a, b)])
        high = F.least(*[F.col(f"{s}.{c}") + F.col(f"{s}.{d}") / 2 for s in (a, b)])
        out = out * F.greatest(F.lit(0.0), high - low)
    return out


def pair_score(gap: Column, volume: Column) -> Column:
    """How well two parts can be joined: 0 is best, positive for a gap, negative for an overlap."""
    return F.when(gap != 0, F.tanh(gap * 0.2)).otherwise(F.tanh(volume * -0.001))


def half_spaces(box: str) -> Column:
    """array<array<double>>: the six (a, b, c, d) with ax + by + cz + d <= 0 inside the box. Needs axis_columns(box)."""
    out = []
    for k, d in enumerate(("dx", "dy", "dz")):
        n = tuple(F.col(f"{box}_{i}{k}") for i in range(3))
        at = dot(n, tuple(F.col(f"{box}.{c}") for c in ("cx", "cy", "cz")))
        out += [F.array(*n, -at - F.col(f"{box}.{d}") / 2), F.array(*[-x for x in n], at - F.col(f"{box}.{d}") / 2)]
    return F.array(*out)


def corners(box: str) -> Column:
    """array<struct<x,y,z>>: the eight corners. Needs axis_columns(box)."""
    out = []
    for signs in product((-0.5, 0.5), repeat=3):
        at = [F.col(f"{box}.{c}") + sum((F.col(f"{box}_{i}{k}") * F.col(f"{box}.{d}") * s for k, (d, s) in enumerate(zip(("dx", "dy", "dz"), signs))), F.lit(0.0)) for i, c in enumerate(("cx", "cy", "cz"))]
        out.append(F.struct(*[v.alias(n) for v, n in zip(at, "xyz")]))
    return F.array(*out)


def corner_array(parts: Column) -> Column:
    """array<struct<x,y,z>>: the eight corners of each box of an array, box by box, in the row; the order of corners is that of `corners`."""
    trig = F.transform(parts, lambda p: F.struct(p.alias("p"), *[f(F.radians(p[a])).alias(f"{n}{a}") for a in ("rx", "ry", "rz") for n, f in (("s", F.sin), ("k", F.cos))]))

    def axes(t: Column) -> Column:
        """The box's centre, and its three axes with its sizes."""
        (sx, kx), (sy, ky), (sz, kz) = ((t[f"s{a}"], t[f"k{a}"]) for a in ("rx", "ry", "rz"))
        m = ((kz * ky, kz * sy * sx - sz * kx, kz * sy * kx + sz * sx), (sz * ky, sz * sy * sx + kz * kx, sz * sy * kx - kz * sx), (-sy, ky * sx, ky * kx))
        p = t["p"]
        return F.struct(*[p[c].alias(c) for c in ("cx", "cy", "cz")], *[(m[i][k] * p[d]).alias(f"a{i}{k}") for i in range(3) for k, d in enumerate(("dx", "dy", "dz"))])

    def eight(b: Column) -> Column:
        return F.array(*[F.struct(*[(b[c] + b[f"a{i}0"] * u + b[f"a{i}1"] * v + b[f"a{i}2"] * w).alias(n) for i, (c, n) in enumerate(zip(("cx", "cy", "cz"), "xyz"))]) for u, v, w in product((-0.5, 0.5), repeat=3)])

    return F.flatten(F.transform(F.transform(trig, axes), eight))


def best_order(sizes: Vector, target: Column) -> Column:
    """struct<misfit, order>: the order of the three sizes closest to the first two or three target sizes; of ties the first."""
    choices = []
    for n, order in enumerate(permutations(range(3))):
        off = F.aggregate(
            F.zip_with(F.array(*[sizes[i] for i in order]), target, lambda s, t: F.when(t.isNotNull(), (s - t) * (s - t)).otherwise(F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x
        )
        choices.append(F.struct(F.sqrt(off).alias("misfit"), F.lit(n).alias("n"), F.array(*[F.lit(i) for i in order]).alias("order")))
    return F.array_min(F.array(*choices))


def best_in_catalogue(sizes: Vector, parts: tuple) -> Column:
    """struct<misfit, id>: the catalogue part whose sizes are closest to the given ones in any order; of ties the first.

    Two or three sizes are compared; for equal numbers of sizes, sorted sizes are the closest order.
    """
    choices = []
    for k, part in enumerate(parts):
        if len(part) == 3:
            mine = F.sort_array(F.array(*[s.cast("double") for s in sizes]))
            theirs = sorted(map(float, part))
            off = F.sqrt(sum(((mine[i] - theirs[i]) * (mine[i] - theirs[i]) for i in range(3)), F.lit(0.0)))
        else:
            off = F.least(*[F.sqrt((sizes[i] - part[0]) * (sizes[i] - part[0]) + (sizes[j] - part[1]) * (sizes[j] - part[1])) for i, j in permutations(range(3), 2)])
        choices.append(F.struct(off.alias("misfit"), F.lit(k).alias("id")))
    return F.array_min(F.array(*choices))


def order_parity(order: Column) -> Column:
    """1 for an even order of three axes, -1 for an odd one, whose last axis is turned around to stay a rotation."""
    even = (F.pmod(order[1] - order[0], F.lit(3)) == 1) & (F.pmod(order[2] - order[1], F.lit(3)) == 1)
    return F.when(even, 1).otherwise(-1)


def order_rotation(order: Column) -> Column:
    """array<array<int>>: the rotation that brings axis order[i] to axis i."""
    sign = order_parity(order)
    return F.array(*[F.array(*[F.when(order[i] == j, sign if i == 2 else F.lit(1)).otherwise(0) for j in range(3)]) for i in range(3)])


def closest_pair(sizes: Vector) -> Column:
    """struct<off, i, j>: which two of three sizes differ least; of ties the first."""
    return F.array_min(F.array(*[F.struct(F.abs(sizes[i] - sizes[j]).alias("off"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (0, 2), (1, 2))]))
