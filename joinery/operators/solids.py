"""Kernels on solids: box fitting, common volumes, rewards, voxels. Numpy only where columns can't express it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.functions import geometry as G
from joinery.session import spread

COARSE, FINE = 20, 10
#: Points that are turned at once; they stay in the processor's cache.
POINTS = 20_000


def axis_rotation(axis: int, degrees: float) -> np.ndarray:
    """The matrix of a turn about one of the fixed axes."""
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    i, j = (axis + 1) % 3, (axis + 2) % 3
    m = np.eye(3)
    m[i, i] = m[j, j] = c
    m[i, j], m[j, i] = -s, s
    return m


def euler_matrix(rx: float, ry: float, rz: float) -> np.ndarray:
    return axis_rotation(2, rz) @ axis_rotation(1, ry) @ axis_rotation(0, rx)


def fit_same(points: np.ndarray, coarse: int = COARSE, fine: int = FINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotations n x 3 x 3, sizes n x 3, centres n x 3): `fit_box` of n sets of as many points each (n x m x 3), all at once."""
    n = len(points)
    at = [np.ascontiguousarray(points[:, :, i].T) for i in range(3)]
    centre = [x.mean(axis=0) for x in at]
    at = [x - c for x, c in zip(at, centre)]
    total = np.broadcast_to(np.eye(3), (n, 3, 3)).copy()

    def turned(axis: int, angle: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
        y, z = at[(axis + 1) % 3], at[(axis + 2) % 3]
        return y * c - z * s, y * s + z * c

    def best(axis: int, first: np.ndarray, others: list) -> np.ndarray:
        """Of the angles the one of the smallest volume, of equal ones the first."""
        along, out, least = np.ptp(at[axis], axis=0), first, None
        for angle in [first, *others]:
            y, z = (np.ptp(x, axis=0) for x in turned(axis, angle))
            volume = along * y * z if axis == 0 else z * along * y if axis == 1 else y * z * along  # always x * y * z
            if least is None:
                least = volume
                continue
            less = volume < least
            least, out = np.where(less, volume, least), np.where(less, angle, out)
        return out

    for axis in range(3):
        rough = best(axis, np.zeros(n), list(np.linspace(-45, 45, coarse)))
        turn = best(axis, rough, [rough + a for a in np.linspace(-90 / coarse, 90 / coarse, fine)])
        at[(axis + 1) % 3], at[(axis + 2) % 3] = turned(axis, turn)
        c, s, j, k = np.cos(np.radians(turn))[:, None], np.sin(np.radians(turn))[:, None], (axis + 1) % 3, (axis + 2) % 3
        total[:, j], total[:, k] = c * total[:, j] - s * total[:, k], s * total[:, j] + c * total[:, k]
    return total.transpose(0, 2, 1), np.stack([np.ptp(x, axis=0) for x in at], axis=1), np.stack(centre, axis=1)


def fit_box(points: np.ndarray, coarse: int = COARSE, fine: int = FINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, sizes, centre): a box of small volume around points, by turns about x, then y, then z.

    Per axis, of no turn and `coarse` angles within 45 degrees either way the one that gives the smallest volume, then of `fine`
    ones around it. `points @ rotation` are the points in the box's frame; the centre is the mean of the points.
    """
    rot, sizes, centre = fit_same(points[None], coarse, fine)
    return rot[0], sizes[0], centre[0]


def fit_misfit(points: np.ndarray, rot: np.ndarray, sizes: np.ndarray) -> float:
    """How far the points' extent in the box's frame is from the box's sizes."""
    return float(np.linalg.norm(np.ptp((points - points.mean(axis=0)) @ rot, axis=0) - sizes))


#: A fitting strategy: points to (rotation, sizes, centre).
Strategy = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def library_strategy(parts: tuple = G.LIBRARY) -> Strategy:
    """Fits a box, then takes the catalogue part closest to its sizes in some order of axes; missing sizes stay as fitted."""
    def fit(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rot, sizes, centre = fit_box(points)
        orders = list(permutations(range(3)))
        off = [[np.linalg.norm(sizes[list(o)][: len(p)] - np.array(p, float)) for o in orders] for p in parts]
        k, o = np.unravel_index(int(np.argmin(off)), (len(parts), len(orders)))
        order = list(orders[o])
        turn = np.eye(3)[:, order]
        if np.linalg.det(turn) < 0:
            turn[:, 2] *= -1
        new = sizes[order].copy()
        new[: len(parts[k])] = parts[k]
        return rot @ turn, new, centre

    return fit


def fit_sets(points: np.ndarray, n: np.ndarray, strategy: Strategy = fit_box) -> np.ndarray:
    """(sets x 10: dx..rz, misfit): one box per set of n points, which lie one after another; sets without points give NaN.

    By `fit_box`, sets of as many points are fitted together, POINTS at a time; other strategies get one set after another.
    """
    out, first = np.full((len(n), 10), np.nan), np.cumsum(n) - n
    for m in np.unique(n[n > 0]):
        every = np.flatnonzero(n == m)
        step = max(1, POINTS // m) if strategy is fit_box else 1
        for k in range(0, len(every), step):
            own = every[k : k + step]
            sets = points[first[own][:, None] + np.arange(m)]
            if strategy is fit_box:
                rot, sizes, centre = fit_same(sets)
                misfit = np.linalg.norm(sizes - sizes, axis=1)  # the sizes are the points' extent in the box's frame
            else:
                rot, sizes, centre = (x[None] for x in strategy(sets[0]))
                misfit = fit_misfit(sets[0], rot[0], sizes[0])
            y = -np.degrees(np.arcsin(np.clip(rot[:, 2, 0], -1, 1)))
            x, z = np.degrees(np.arctan2(rot[:, 2, 1], rot[:, 2, 2])), np.degrees(np.arctan2(rot[:, 1, 0], rot[:, 0, 0]))
            out[own, :3], out[own, 3:6], out[own, 6:9], out[own, 9] = sizes, centre, np.stack([x, y, z], axis=1), misfit
    return out


def numbers(structs: pa.StructArray, fields: tuple[str, ...] = G.FIELDS) -> np.ndarray:
    """(rows x fields) of an Arrow array of structs; nulls are NaN."""
    return np.stack([np.asarray(structs.field(f).to_numpy(zero_copy_only=False), dtype=float) for f in fields], axis=1) if len(structs) else np.zeros((0, len(fields)))


def lengths(lists: pa.ListArray) -> np.ndarray:
    """How many items each list has; a null list has none."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _fit_columns(fits: np.ndarray, some: np.ndarray) -> list[pa.Array]:
    return [pa.array(c, mask=~some) for c in fits.T]


def _fit_schema(df: DataFrame, keep: list[str]) -> str:
    return ", ".join([*(f"`{k}` {t}" for k, t in df.select(*keep).dtypes), *(f"{f} double" for f in G.FIELDS), "misfit double"])


def fit_boxes(meshes: DataFrame, keep: list[str], strategy: Strategy = fit_box) -> DataFrame:
    """(keep, dx..rz, misfit): one box per row of `meshes`, whose column `points` is array<struct<x,y,z>>. Rows without points give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            n = lengths(lists)
            fits = fit_sets(numbers(lists.flatten(), ("x", "y", "z")), n, strategy)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *_fit_columns(fits, n > 0)], names=[*keep, *G.FIELDS, "misfit"])

    return spread(meshes.select(*keep, "points")).mapInArrow(run, _fit_schema(meshes, keep))


def box_corners(boxes: np.ndarray) -> np.ndarray:
    """(n x 8 x 3): the corners of boxes (n x 9), in the order of `geometry.corners`."""
    half = np.array(list(product((-0.5, 0.5), repeat=3)))
    edges = frames(boxes) * boxes[:, None, :3]
    return boxes[:, None, 3:6] + np.stack([edges[:, i, None, 0] * half[:, 0] + edges[:, i, None, 1] * half[:, 1] + edges[:, i, None, 2] * half[:, 2] for i in range(3)], axis=2)


def fit_designs(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, dx..rz, misfit): `fit_boxes` of the corners of all parts of each row's `parts`, without listing the corners in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            n = lengths(lists) * 8
            fits = fit_sets(box_corners(numbers(lists.flatten())).reshape(-1, 3), n)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *_fit_columns(fits, n > 0)], names=[*keep, *G.FIELDS, "misfit"])

    return parsed.select(*keep, "parts").mapInArrow(run, _fit_schema(parsed, keep))


def fit_parts(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, fits): for each part of a row's `parts` the box fitted around its corners, an array of box structs."""
    box = "struct<" + ", ".join(f"{f}: double" for f in G.FIELDS) + ">"
    schema = ", ".join([*(f"`{k}` {t}" for k, t in parsed.select(*keep).dtypes), f"fits array<{box}>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            boxes = numbers(lists.flatten())
            fits = fit_sets(box_corners(boxes).reshape(-1, 3), np.full(len(boxes), 8))
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths(lists))]).astype(np.int32))
            found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x) for x in fits.T[:9]], list(G.FIELDS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], names=[*keep, "fits"])

    return parsed.select(*keep, "parts").mapInArrow(run, schema)


def frames(boxes: np.ndarray) -> np.ndarray:
    """The rotation matrices of boxes (n x 9)."""
    (sx, sy, sz), (kx, ky, kz) = ([f(np.radians(boxes[:, 6 + i])) for i in range(3)] for f in (np.sin, np.cos))
    rows = ((kz * ky, kz * sy * sx - sz * kx, kz * sy * kx + sz * sx), (sz * ky, sz * sy * sx + kz * kx, sz * sy * kx - kz * sx), (-sy, ky * sx, ky * kx))
    return np.stack([np.stack(r, axis=1) for r in rows], axis=1)


def _planes(boxes: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outward normals (n x 6 x 3) and offsets (n x 6) of the faces, seen from the origin."""
    axes = frames(boxes).transpose(0, 2, 1)
    at = np.einsum("nkc,nc->nk", axes, boxes[:, 3:6] - origin)
    half = boxes[:, :3] / 2
    return np.concatenate([axes, -axes], axis=1), np.concatenate([at + half, half - at], axis=1)


_ROOM = 20  # corners of a face: 4, and at most one more with each of 11 cuts


def _cut(poly: np.ndarray, n: np.ndarray, normal: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polygons (p x _ROOM x 3, with n corners each) cut by one half space each."""
    side = np.einsum("pwc,pc->pw", poly, normal) - offset[:, None]
    side[np.abs(side) < 1e-9 * (1 + np.abs(poly).max(axis=(1, 2)))[:, None]] = 0.0  # in the cutting plane
    index = np.arange(_ROOM)[None, :]
    valid = index < n[:, None]
    after = np.where(index + 1 < n[:, None], index + 1, 0)
    side2, poly2 = np.take_along_axis(side, after, 1), np.take_along_axis(poly, after[..., None], 1)
    keep, cross = valid & (side <= 0), valid & (side * side2 < 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = poly + (poly2 - poly) * np.where(cross, side / (side - side2), 0.0)[..., None]
    slot = np.cumsum(keep.astype(int) + cross, axis=1) - keep - cross
    out = np.zeros_like(poly)
    for mask, value, place in ((keep, poly, slot), (cross, at, slot + keep)):
        r, c = np.nonzero(mask & (place < _ROOM))
        out[r, place[r, c]] = value[r, c]
    return out, np.minimum((keep.astype(int) + cross).sum(axis=1), _ROOM)


def common_volumes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The common volume of each pair of boxes (n x 9 each: dx..rz), by cutting each face's plane with all other half spaces.

    Faces of both boxes in one plane count once. Boxes that only touch have none.
    """
    a, b = np.atleast_2d(np.asarray(a, float)), np.atleast_2d(np.asarray(b, float))
    if not len(a):
        return np.zeros(0)
    origin = a[:, 3:6]
    (na, da), (nb, db) = _planes(a, origin), _planes(b, origin)
    normal, offset = np.concatenate([na, nb], axis=1), np.concatenate([da, db], axis=1)
    same = (np.abs(nb[:, :, None, :] - na[:, None, :, :]).max(axis=3) < 1e-9) & (np.abs(db[:, :, None] - da[:, None, :]) < 1e-9)
    double = np.concatenate([np.zeros((len(a), 6), bool), same.any(axis=2)], axis=1)
    reach = 2.0 * np.linalg.norm(a[:, :3], axis=1)
    volume = np.zeros(len(a))
    for k in range(12):
        n, d = normal[:, k], offset[:, k]
        helper = np.where(np.abs(n[:, :1]) < 0.9, np.array([[1.0, 0, 0]]), np.array([[0, 1.0, 0]]))
        u = np.cross(n, helper)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v = np.cross(n, u)
        poly, count = np.zeros((len(a), _ROOM, 3)), np.full(len(a), 4)
        for c, (i, j) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))):
            poly[:, c] = n * d[:, None] + reach[:, None] * (i * u + j * v)
        for m in range(12):
            if m != k:
                poly, count = _cut(poly, count, normal[:, m], offset[:, m])
        index = np.arange(_ROOM)[None, :]
        after = np.where(index + 1 < count[:, None], index + 1, 0)
        turn = np.cross(poly, np.take_along_axis(poly, after[..., None], 1))
        area = np.linalg.norm(np.where((index < count[:, None])[..., None], turn, 0.0).sum(axis=1), axis=1) / 2
        volume += np.where(double[:, k] | (count < 3), 0.0, d * area / 3)
    flat = np.minimum(a[:, :3].min(axis=1), b[:, :3].min(axis=1)) <= 0
    return np.where(flat, 0.0, np.maximum(volume, 0.0))


def common_volume(a: np.ndarray, b: np.ndarray) -> float:
    """The common volume of two boxes (dx..rz)."""
    return float(common_volumes(a, b)[0])


def overlap_volume(a: Column, b: Column) -> Column:
    """The common volume of two box structs with any rotation, by Arrow batches; null where one is null."""

    @F.pandas_udf("double")
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        left, right = x[list(G.FIELDS)].to_numpy(float), y[list(G.FIELDS)].to_numpy(float)
        out, full = np.full(len(left), np.nan), ~(np.isnan(left).any(axis=1) | np.isnan(right).any(axis=1))
        out[full] = common_volumes(left[full], right[full])
        return pd.Series(out).astype("Float64")

    return run(a, b)


def with_volume(pairs: DataFrame) -> DataFrame:
    """Adds `volume` to pairs with a and b: in closed form where both are upright, by clipping for the other pairs that meet.

    The kernel gets nulls for the pairs that need no clipping, and passes over them. Needs `gap`.
    """
    upright = " and ".join(f"{s}.{r} = 0" for s in ("a", "b") for r in ("rx", "ry", "rz"))
    hard = F.expr(f"gap <= 0 and not ({upright})")
    clipped = overlap_volume(F.when(hard, F.col("a")), F.when(hard, F.col("b")))
    return pairs.withColumn("_clipped", clipped).withColumn("volume", F.when(F.col("gap") > 0, 0.0).when(hard, F.col("_clipped")).otherwise(G.aligned_overlap("a", "b"))).drop("_clipped")


# Reasons (below, and in completions); smallest size of a part, height limit of the reward, the floor slab, and the scales of the penalties.
LEAST_SIZE, HEIGHT = 5.0, 1000.0
FLOOR = dict(zip(G.FIELDS, (400.0, 1000.0, 1.0, 200.0, 200.0, -0.5, 0.0, 0.0, 0.0)))
GAP_SCALE, VOLUME_SCALE = 0.2, 0.001


def rewards(parsed: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, reward, reason, hits): how well the last part of each design goes with the parts before it.

    In this order: no part before it gives 0.5; a size below the least gives 0; a part below the floor gives
    1 - tanh of the worst violation, one otherwise outside the work volume 0 (sizes are not turned for this); any
    overlap gives 1 - tanh(0.001 * sum of the common volumes), with the parts hit; else 1 - tanh(0.2 * the gap) to the
    floor or the nearest part, of equal ones the floor. A column `early` (reward, reason) that is not null comes before all of
    these. Rows without parts and without it are left out; the key tells designs apart.
    """
    given = F.col("early") if "early" in parsed.columns else F.lit(None).cast("struct<reward: double, reason: string>")
    rest = F.when(F.size("parts") > 0, F.expr("slice(parts, 1, size(parts) - 1)"))
    new = parsed.select(key, given.alias("given"), F.try_element_at("parts", F.lit(-1)).alias("a"), rest.alias("rest")).filter("given is not null or a is not null")
    low = [F.col(f"a.{c}") - F.col(f"a.{d}") / 2 for d, c in (("dx", "cx"), ("dy", "cy"), ("dz", "cz"))]
    high = [F.col(f"a.{c}") + F.col(f"a.{d}") / 2 for d, c in (("dx", "cx"), ("dy", "cy"), ("dz", "cz"))]
    limit = (G.BOUNDS[0], G.BOUNDS[1], HEIGHT)
    worst = F.greatest(*[-x for x in low], *[x - m for x, m in zip(high, limit)])
    early = (
        F.when(F.col("given").isNotNull(), F.col("given"))
        .when(F.size("rest") == 0, F.struct(F.lit(0.5).alias("reward"), F.lit("first_part").alias("reason")))
        .when(F.least("a.dx", "a.dy", "a.dz") < LEAST_SIZE, F.struct(F.lit(0.0).alias("reward"), F.lit("too_small").alias("reason")))
        .when(low[2] < 0, F.struct((1 - F.tanh(worst)).alias("reward"), F.lit("below_floor").alias("reason")))
        .when(worst > 0, F.struct(F.lit(0.0).alias("reward"), F.lit("out_of_bounds").alias("reason")))
    )
    new = new.withColumn("early", early)
    # one pass over the others of a design, the floor first; a design that is decided already has no others
    floor = F.struct(*[F.lit(v).alias(k) for k, v in FLOOR.items()])
    others = F.when(F.col("early").isNull(), F.concat(F.array(floor), "rest"))
    rows = new.select(key, "early", "a", F.posexplode_outer(others).alias("i", "b"))
    names = rows.columns
    gapped = rows.select("*", *G.axis_columns("a"), *G.axis_columns("b")).select(*names, G.sat_gap("a", "b").alias("real_gap"))
    # only the volumes of pairs that meet count, and never the floor's
    met = with_volume(gapped.withColumn("gap", F.when(F.col("i") > 0, F.col("real_gap")).otherwise(1.0)))
    got = met.groupBy(key).agg(
        F.first("early", True).alias("early"),
        F.sum(F.when(F.col("i") > 0, F.col("volume"))).alias("volume"),
        F.array_sort(F.collect_list(F.when((F.col("i") > 0) & (F.col("volume") > 0), F.col("i") - 1))).alias("hits"),
        F.min(F.when(F.col("i").isNotNull(), F.struct(F.col("real_gap").alias("gap"), "i"))).alias("near"),
    )
    none = F.array().cast("array<int>")
    late = (
        F.when(F.col("early").isNotNull(), F.struct(F.col("early.reward").alias("reward"), F.col("early.reason").alias("reason"), none.alias("hits")))
        .when(F.col("volume") > 0, F.struct((1 - F.tanh(F.col("volume") * VOLUME_SCALE)).alias("reward"), F.lit("overlap").alias("reason"), F.col("hits")))
        .otherwise(F.struct((1 - F.tanh(F.col("near.gap") * GAP_SCALE)).alias("reward"), F.when(F.col("near.i") == 0, "floor_gap").otherwise("part_gap").alias("reason"), F.when(F.col("near.i") > 0, F.array(F.col("near.i") - 1)).otherwise(none).alias("hits")))
    )
    return got.select(key, late.alias("x")).select(key, "x.*")


def reward_summary(rewarded: DataFrame) -> DataFrame:
    """(reason, n, mean, std): population standard deviation."""
    return rewarded.groupBy("reason").agg(F.count("*").alias("n"), F.avg("reward").alias("mean"), F.stddev_pop("reward").alias("std"))
