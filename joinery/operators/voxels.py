"""Voxel models as tables of (i, j, k): from boxes, comparisons, coordinates, run-length coding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.functions import geometry as G
from joinery.operators.solids import frames, lengths, numbers
from joinery.operators.tables import iou

#: Columns of voxels that a task holds at once.
COLUMNS = 200_000
#: Voxels of a dense array, a byte each.
CELLS = 8_000_000
#: Boxes that are prepared together, with all of a model's.
BOXES = 12_000
#: The least slope of a box's axes over which runs are worked out by division.
STEEP = 1e-6


def of_boxes(boxes: DataFrame, keep: list[str], size: float) -> DataFrame:
    """(keep, i, j, k): the distinct voxels of edge `size` whose centre lies in a box (column p, a box struct).

    Candidates are the voxels of the box's own bounding range; the test is three dot products. Only distinct voxels are kept.
    """
    b = boxes.select(*keep, "p", *G.axis_columns("p"))
    half = [sum((F.abs(F.col(f"p_{i}{k}")) * F.col(f"p.{d}") / 2 for k, d in enumerate(("dx", "dy", "dz"))), F.lit(0.0)) for i in range(3)]
    for n, (axis, c) in enumerate(zip("ijk", ("cx", "cy", "cz"))):
        b = b.withColumn(f"{axis}_lo", F.floor((F.col(f"p.{c}") - half[n]) / size).cast("int")).withColumn(f"{axis}_hi", F.ceil((F.col(f"p.{c}") + half[n]) / size).cast("int"))
    for axis in "ijk":
        b = b.withColumn(axis, F.explode(F.sequence(f"{axis}_lo", f"{axis}_hi")))
    off = [(F.col(a) + 0.5) * size - F.col(f"p.{c}") for a, c in zip("ijk", ("cx", "cy", "cz"))]
    inside = F.lit(True)
    for k, d in enumerate(("dx", "dy", "dz")):
        inside = inside & (F.abs(sum((off[i] * F.col(f"p_{i}{k}") for i in range(3)), F.lit(0.0))) <= F.col(f"p.{d}") / 2)
    return b.filter(inside).select(*keep, "i", "j", "k").distinct()


def box_iou(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(common, either, iou) of the solids of two tables of boxes."""
    return iou(of_boxes(a, [], size), of_boxes(b, [], size))


def _first(low: np.ndarray, end: np.ndarray, base: np.ndarray, slope: np.ndarray, centre: np.ndarray, limit: np.ndarray, above: bool, size: float) -> np.ndarray:
    """Per column, the first k from low on, else end, whose centre has base + offset * slope >= limit (above: > limit); slopes are positive.

    The sum never falls with k, so the guess by division is moved until the test of `of_boxes` itself holds on one side only.
    """

    def holds(at: np.ndarray, k: np.ndarray) -> np.ndarray:
        x = base[at] + ((k + 0.5) * size - centre[at]) * slope[at]
        return x > limit[at] if above else x >= limit[at]

    guess = np.ceil(((limit - base) / slope + centre) / size - 0.5)
    k = np.clip(guess, low, end).astype(np.int64)
    at = np.flatnonzero(k < end)
    while len(at := at[~holds(at, k[at])]):
        k[at] += 1
        at = at[k[at] < end[at]]
    at = np.flatnonzero(k > low)
    while len(at := at[holds(at, k[at] - 1)]):
        k[at] -= 1
        at = at[k[at] > low[at]]
    return k


def _runs(b: dict[str, np.ndarray], box: np.ndarray, i: np.ndarray, j: np.ndarray, size: float) -> tuple[np.ndarray, ...]:
    """(box, i, j, first k, end): the voxels of each box in each column (i, j) of its range; they are one run, as a box is convex."""
    x, y = (i + 0.5) * size - b["c"][box, 0], (j + 0.5) * size - b["c"][box, 1]
    base = np.stack([x * b["axes"][box, 0, n] + y * b["axes"][box, 1, n] for n in range(3)])
    half = b["d"] / 2
    flat = b["axes"][:, 2, :] == 0
    keep = np.all([~flat[box, n] | (np.abs(base[n]) <= half[box, n]) for n in range(3)], axis=0)
    box, i, j, base = box[keep], i[keep], j[keep], base[:, keep]
    low, end = b["lo"][box, 2].copy(), b["hi"][box, 2] + 1
    for n in range(3):
        at = np.flatnonzero(~flat[box, n] & (low < end))
        slope, h, centre = b["axes"][box[at], 2, n], half[box[at], n], b["c"][box[at], 2]
        rising = base[n, at] * np.sign(slope)
        start = _first(low[at], end[at], rising, np.abs(slope), centre, -h, False, size)
        end[at] = _first(low[at], end[at], rising, np.abs(slope), centre, h, True, size)
        low[at] = start
    some = low < end
    return box[some], i[some], j[some], low[some], end[some]


def _lengths(start: np.ndarray, end: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Per owner, how many integers lie in at least one of the ranges start <= x < end; ranges of different owners don't meet."""
    order = np.argsort(start, kind="stable")
    start, end, owner = start[order], end[order], owner[order]
    seen = np.maximum.accumulate(np.concatenate([start[:1], end[:-1]]))
    return np.bincount(owner, np.maximum(0, end - np.maximum(start, seen)), owners)


def _counts(b: dict[str, np.ndarray], models: int, size: float) -> np.ndarray:
    """(models x 3): the voxels of side a, of side b, and of either; `b` has the boxes, ordered by model.

    All columns of all models are laid end to end on one line, so that voxels are integers and runs are ranges of them.
    """
    total = np.zeros((models, 3))
    wide, deep = (b["hi"] - b["lo"] + 1)[:, 0], (b["hi"] - b["lo"] + 1)[:, 1]
    at = np.searchsorted(b["model"], np.arange(models + 1))
    before = np.concatenate([[0], np.cumsum(wide * deep)])[at]  # columns of the earlier models
    todo, first = [], 0  # (first box, end, first i, end): boxes of some models; a model of many columns is cut by i
    for m in range(models):
        columns = int(before[m + 1] - before[m])
        if before[m + 1] - before[first] > COLUMNS and first < m:
            todo.append((at[first], at[m], None, None))
            first = m
        if columns > COLUMNS:
            lo, hi = int(b["lo"][at[m] : at[m + 1], 0].min()), int(b["hi"][at[m] : at[m + 1], 0].max()) + 1
            step = max(1, (hi - lo) * COLUMNS // columns)
            todo += [(at[m], at[m + 1], k, min(hi, k + step)) for k in range(lo, hi, step)]
            first = m + 1
    if first < models:
        todo.append((at[first], at[models], None, None))
    for start, stop, i_from, i_to in todo:
        lo, hi = b["lo"][start:stop, 0], b["hi"][start:stop, 0] + 1
        if i_from is not None:
            lo, hi = np.maximum(lo, i_from), np.minimum(hi, i_to)
        rows = np.maximum(0, hi - lo)
        n = rows * deep[start:stop]
        if not n.sum():
            continue
        box = np.repeat(np.arange(start, stop), n)
        nth = np.arange(len(box)) - np.repeat(np.cumsum(n) - n, n)
        i, j = np.repeat(lo, n) + nth // deep[box], b["lo"][box, 1] + nth % deep[box]
        box, i, j, low, end = _runs(b, box, i, j, size)
        if not len(box):
            continue
        owner = b["model"][box]
        base = [x.min() for x in (i, j, low)]
        across, along = int(j.max() - base[1]) + 1, int(end.max() - base[2]) + 1
        line = (((owner - owner[0]) * (int(i.max() - base[0]) + 1) + i - base[0]) * across + j - base[1]) * along - base[2]
        for n, side in enumerate((~b["b"][box], b["b"][box], slice(None))):
            if len(owner[side]):
                total[:, n] += _lengths(line[side] + low[side], line[side] + end[side], owner[side], models)
    return total


def _within(b: dict[str, np.ndarray], size: float) -> tuple[np.ndarray, np.ndarray]:
    """(lo, end), each boxes x 3: the voxels from lo up to end per axis of the world that can lie in a box.

    Where an axis of a box is an axis of the world, exactly those that the test of `of_boxes` takes, else those of the bounding range.
    """
    lo, end = b["lo"].copy(), b["hi"] + 1
    straight = (np.abs(b["axes"]) == 1) & ((b["axes"] != 0).sum(axis=1, keepdims=True) == 1)
    box, i, k = np.nonzero(straight)
    centre, half = b["c"][box, i], b["d"][box, k] / 2
    offset = lambda x: (x + 0.5) * size - centre
    for sign, out in ((-1, lo), (1, end)):  # the first voxel that is inside, and the first that is not any more; the guess is off by one at most
        x = np.ceil((centre + sign * half) / size - 0.5).astype(np.int64) - 1
        for _ in range(2):
            x += offset(x) < -half if sign < 0 else offset(x) <= half
        out[box, i] = np.clip(x, lo[box, i], end[box, i])
    return lo, np.maximum(lo, end)


def prepared(boxes: np.ndarray, axes: np.ndarray, size: float) -> dict:
    """What `agreement` needs of boxes (n x 6 or more: dx, dy, dz, cx, cy, cz) and their axes (n x 3 x 3): all numbers must be finite.

    from, end: the voxels of a box's range. pieces: which of these lie in the box, None if all do; see `_piece`.
    """
    b = {"d": boxes[:, :3], "c": boxes[:, 3:6], "axes": axes}
    half = (np.abs(axes) * b["d"][:, None, :] / 2).sum(axis=2)
    b["lo"], b["hi"] = np.floor((b["c"] - half) / size).astype(np.int64), np.ceil((b["c"] + half) / size).astype(np.int64)
    b["from"], b["end"] = _within(b, size)
    shape = b["end"] - b["from"]
    bent = (axes != 0).sum(axis=1) > 1  # boxes x axes of the box that are no axis of the world
    b["bent"], b["some"] = bent, (shape > 0).all(axis=1)
    b["place"], b["pieces"] = list(zip(b["from"].tolist(), b["end"].tolist())), [None] * len(boxes)
    two, three = bent.sum(axis=1) == 2, (bent.sum(axis=1) == 3) & ((axes[:, 2] == 0) | (np.abs(axes[:, 2]) >= STEEP)).all(axis=1)
    # the two axes of the world over which a piece varies: not the one about which the box is turned
    about = (axes != 0).sum(axis=2).argmin(axis=1)
    across = np.where(two[:, None], np.array([[1, 2], [0, 2], [0, 1]])[about], [0, 1])
    area = np.take_along_axis(shape, across, axis=1).astype(float).prod(axis=1)
    own = (two | three) & b["some"] & (area <= COLUMNS)
    b["later"] = bent.any(axis=1) & ~own  # worked out where they are painted
    for kind, make in ((two, _flat_pieces), (three, _run_pieces)):
        todo = np.flatnonzero(own & kind)
        part = (np.cumsum(area[todo]) // COLUMNS).astype(int)
        for k in np.unique(part):
            for n, piece in make(b, todo[part == k], across[todo[part == k]], size):
                b["pieces"][n] = piece
    return b


def _sheets(b: dict, boxes: np.ndarray, across: np.ndarray, size: float) -> tuple:
    """Cells of the boxes over two axes of the world, one box after another: numbers of cells per box, of rows per box and of cells per row, and per axis of the box the sum of the two axes' parts of a centre's offset from the box's centre."""
    at = np.arange(len(boxes))
    lo, end = (np.stack([b[k][boxes, across[:, i]] for i in (0, 1)], axis=1) for k in ("from", "end"))
    n, m = (end - lo).T
    along = []
    for i, count in ((0, n), (1, m)):  # per box and row, and per box and column
        own = np.repeat(at, count)
        x = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[own, i]
        off = (x + 0.5) * size - b["c"][boxes[own], across[own, i]]
        along.append(off[:, None] * b["axes"][boxes[own], across[own, i]])
    width = np.repeat(m, n)  # of each row
    column = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width - np.repeat(np.cumsum(m) - m, n), width)
    return n * m, n, m, [np.repeat(along[0][:, k], width) + along[1][column, k] for k in range(3)]


def _flat_pieces(b: dict, boxes: np.ndarray, across: np.ndarray, size: float) -> Iterator[tuple[int, np.ndarray]]:
    """(box, piece) of boxes turned about one axis of the world: one sheet, the same along that axis."""
    cells, n, m, sums = _sheets(b, boxes, across, size)
    inside = np.ones(cells.sum(), bool)
    for k in range(3):
        inside &= (np.abs(sums[k]) <= np.repeat(b["d"][boxes, k] / 2, cells)) | np.repeat(~b["bent"][boxes, k], cells)
    for box, x, rows, columns, (i, j) in zip(boxes.tolist(), np.split(inside, np.cumsum(cells)[:-1]), n.tolist(), m.tolist(), across.tolist()):
        yield box, x.reshape([rows if k == i else columns if k == j else 1 for k in range(3)])


def _run_pieces(b: dict, boxes: np.ndarray, across: np.ndarray, size: float) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(box, piece) of boxes turned freely: first voxel and end of the run in each column, counted from the box's range; a box is convex."""
    cells, n, m, sums = _sheets(b, boxes, across, size)
    each = lambda x: np.repeat(x, cells)
    centre, low = each(b["c"][boxes, 2]), each(b["from"][boxes, 2])
    start, stop = low.astype(float), each(b["end"][boxes, 2]).astype(float)
    for k in range(3):
        slope, half = each(b["axes"][boxes, 2, k]), each(b["d"][boxes, k] / 2)
        level = slope == 0
        stop[level & (np.abs(sums[k]) > half)] = -np.inf
        slope[level] = np.inf  # no limit along the column
        middle = (centre - sums[k] / slope) / size - 0.5
        reach = np.where(level, np.inf, half / (np.abs(slope) * size))
        for sign, bound in ((-1, start), (1, stop)):
            x = middle + sign * reach
            at = np.ceil(x) if sign < 0 else np.floor(x) + 1
            with np.errstate(invalid="ignore"):
                near = np.flatnonzero(np.abs(x - np.rint(x)) < 1e-6)
            if len(near):  # the test itself decides where it is that close
                whole = np.rint(x[near])
                inside = np.abs(sums[k][near] + ((whole + 0.5) * size - centre[near]) * slope[near]) <= half[near]
                at[near] = whole + (~inside if sign < 0 else inside)
            (np.maximum if sign < 0 else np.minimum)(bound, at, out=bound)
    kind = np.int16 if (b["end"] - b["from"])[boxes, 2].max() < 32_000 else np.int64
    start, stop = (np.minimum(start, each(b["end"][boxes, 2])) - low).astype(kind), np.maximum(stop - low, 0).astype(kind)
    cut = np.cumsum(cells)[:-1]
    for box, x, y, rows, columns in zip(boxes.tolist(), np.split(start, cut), np.split(stop, cut), n.tolist(), m.tolist()):
        yield box, (x.reshape(rows, columns, 1), y.reshape(rows, columns, 1))


def _piece(b: dict, n: int, size: float) -> np.ndarray | None:
    """Which voxels of the range of box n lie in it, as an array that broadcasts to the range; None where all do. The test is that of `of_boxes`."""
    piece, (lo, end) = b["pieces"][n], b["place"][n]
    if isinstance(piece, tuple):
        z = np.arange(end[2] - lo[2], dtype=piece[0].dtype)
        out = z >= piece[0]
        out &= z < piece[1]
        return out
    if piece is not None or not b["later"][n]:
        return piece
    off = [((np.arange(lo[i], end[i]) + 0.5) * size - b["c"][n, i]).reshape([-1 if k == i else 1 for k in range(3)]) for i in range(3)]
    out = True
    for k in np.flatnonzero(b["bent"][n]):
        out = (np.abs(sum(off[i] * b["axes"][n, i, k] for i in range(3) if b["axes"][n, i, k] != 0)) <= b["d"][n, k] / 2) & out
    return out


def _place(b: dict, n: int, lo: list[int]) -> tuple[slice, ...]:
    """The range of box n in an array that begins at voxel lo."""
    (i, j, k), (x, y, z), (x2, y2, z2) = lo, *b["place"][n]
    return slice(x - i, x2 - i), slice(y - j, y2 - j), slice(z - k, z2 - k)


def _paint(b: dict, boxes: np.ndarray, lo: np.ndarray, end: np.ndarray, size: float) -> np.ndarray:
    """The voxels lo <= x < end that lie in at least one of the boxes, which are within, as a dense array."""
    out, lo = np.zeros(end - lo, bool), lo.tolist()
    for n, some in zip(boxes.tolist(), b["some"][boxes].tolist()):
        if some:
            piece = _piece(b, n, size)
            if piece is None:
                out[_place(b, n, lo)] = True
            else:
                out[_place(b, n, lo)] |= piece
    return out


def _count(b: dict, n: int, piece: np.ndarray | None) -> int:
    """The voxels of box n."""
    cells = int((b["end"][n] - b["from"][n]).prod())
    return cells if piece is None else np.count_nonzero(piece) * cells // piece.size


def agreement(b: dict, one: np.ndarray, other: np.ndarray, size: float) -> float:
    """The share of the voxels in either solid that are in both; solids are the boxes of `prepared` with these numbers.

    Solids are painted into a dense array of up to CELLS voxels; larger ones are counted by runs.
    """
    every = np.concatenate([one, other])
    if not len(every):
        return 0.0
    lo, end = b["from"][every].min(axis=0), b["end"][every].max(axis=0)
    if np.prod(end.astype(float) - lo) > CELLS:  # as floats, which don't overflow
        part = {k: b[k][every] for k in ("d", "c", "axes", "lo", "hi")} | {"model": np.zeros(len(every), np.int64), "b": np.arange(len(every)) >= len(one)}
        a, c, either = _counts(part, 1, size)[0]
    else:
        solid = _paint(b, one, lo, end, size)
        a = np.count_nonzero(solid)
        if len(other) == 1:  # one box is not painted
            n = int(other[0])
            piece = _piece(b, n, size) if b["some"][n] else None
            inside, c = solid[_place(b, n, lo.tolist())], _count(b, n, piece)
            either = a + c - np.count_nonzero(inside if piece is None else inside & piece)
        else:
            there = _paint(b, other, lo, end, size)
            c, either = np.count_nonzero(there), np.count_nonzero(solid | there)
    return float((a + c - either) / either) if either else 0.0


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the lists of a column have come to BOXES items."""
    for batch in batches:
        part = np.cumsum(lengths(batch.column(column))) // BOXES
        first = np.flatnonzero(np.diff(part, prepend=-1))
        for k, n in zip(first.tolist(), np.diff(first, append=len(batch)).tolist()):
            yield batch.slice(k, n)


def fit_scores(rows: DataFrame, keep: list[str], a: str, b: str, size: float) -> DataFrame:
    """(keep, iou) of rows with two arrays of box structs: the voxel agreement of their solids, 0 where there is no voxel; boxes with unknown numbers don't count."""
    schema = ", ".join([*(f"`{k}` {t}" for k, t in rows.select(*keep).dtypes), "iou double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(keep)):
            first, second = batch.column(len(keep)), batch.column(len(keep) + 1)
            boxes = np.concatenate([numbers(first.flatten()), numbers(second.flatten())])
            n, m = lengths(first), lengths(second)
            known = np.isfinite(boxes).all(axis=1)
            place = np.cumsum(known) - known  # among the known boxes
            boxes = prepared(boxes[known], frames(boxes[known]), size)
            at = [np.concatenate([[0], np.cumsum(x)]) for x in (n, m)]
            at[1] += n.sum()
            ranges = [np.concatenate([place, [known.sum()]])[x] for x in at]
            one, other = ([np.arange(x, y) for x, y in zip(r[:-1], r[1:])] for r in ranges)
            share = [agreement(boxes, x, y, size) for x, y in zip(one, other)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(share, pa.float64())], names=[*keep, "iou"])

    return rows.select(*keep, a, b).mapInArrow(run, schema)


def scored_fit(pairs: DataFrame, key: list[str], size: float) -> DataFrame:
    """(key, iou) from (key, side, p): per key, the voxel agreement of the boxes of side a and of side b; 0 where there is no voxel.

    The voxels are those of `of_boxes`, painted or counted instead of listed; a task holds the boxes of one key.
    """
    box = F.struct(*[F.col(f"p.{f}").cast("double").alias(f) for f in G.FIELDS])
    side = lambda s: F.collect_list(F.when(F.col("side") == s, box)).alias(s)
    return fit_scores(pairs.groupBy(*key).agg(side("a"), side("b")), key, "a", "b", size)


def sparse(dense: DataFrame, key: list[str]) -> DataFrame:
    """The filled voxels of (key, i, j, k, filled)."""
    return dense.filter("filled").select(*key, "i", "j", "k")


def dense(points: DataFrame, key: list[str], dims: tuple[int, int, int]) -> DataFrame:
    """(key, i, j, k, filled) for every cell of the dimensions; points outside are dropped, a model without a point inside has no cells.

    The grid of each model is joined with its points, so the work is the number of cells.
    """
    x, y, z = dims
    inside = points.filter(F.col("i").between(0, x - 1) & F.col("j").between(0, y - 1) & F.col("k").between(0, z - 1)).select(*key, "i", "j", "k").distinct()
    at = inside.select(*key, (F.col("i") * (y * z) + F.col("j") * z + F.col("k")).cast("int").alias("_c"), F.lit(True).alias("_in"))
    grid = inside.select(*key).distinct().select(*key, F.explode(F.sequence(F.lit(0), F.lit(x * y * z - 1))).alias("_c"))
    i, j, k = unravel(F.col("_c"), (x, y, z))
    return grid.join(at, [*key, "_c"], "left").select(*key, i.alias("i"), j.alias("j"), k.alias("k"), F.col("_in").isNotNull().alias("filled"))


def unravel(c: Column, dims: tuple[int, int, int]) -> tuple[Column, Column, Column]:
    """The coordinates of a flat index, the last one running fastest."""
    _, y, z = dims
    return F.floor(c / (y * z)).cast("int"), F.pmod(F.floor(c / z), F.lit(y)).cast("int"), F.pmod(c, F.lit(z)).cast("int")


def to_world(i: Column, dim: int, translate: float, scale: float) -> Column:
    """The world coordinate of a voxel index's centre."""
    return (i + 0.5) / dim * scale + translate


def to_voxel(x: Column, dim: int, translate: float, scale: float) -> Column:
    """The voxel index of a world coordinate."""
    return F.floor((x - translate) / scale * dim).cast("int")
