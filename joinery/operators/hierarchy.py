"""Which level of a part tree to fit boxes at, and which scale to fit at.

Trees are adjacency rows (key, node_id, parent_id, objs, depth). A mesh is fitted by itself; then a model, its tree and one box per mesh,
is one row, and is searched from the deepest level up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinery.functions import geometry as G
from joinery.operators import voxels as V
from joinery.operators.solids import Strategy, box_corners, fit_box, fit_boxes, fit_sets, frames, lengths, numbers
from joinery.session import cut

#: The point about which models are scaled: the middle of the work volume's floor.
ABOUT = (G.BOUNDS[0] / 2, G.BOUNDS[1] / 2, 0.0)


def _boxes(fits: DataFrame, keep: list[str]) -> DataFrame:
    return fits.filter("dx is not null").select(*keep, F.struct(*G.FIELDS).alias("p"))


def mesh_boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mesh_id, p): the fitted box of each mesh of (keys, mesh_id, x, y, z); a task holds one mesh's points."""
    rows = points.groupBy(*keys, "mesh_id").agg(F.collect_list(F.struct("x", "y", "z")).alias("points"))
    return _boxes(fit_boxes(rows, [*keys, "mesh_id"]), [*keys, "mesh_id"])


def scaled(points: DataFrame, scales: list[float], about: tuple[float, float, float] = ABOUT) -> DataFrame:
    """The points once per scale, scaled about a fixed point; adds `scale`."""
    rows = points.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    return rows.withColumns({a: (F.col(a) - c) * F.col("scale") + c for a, c in zip("xyz", about)})


def _grown(boxes: np.ndarray, scale: float) -> np.ndarray:
    """Boxes (n x 9 or more) scaled about the point of `scaled`; turns stay."""
    out = boxes.copy()
    out[:, :3] *= scale
    out[:, 3:6] = (out[:, 3:6] - ABOUT) * scale + ABOUT
    return out


class _Tree:
    """The part tree of one model: numbers of boxes per node, and which of its nodes are asked for an own box or for a score."""

    def __init__(self, nodes: list[dict], meshes: dict[str, list[int]]) -> None:
        self.depth = {n["node_id"]: n["depth"] for n in nodes}
        self.solid = {n["node_id"]: [k for m in n["objs"] or [] for k in meshes.get(m, [])] for n in nodes}
        self.below: dict = {}
        for n in nodes:
            up = n["parent_id"]
            if up is not None and self.depth.get(up) == n["depth"] - 1:
                self.below.setdefault(up, []).append(n["node_id"])
        self.levels = sorted(self.depth, key=lambda x: -self.depth[x])
        self.filled: set = set()  # nodes that have a box in themselves or below
        for x in self.levels:
            if self.solid[x] or any(y in self.filled for y in self.below.get(x, [])):
                self.filled.add(x)
        self.parents = {x for x in self.levels if any(y in self.filled for y in self.below.get(x, []))}
        self.single = [x for x in self.levels if self.solid[x] and not (x in self.parents and self.depth[x] == 0)]

    def choose(self, own: dict, score: Callable[[list[int], list[int]], float]) -> tuple[list[int], float | None]:
        """(boxes, score): the boxes chosen at the roots, and the highest score of a root; own has the number of each node's one box."""
        got: dict = {}
        scores = []
        for x in self.levels:
            kids = [k for y in self.below.get(x, []) for k in got[y]]
            mine = [own[x]] if x in own else []
            if not kids:
                got[x], value = mine, score(self.solid[x], mine) if self.depth[x] == 0 and mine else 0.0
            elif self.depth[x] == 0:
                got[x], value = kids, score(self.solid[x], kids)
            else:
                got[x], value = (kids if score(self.solid[x], kids) > (score(self.solid[x], mine) if mine else 0.0) else mine), None
            if self.depth[x] == 0:
                scores.append(value)
        return [k for x in self.levels if self.depth[x] == 0 for k in got[x]], max(scores) if scores else None


def fit_trees(models: DataFrame, keys: list[str], scales: list[float], size: float = 5.0, strategy: Strategy = fit_box) -> DataFrame:
    """(keys, scale, score, boxes) of rows with `nodes` (array of node_id, parent_id, depth, objs) and `meshes` (array of mesh_id and box struct p): a model each.

    Each model is searched at each scale, and of these the one of the highest score is returned, of equal ones the smallest.
    A box of the search is fitted once and scaled; strategies with sizes of their own are asked at each scale. Only the scores that decide are
    worked out. A task holds models of BOXES meshes, and the voxels of one at a time.
    """
    box = "struct<" + ", ".join(f"{f}: double" for f in G.FIELDS) + ">"
    schema = ", ".join([*(f"`{k}` {t}" for k, t in models.select(*keys).dtypes), f"scale double, score double, boxes array<{box}>"])
    order = sorted(set(map(float, scales)))

    def results(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, lists = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1)
        flat, n = lists.flatten(), lengths(lists)
        names, boxes = flat.field("mesh_id").to_pylist(), numbers(flat.field("p"))
        known, first = np.isfinite(boxes).all(axis=1), np.cumsum(n) - n
        boxes[~known] = 0.0
        trees = []
        for at, count, rows in zip(first.tolist(), n.tolist(), nodes):
            meshes: dict = {}
            for k in range(at, at + count):
                if known[k]:
                    meshes.setdefault(names[k], []).append(k)
            trees.append(_Tree(rows or [], meshes))
        asked = [(k, x) for k, tree in enumerate(trees) for x in tree.single]
        members = [trees[k].solid[x] for k, x in asked]
        counts, every = np.array([len(m) for m in members], np.int64), np.array([k for m in members for k in m], np.int64)
        best: list = [None] * len(trees)
        ones = None
        for scale in order:
            parts = _grown(boxes, scale)
            if strategy is not fit_box:
                ones = fit_sets(box_corners(parts[every]).reshape(-1, 3), counts * 8, strategy)[:, :9]
            elif ones is None:
                ones = fit_sets(box_corners(boxes[every]).reshape(-1, 3), counts * 8)[:, :9]
            both = np.concatenate([parts, ones if strategy is not fit_box else _grown(ones, scale)])
            b = V.prepared(both, frames(both), size)
            own: list[dict] = [{} for _ in trees]
            for k, (tree, x) in enumerate(asked):
                own[tree][x] = len(parts) + k
            for k, tree in enumerate(trees):
                chosen, score = tree.choose(own[k], lambda x, y: V.agreement(b, np.array(x, int), np.array(y, int), size))
                if score is not None and (best[k] is None or score > best[k][1]):
                    best[k] = (scale, score, both[chosen])
        kept = [k for k, x in enumerate(best) if x is not None]
        out = np.concatenate([np.zeros((0, 9)), *[best[k][2] for k in kept]])
        ends = np.concatenate([[0], np.cumsum([len(best[k][2]) for k in kept])]).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in out.T], list(G.FIELDS)))
        return pa.RecordBatch.from_arrays(
            [*(c.take(pa.array(kept, pa.int64())) for c in batch.columns[: len(keys)]), pa.array([best[k][0] for k in kept], pa.float64()), pa.array([best[k][1] for k in kept], pa.float64()), found], names=[*keys, "scale", "score", "boxes"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(results, V.pieces(batches, len(keys) + 1))

    return models.select(*keys, "nodes", "meshes").mapInArrow(run, schema)


def _models(tree: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """A row per model with all its nodes and its boxes (keys, mesh_id, p)."""
    meshes = boxes.groupBy(*keys).agg(F.collect_list(F.struct("mesh_id", "p")).alias("meshes"))
    nodes = tree.groupBy(*keys).agg(F.collect_list(F.struct("node_id", "parent_id", "depth", "objs")).alias("nodes"))
    return nodes.join(meshes, keys, "left")


def search(tree: DataFrame, boxes: DataFrame, keys: list[str], size: float = 5.0, strategy: Strategy = fit_box) -> tuple[DataFrame, DataFrame]:
    """(keys, p) and (keys, score): the boxes chosen for each model, and their voxel agreement with it.

    A node's solid is the boxes of its meshes. Its children's boxes are kept if their agreement with the solid is higher
    than that of one box (fitted by the strategy) around the whole; at the root they are always kept, if there are any.
    """
    found = cut(fit_trees(_models(tree, boxes, keys), keys, [1.0], size, strategy))
    return found.select(*keys, F.explode("boxes").alias("p")), found.select(*keys, "score")


def best_scale(scores: DataFrame, key: str) -> DataFrame:
    """(key, scale, score): the scale of the highest score; of equal ones the smallest."""
    best = scores.groupBy(key).agg(F.max(F.struct("score", (-F.col("scale")).alias("s"))).alias("x"))
    return best.select(key, (-F.col("x.s")).alias("scale"), "x.score")


def fit_models(tree: DataFrame, points: DataFrame, keys: list[str], scales: list[float], size: float = 5.0, strategy: Strategy = fit_box) -> tuple[DataFrame, DataFrame]:
    """(keys, scale, p) and (keys, scale, score): the boxes of each model at the scale of its highest agreement.

    Meshes (keys, mesh_id, x, y, z) are fitted one by one; their boxes are scaled, and searched model by model at all scales.
    """
    found = cut(fit_trees(_models(tree, mesh_boxes(points, keys), keys), keys, scales, size, strategy))
    return found.select(*keys, "scale", F.explode("boxes").alias("p")), found.select(*keys, "scale", "score")
