import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from joinery.functions import geometry as G
from joinery.operators import designs as D
from joinery.operators import hierarchy as H
from joinery.operators import solids as S
from joinery.operators import voxels as V

BOX = "dx double, dy double, dz double, cx double, cy double, cz double, rx double, ry double, rz double"
angle = st.integers(-360, 360)


def boxes(n, seed, turn=True):
    r = np.random.default_rng(seed)
    return np.concatenate([r.uniform(5, 50, (n, 3)), r.uniform(-25, 25, (n, 3)), r.uniform(0, 180, (n, 3)) * turn], axis=1)


def corners(b):
    unit = np.array([[x, y, z] for x in (-0.5, 0.5) for y in (-0.5, 0.5) for z in (-0.5, 0.5)])
    return (unit * b[:3]) @ S.euler_matrix(*b[6:9]).T + b[3:6]


def gap(a, b):
    """Separating-axis gap by projecting corners."""
    p, q = corners(a), corners(b)
    u, v = S.euler_matrix(*a[6:9]).T, S.euler_matrix(*b[6:9]).T
    axes = [*u, *v, *(np.cross(x, y) for x in u for y in v)]
    best = 0.0
    for n in axes:
        if np.linalg.norm(n) > 1e-12:
            n = n / np.linalg.norm(n)
            best = max(best, (p @ n).min() - (q @ n).max(), (q @ n).min() - (p @ n).max())
    return best


def pairs_frame(spark, a, b):
    rows = [(i, tuple(map(float, x)), tuple(map(float, y))) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, f"i int, a struct<{BOX.replace(' double', ': double')}>, b struct<{BOX.replace(' double', ': double')}>")


def test_rotation_and_canonical(spark):
    r = np.random.default_rng(3)
    angles = np.concatenate([r.integers(-360, 360, (300, 3)), [[0, 90, 0], [0, -90, 30], [90, 90, 90], [0, 0, -1], [180, 180, 180], [0, 180, 0], [10, -90, -20]]])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(angles)], "i int, rx double, ry double, rz double")
    x, y, z = G.canonical(F.col("rx"), F.col("ry"), F.col("rz"))
    m = G.rotation(F.col("rx"), F.col("ry"), F.col("rz"))
    e = G.euler(m)
    got = df.select("i", x.alias("x"), y.alias("y"), z.alias("z"), F.array(*[c for row in m for c in row]).alias("m"), F.array(*e).alias("e")).collect()
    shape = np.array([3.0, 5.0, 7.0])
    for r_ in got:
        want = S.euler_matrix(*angles[r_["i"]])
        assert np.allclose(np.array(r_["m"]).reshape(3, 3), want)
        assert np.allclose(S.euler_matrix(*r_["e"]), want, atol=1e-6)
        new = (r_["x"], r_["y"], r_["z"])
        assert all(0 <= a < 180 for a in new)
        one, two = (corners(np.concatenate([shape, [0, 0, 0], t])) for t in (angles[r_["i"]], new))
        far = np.linalg.norm(one[:, None] - two[None], axis=2)
        assert far.min(axis=1).max() < 1e-9 and far.min(axis=0).max() < 1e-9


def test_gap_and_volume(spark):
    a, b = boxes(200, 1), boxes(200, 2)
    a[:20, 6:] = b[:20, 6:]  # parallel, rotated
    got = S.with_volume(D.with_gap(pairs_frame(spark, a, b))).orderBy("i").collect()
    want = [gap(x, y) for x, y in zip(a, b)]
    assert np.allclose([r["gap"] for r in got], want, atol=1e-8)
    both = S.common_volumes(a, b)
    assert np.allclose([r["volume"] for r in got], np.where(np.array(want) > 0, 0, both), atol=1e-6)
    assert np.allclose(both, S.common_volumes(b, a), atol=1e-6)
    assert (both <= np.minimum(a[:, :3].prod(1), b[:, :3].prod(1)) + 1e-6).all()
    assert (both[np.array(want) > 1e-9] < 1e-6).all()


def test_volume_cases():
    one = [10, 20, 30, 0, 0, 0, 0, 0, 0]
    assert S.common_volume(one, one) == pytest.approx(6000)
    assert S.common_volume(one, [10, 20, 30, 10, 0, 0, 0, 0, 0]) == pytest.approx(0)
    assert S.common_volume(one, [2, 2, 2, 1, 1, 1, 20, 30, 40]) == pytest.approx(8)
    assert S.common_volume(one, [10, 20, 30, 0, 0, 0, 0, 0, 180]) == pytest.approx(6000)
    assert S.common_volume([2, 2, 2, 0, 0, 0, 0, 0, 0], [2, 2, 2, 0, 0, 0, 0, 0, 45]) == pytest.approx(2 * 8 * (math.sqrt(2) - 1), rel=1e-9)
    assert S.common_volume([0, 1, 1, 0, 0, 0, 0, 0, 0], one) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=6, max_size=6), st.lists(st.integers(-30, 30), min_size=3, max_size=3), st.lists(angle, min_size=3, max_size=3), st.lists(st.integers(-50, 50), min_size=3, max_size=3))
def test_upright_volume_moves_rigidly(sizes, off, turn, shift):
    a, b = np.array([*sizes[:3], 0, 0, 0, 0, 0, 0], float), np.array([*sizes[3:], *off, 0, 0, 0], float)
    want = np.prod([max(0.0, min(a[i] / 2, b[3 + i] + b[i] / 2) - max(-a[i] / 2, b[3 + i] - b[i] / 2)) for i in range(3)])
    m = S.euler_matrix(*turn)
    moved = [np.concatenate([x[:3], m @ x[3:6] + shift, turn]) for x in (a, b)]
    assert S.common_volume(a, b) == pytest.approx(want, abs=1e-6)
    assert S.common_volume(*moved) == pytest.approx(want, abs=1e-5 * max(1, want))


def test_fit_box_and_strategies(spark):
    b = np.array([60.0, 30, 12, 5, 6, 7, 0, 0, 30])
    rot, sizes, centre = S.fit_box(corners(b))
    assert np.prod(sizes) <= 60 * 30 * 12 * 1.15 and np.allclose(centre, b[3:6])
    assert S.fit_misfit(corners(b), rot, sizes) < 1e-9
    lib = S.library_strategy()(corners(np.array([50.0, 23, 148, 0, 0, 0, 0, 0, 0])))
    assert sorted(lib[1]) == [24, 48, 150] and np.linalg.det(lib[0]) == pytest.approx(1)
    foot = S.library_strategy(G.FOOTPRINTS)(corners(np.array([77.0, 27, 29, 0, 0, 0, 0, 0, 0])))
    assert sorted(foot[1])[:2] == [28, 28]
    rows = spark.createDataFrame([(1, [{"x": float(x), "y": float(y), "z": float(z)} for x, y, z in corners(b)]), (2, []), (3, None)], "id int, points array<struct<x:double,y:double,z:double>>")
    got = {r["id"]: r for r in S.fit_boxes(rows, ["id"]).collect()}
    assert got[1]["cx"] == pytest.approx(5) and got[2]["dx"] is None and got[3]["dx"] is None


def test_orders(spark):
    df = spark.createDataFrame([(24.0, 100.0, 48.0), (48.0, 24.0, 10.0)], "a double, b double, c double")
    best = G.best_order((F.col("a"), F.col("b"), F.col("c")), F.array(F.lit(48.0), F.lit(24.0), F.lit(None).cast("double")))
    got = df.select(best.alias("b")).select("b.*", G.order_parity(F.col("b.order")).alias("par"), G.order_rotation(F.col("b.order")).alias("m")).collect()
    assert [list(r["order"]) for r in got] == [[2, 0, 1], [0, 1, 2]] and [r["par"] for r in got] == [1, 1]
    for r in got:
        assert round(np.linalg.det(np.array(r["m"], float))) == 1
    hs = pairs_frame(spark, boxes(3, 5), boxes(3, 6)).select("a", *G.axis_columns("a")).select("a", G.half_spaces("a").alias("h")).collect()
    for r in hs:
        b, h = np.array([r["a"][f] for f in G.FIELDS]), np.array(r["h"])
        assert (h[:, :3] @ b[3:6] + h[:, 3] < 0).all()
        assert np.abs(corners(b) @ h[:, :3].T + h[:, 3]).min(axis=0).max() < 1e-9


def parsed(spark, *texts):
    return D.parse(spark.createDataFrame(list(enumerate(texts)), "entry_id int, design string"))


def test_text_codec(spark):
    bad = ["", "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7 8 -9", "1 2 3 4 5 6 7 8 9.0", "1 2 3 4 5 6 7 8 9\nx", None, "1 2 3 4 5 6 7 8 9\n\n1 2 3 4 5 6 7 8 9"]
    assert parsed(spark, *bad).count() == 0
    got = parsed(spark, " 9 9 9 0 0 50 0 0 0\r\n8 8 8 0 0 10 0 0 0\n7 7 0 0 0 1 0 0 0 ", "٣ 2 3 4 5 6 7 8 9").orderBy("entry_id")
    rows = got.select("entry_id", D.design_text(F.col("parts")).alias("t")).collect()
    assert rows[0]["t"] == "8 8 8 0 0 10 0 0 0\n9 9 9 0 0 50 0 0 0"  # by height; a flat part is left out
    lines = spark.createDataFrame([("3 1 2 3 0 0 0",), ("99 1 2 3 0 0 0",), ("x",)], "line string")
    p = [r["p"] for r in D.library_parts(lines, "line").collect()]
    assert (p[0]["dx"], p[0]["dy"], p[0]["dz"], p[0]["cx"]) == (48, 24, 250, 1) and p[1] is None and p[2] is None
    f = D.library_parts(spark.createDataFrame([("1 300 1 2 3 0 0 0",)], "line string"), "line", "footprint").first()["p"]
    assert (f["dx"], f["dy"], f["dz"], f["cz"]) == (28, 28, 300, 3)


def test_rewards(spark):
    first = "20 20 20 100 100 10 0 0 0"
    texts = [
        first,
        first + "\n4 20 20 100 100 40 0 0 0",
        first + "\n20 20 20 100 100 5 0 0 0",
        first + "\n20 20 20 5 100 50 0 0 0",
        first + "\n20 20 20 100 100 25 0 0 0",
        first + "\n20 20 20 100 100 33 0 0 0",
        first + "\n20 20 20 200 200 10 0 0 0",
        first + "\n20 20 20 100 100 20 0 0 45",
    ]
    got = {r["entry_id"]: r for r in S.rewards(parsed(spark, *texts)).collect()}
    reason = [got[i]["reason"] for i in range(8)]
    assert reason == ["first_part", "too_small", "below_floor", "out_of_bounds", "overlap", "part_gap", "floor_gap", "overlap"]
    assert got[0]["reward"] == 0.5 and got[1]["reward"] == 0 and got[3]["reward"] == 0
    assert got[2]["reward"] == pytest.approx(1 - math.tanh(5))
    assert got[4]["reward"] == pytest.approx(1 - math.tanh(0.001 * 20 * 20 * 5)) and got[4]["hits"] == [0]
    assert got[5]["reward"] == pytest.approx(1 - math.tanh(0.2 * 3)) and got[5]["hits"] == [0]
    assert got[6]["reward"] == pytest.approx(1)
    assert got[7]["reward"] == pytest.approx(1 - math.tanh(0.001 * 10 * 2 * 400 * (math.sqrt(2) - 1)), abs=1e-9)
    assert {r["reason"]: r["n"] for r in S.reward_summary(S.rewards(parsed(spark, *texts))).collect()}["overlap"] == 2
    assert S.rewards(parsed(spark, "")).count() == 0


def test_extents_and_normalising(spark):
    pts = spark.createDataFrame([("m", 0.0, 0.0, 0.0), ("m", 2.0, 4.0, 1.0), ("n", 1.0, 1.0, 1.0), ("n", 3.0, 1.0, 2.0)], "m string, x double, y double, z double")
    e = {r["m"]: r for r in D.extents(D.normalised(pts, "m"), "m").collect()}
    assert (e["m"]["wx"], e["m"]["wy"], e["m"]["wz"]) == (100, 50, 200)
    assert D.normalised(pts, "m").agg(F.min("z")).first()[0] == 0


def test_voxels(spark):
    p = spark.createDataFrame([((4.0, 4.0, 4.0, 2.0, 2.0, 2.0, 0.0, 0.0, 0.0),)], f"p struct<{BOX.replace(' double', ': double')}>")
    q = spark.createDataFrame([((4.0, 4.0, 4.0, 4.0, 2.0, 2.0, 0.0, 0.0, 0.0),)], f"p struct<{BOX.replace(' double', ': double')}>")
    assert V.of_boxes(p, [], 1.0).count() == 64
    r = V.box_iou(p, q, 1.0).first()
    assert (r["common"], r["either"]) == (32, 96)
    empty = p.filter("false")
    assert V.box_iou(empty, empty, 1.0).first()["iou"] == 0
    pts = spark.createDataFrame([("a", 0, 0, 0), ("a", 1, 2, 0), ("a", 5, 0, 0)], "m string, i int, j int, k int")
    d = V.dense(pts, ["m"], (2, 3, 2))
    assert d.count() == 12 and V.sparse(d, ["m"]).count() == 2


def test_voxels_by_runs(spark, monkeypatch):
    """Scores by runs are those of the listed voxels, for thin, turned, touching and long boxes, in one piece or in slabs."""
    r = np.random.default_rng(8)
    rows = []
    for m in range(12):
        b = boxes(6, m, turn=m % 3 > 0)
        b[:, m % 2] = r.uniform(0.5, 4, 6)  # boards thinner than a voxel
        b[:, 6:9] = np.round(b[:, 6:9] / 90) * 90 if m % 3 == 1 else b[:, 6:9]
        b[:, :6] = np.round(b[:, :6] * 2) / 2 if m < 6 else b[:, :6]
        rows += [(m, "a" if k < 4 else "b", tuple(map(float, x))) for k, x in enumerate(b)]
    rows += [(12, s, (0.2, 0.2, 0.2, 5.0, 5.0, 5.0, 0.0, 0.0, 0.0)) for s in "ab"]  # between the centres
    df = spark.createDataFrame(rows, f"m int, side string, p struct<{BOX.replace(' double', ': double')}>")
    cells = V.of_boxes(df, ["m", "side"], 5.0).groupBy("m", "i", "j", "k").agg(F.count("*").alias("n"))
    want = dict.fromkeys(range(13), 0.0) | {x["m"]: x["iou"] for x in cells.groupBy("m").agg((F.count_if(F.col("n") == 2) / F.count("*")).alias("iou")).collect()}
    assert {x["m"]: x["iou"] for x in V.scored_fit(df, ["m"], 5.0).collect()} == want and max(want.values()) > 0
    monkeypatch.setattr(V, "COLUMNS", 40)
    assert {x["m"]: x["iou"] for x in V.scored_fit(df, ["m"], 5.0).collect()} == want


def test_voxel_fits_sees_thin_boards(spark, tmp_path):
    """The query's voxels are small enough for boards; compared with cell centres tested one by one."""
    from joinery.plans import designs as P

    parts = [(24, 300, 400, 112, 150, 200, 0, 0, 0), (300, 24, 300, 262, 112, 150, 0, 0, 0), (300, 300, 12, 262, 250, 394, 0, 0, 30)]
    text = "\n".join(" ".join(map(str, p)) for p in parts)
    spark.createDataFrame([(1, "train", [("user", "a shelf"), ("assistant", text)])], "entry_id bigint, split_name string, messages array<struct<role: string, content: string>>").write.parquet(f"{tmp_path}/finetuning_data.parquet")
    fit = P.box_fits(spark, str(tmp_path)).first()
    at = np.stack(np.meshgrid(*[np.arange(-300, 1000, 5) + 2.5] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    inside = lambda b: (np.abs((at - np.array(b[3:6])) @ S.euler_matrix(*b[6:9])) <= np.array(b[:3]) / 2 + 1e-9).all(axis=1)
    a, b = np.any([inside(p) for p in parts], axis=0), inside([fit[f] for f in G.FIELDS])
    got = P.voxel_fits(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["iou"] == pytest.approx((a & b).sum() / (a | b).sum(), abs=1e-3) and got[0]["iou"] > 0.05


def test_voxels_of_endless_ranges():
    """Sizes beyond whole numbers of 64 bits don't end the count of the others."""
    b = np.array([[10.0, 10, 10, 5, 5, 5, 0, 0, 0], [10.0, 10, 10, 1e25, 5, 5, 0, 0, 0]])
    with np.errstate(all="ignore"):
        p = V.prepared(b, S.frames(b), 5.0)
        assert V.agreement(p, np.array([0]), np.array([0]), 5.0) == 1 and 0 <= V.agreement(p, np.array([0]), np.array([1]), 5.0) <= 1


def test_voxel_fits_in_one_pass(spark, tmp_path):
    """Designs are read once and scored in their rows, without a shuffle by design; boxes and scores are those of the separate steps."""
    from joinery.plans import designs as P

    texts = ["\n".join(" ".join(str(int(x)) for x in np.abs(b)) for b in boxes(n, n)) for n in (1, 2, 5, 9)] + ["no design", ""]
    rows = [(n, "train", [("assistant", x)]) for n, x in enumerate(texts)]
    spark.createDataFrame(rows, "entry_id bigint, split_name string, messages array<struct<role: string, content: string>>").write.parquet(f"{tmp_path}/finetuning_data.parquet")
    df = P.voxel_fits(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and plan.count("Scan parquet") <= 1
    parts = D.parse(P._texts(spark, str(tmp_path)))
    box = S.fit_boxes(parts.select("entry_id", G.corner_array(F.col("parts")).alias("points")), ["entry_id"]).select("entry_id", F.lit("b").alias("side"), F.struct(*G.FIELDS).alias("p"))
    want = V.scored_fit(parts.select("entry_id", F.lit("a").alias("side"), F.explode("parts").alias("p")).unionByName(box), ["entry_id"], 5.0)
    got = {r["entry_id"]: r["iou"] for r in df.collect()}
    assert sorted(got) == [0, 1, 2, 3] and got == pytest.approx({r["entry_id"]: r["iou"] for r in want.collect()}, abs=2e-3)


def test_hierarchy_and_scale(spark):
    box = lambda *v: dict(zip(G.FIELDS, map(float, v)))
    schema = f"dir_id string, mesh_id string, p struct<{BOX.replace(' double', ': double')}>"
    boxes_ = spark.createDataFrame([("d", "a", box(40, 40, 10, 0, 0, 5, 0, 0, 0)), ("d", "b", box(40, 40, 10, 0, 0, 15, 0, 0, 0)), ("d", "c", box(10, 10, 60, 100, 0, 30, 0, 0, 0))], schema)
    tree = spark.createDataFrame(
        [("d", 0, None, ["a", "b", "c"], 0), ("d", 1, 0, ["a", "b"], 1), ("d", 2, 0, ["c"], 1), ("d", 3, 1, ["a"], 2), ("d", 4, 1, ["b"], 2)], "dir_id string, node_id bigint, parent_id bigint, objs array<string>, depth int"
    )
    chosen, score = H.search(tree, boxes_, ["dir_id"], 5.0)
    got = sorted((round(r["p"]["dz"]), round(r["p"]["cx"])) for r in chosen.collect())
    assert len(got) == 2 and got[1] == (60, 100) and got[0][0] == 20  # the two boards are one box
    assert score.first()["score"] > 0.95
    best = H.best_scale(spark.createDataFrame([("d", 1.0, 0.5), ("d", 2.0, 0.7), ("d", 3.0, 0.7)], "dir_id string, scale double, score double"), "dir_id").first()
    assert best["scale"] == 2.0
    pts = spark.createDataFrame([("d", "a", float(x), float(y), float(z)) for x, y, z in corners(np.array([10.0, 20, 30, 0, 0, 0, 0, 0, 0]))], "dir_id string, mesh_id string, x double, y double, z double")
    many = H.mesh_boxes(H.scaled(pts, [1.0, 2.0]), ["dir_id", "scale"])
    assert sorted(round(r["p"]["dx"] * r["p"]["dy"] * r["p"]["dz"]) for r in many.collect()) == [6000, 48000]


def test_fits_of_many_are_those_of_one():
    """Sets of points fitted together, of several sizes and without any point, get the boxes that a search set by set finds."""

    def slow(points):
        flat, total = points - points.mean(axis=0), np.eye(3)
        for axis in range(3):
            turn = 0.0
            for angles in (np.concatenate([[0.0], np.linspace(-45, 45, S.COARSE)]), np.linspace(-90 / S.COARSE, 90 / S.COARSE, S.FINE)):
                each = np.concatenate([[turn], angles + turn])
                turn = each[int(np.argmin([np.ptp(flat @ (S.axis_rotation(axis, a) @ total).T, axis=0).prod() for a in each]))]
            total = S.axis_rotation(axis, turn) @ total
        return total.T, np.ptp(flat @ total.T, axis=0), points.mean(axis=0)

    r = np.random.default_rng(4)
    n = np.array([8, 0, 40, 8, 3, 40, 8])
    points = r.uniform(-200, 300, (n.sum(), 3))
    got, first = S.fit_sets(points, n), np.cumsum(n) - n
    for k, m in enumerate(n):
        if m:
            rot, sizes, centre = slow(points[first[k] : first[k] + m])
            assert np.allclose(got[k, :6], [*sizes, *centre]) and np.allclose(S.euler_matrix(*got[k, 6:9]), rot) and got[k, 9] == 0
        else:
            assert np.isnan(got[k]).all()
    b = boxes(5, 2)
    assert np.allclose(S.box_corners(b), [corners(x) for x in b])


def test_voxels_painted_or_by_runs(spark, monkeypatch):
    """Any way of counting gives the listed voxels: dense, by runs in too large a range, boxes turned about one axis, by right angles, level ones, and several boxes on both sides."""
    r = np.random.default_rng(12)
    rows = []
    for m in range(16):
        b = boxes(5, m + 40, turn=False)
        b[:, m % 3] = r.uniform(1, 6, 5)
        b[:, 6 + m % 3] = r.integers(0, 24, 5) * 15
        if m > 7:
            b[:, 6 + (m + 1) % 3] = r.choice([0, 90, 30, 0.001], 5)
        b[:, :6] = np.round(b[:, :6] * 2) / 2
        rows += [(m, "b" if k > 2 + m % 2 else "a", tuple(map(float, x))) for k, x in enumerate(b)]
    rows += [(16, "a", (5.0, 5.0, 5.0, 2.5, 2.5, 2.5, 0.0, 0.0, 0.0)), (17, "a", (10.0,) * 3 + (5.0,) * 3 + (0.0,) * 3), (17, "b", (1e5,) * 3 + (5e4,) * 3 + (0.0,) * 3), (18, "a", (float("inf"),) * 3 + (0.0,) * 6)]
    df = spark.createDataFrame(rows, f"m int, side string, p struct<{BOX.replace(' double', ': double')}>")
    cells = V.of_boxes(df.filter("m < 17"), ["m", "side"], 5.0).groupBy("m", "i", "j", "k").agg(F.count("*").alias("n"))
    want = {x["m"]: x["iou"] for x in cells.groupBy("m").agg((F.count_if(F.col("n") == 2) / F.count("*")).alias("iou")).collect()} | {18: 0.0}
    small = df.filter("m <> 17")
    for name, limit in ((None, 0), ("CELLS", 0), ("COLUMNS", 30), ("BOXES", 3), ("STEEP", 10.0)):
        with monkeypatch.context() as here:
            if name:
                here.setattr(V, name, limit)
            assert {x["m"]: x["iou"] for x in V.scored_fit(small, ["m"], 5.0).collect()} == want, name


def test_fitted_models_in_one_pass(spark, tmp_path, monkeypatch):
    """A tree is searched in its row: nothing is shuffled, and each design has the boxes and the score of its best scale, worked out here by hand."""
    from joinery.plans import designs as P

    designs = ["40 40 100 200 200 50 0 0 0\n200 200 20 200 200 400 0 0 0\n20 200 200 200 200 300 0 0 0", "40 40 40 200 200 20 0 0 0", "40 40 40 100 100 20 0 0 0\n40 40 40 300 100 20 0 0 30"]
    rows = [(n, "train", [("user", "a shelf"), ("assistant", x)]) for n, x in enumerate(designs)] + [(9, "train", [("assistant", "no design")])]
    spark.createDataFrame(rows, "entry_id bigint, split_name string, messages array<struct<role: string, content: string>>").write.parquet(f"{tmp_path}/finetuning_data.parquet")
    df = P.fitted_models(spark, str(tmp_path))
    assert "Exchange hash" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["entry_id"]: r for r in df.collect()}
    assert sorted(got) == [0, 1, 2] and [got[k]["boxes"] for k in range(3)] == [2, 1, 1]
    assert got[1]["score"] == 1 and got[1]["scale"] == 1  # of equal scales the smallest
    for k, text in enumerate(designs):
        parts = np.array([[float(x) for x in line.split()] for line in text.split("\n")])
        groups = [g for g in (parts[:, 5] <= parts[:, 5].max() / 2, parts[:, 5] > parts[:, 5].max() / 2) if g.any()]
        best = []
        for scale in (1.0, 1.5):
            grown = np.array([H._grown(np.array([[*S.fit_sets(corners(p), np.array([8]))[0, :9]]]), scale)[0] for p in parts])
            chosen = np.array([S.fit_sets(np.concatenate([corners(p) for p in grown[g]]), np.array([8 * g.sum()]))[0, :9] for g in groups])
            at = np.stack(np.meshgrid(*[np.arange(-200, 800, 10) + 5.0] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
            a, b = (np.any([(np.abs((at - p[3:6]) @ S.euler_matrix(*p[6:9])) <= p[:3] / 2 + 1e-9).all(axis=1) for p in x], axis=0) for x in (grown, chosen))
            best.append((a & b).sum() / (a | b).sum())
        assert got[k]["score"] == pytest.approx(max(best), abs=2e-3) and got[k]["scale"] == (1.0 if best[0] >= best[1] else 1.5)


def test_even_texts_are_read_alike(spark):
    """Texts of single blanks are only split; any other white space gives the same parts by the longer way."""
    even = "10 20 30 40 50 60 0 0 90\n1 2 3 4 5 6 7 8 9"
    texts = [even, even.replace(" ", "\u00a0 "), even.replace("\n", "\r\n"), " " + even, even + "\n", even.replace(" ", "  "), even.replace("\n", " \n")]
    got = [r["parts"] for r in parsed(spark, *texts).orderBy("entry_id").collect()]
    assert len(got) == len(texts) and all(x == got[0] for x in got) and [x["rz"] for x in got[0]] == [90, 9]
    assert parsed(spark, even + " 1", even + "\n\n" + even, even.replace("3 4", "3 -4"), "\n", "1 2 3 4 5 6 7 8").count() == 0


def test_completions(spark):
    from joinery.operators import completions as C

    first = "20 20 20 100 100 10 0 0 0"
    rows = [
        (1, "bad", first, "x"), (2, first, "EOS", "EOS"), (3, first, first, "EOS"), (4, first, "nonsense", "x"), (5, first, "EOS", "x"), (6, "", first, "x"), (7, None, None, None),
        (8, first + "\n", "20 20 20 100 100 33 0 0 0\n", "x"), (9, first, "chat\n20 20 20 100 100 25 0 0 0", "x"),
    ]
    out = C.completion_rewards(spark.createDataFrame(rows, "entry_id int, prefix string, completion string, target string"))
    got = {r["entry_id"]: (r["reason"], round(r["reward"], 6)) for r in out.collect()}
    assert got[1] == ("error_parsing_prompt", 0) and got[2] == ("termination", 1) and got[3] == ("termination", 0)
    assert got[4] == got[5] == got[7] == ("invalid_syntax", 0) and got[6] == ("first_part", 0.5)
    assert got[8] == ("part_gap", round(1 - math.tanh(0.6), 6)) and got[9][0] == "overlap"
    s = C.summary(out).first()
    assert s["reasons"]["invalid_syntax"] == 3 and 0 < s["mean"] < 1 and s["std"] == pytest.approx(np.std([v for _, v in got.values()]), abs=1e-5)
    pair = spark.createDataFrame([(1.0, 9.0, 8.5)], "a double, b double, c double").select(G.closest_pair((F.col("a"), F.col("b"), F.col("c"))).alias("x")).first()["x"]
    assert (pair["i"], pair["j"]) == (1, 2)
