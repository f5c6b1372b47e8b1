"""Queries on designs as parts: text codec, rotations, gaps, overlaps, fits, rewards, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.functions import geometry as G
from joinery.functions.designs import last_content
from joinery.functions.scalars import grid_side, linspace, round_even
from joinery.operators import completions as C
from joinery.operators import designs as D
from joinery.operators import hierarchy as H
from joinery.operators import solids as S
from joinery.operators import tables as T
from joinery.operators import voxels as V
from joinery.operators.dataset import prefixes
from joinery.session import spread, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "finetuning_data")).select("entry_id", "split_name", last_content(F.col("messages")).alias("design"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return D.parse(_texts(spark, d))



def design_parts(spark: SparkSession, d: str) -> DataFrame:
    return D.part_rows(_parsed(spark, d)).withColumns({f: F.col(f).cast("bigint") for f in G.FIELDS})


def design_readable(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d).filter("design is not null")
    return t.groupBy(D.readable(F.col("design")).alias("readable")).agg(F.count("*").alias("n"))


def design_text_sorted(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("entry_id", D.design_text(F.col("parts")).alias("text"))


def part_rotations(spark: SparkSession, d: str) -> DataFrame:
    rows = D.part_rows(_parsed(spark, d)).select(F.struct(*G.FIELDS).alias("p"))
    return rows.select("p", *G.axis_columns("p")).groupBy(F.col("p.rx").cast("bigint").alias("rx"), F.col("p.ry").cast("bigint").alias("ry"), F.col("p.rz").cast("bigint").alias("rz")).agg(
        F.count("*").alias("n"), *[round_even(F.first(f"p_{i}{j}"), 6).alias(f"m{i}{j}") for i in range(3) for j in range(3)]
    )


def canonical_rotations(spark: SparkSession, d: str) -> DataFrame:
    """Canonical angles of the parts turned upside down and back to front, by part rotation."""
    rows = D.part_rows(_parsed(spark, d)).select("rx", "ry", "rz").distinct()
    x, y, z = G.canonical(F.col("rx") - 180, -F.col("ry"), F.col("rz") - 270)
    return rows.select(*[F.col(c).cast("bigint").alias(c) for c in ("rx", "ry", "rz")], x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), z.cast("bigint").alias("z"))


def _once(c: Column) -> Column:
    """The column worked out once per row, not in every expression that uses it."""
    return F.explode(F.array(c))


def canonical_same(spark: SparkSession, d: str) -> DataFrame:
    """Whether canonical angles lie in [0, 180) and turn a box into the same solid: its three axes, as lines, stay where they were."""
    rows = D.part_rows(_parsed(spark, d)).select("rx", "ry", "rz").distinct()
    zero = [F.lit(0.0).alias(f) for f in G.FIELDS[:6]]
    turned = [F.col("rx") - 180, -F.col("ry"), F.col("rz") - 270]
    rows = rows.select("rx", "ry", "rz", F.struct(*zero, *[x.alias(f) for x, f in zip(turned, G.FIELDS[6:])]).alias("a"), _once(F.struct(*zero, *[x.alias(f) for x, f in zip(G.canonical(*turned), G.FIELDS[6:])])).alias("b"))
    m = rows.select("rx", "ry", "rz", "b", *G.axis_columns("a"), *G.axis_columns("b"))
    along = [F.abs(G.dot(*[tuple(F.col(f"{s}_{i}{k}") for i in range(3)) for s in "ab"])) for k in range(3)]
    inside = F.least(*[F.col(f"b.{f}") for f in G.FIELDS[6:]]) >= 0
    return m.select(*[F.col(c).cast("bigint").alias(c) for c in ("rx", "ry", "rz")], (F.least(*along) > 1 - 1e-9).alias("same"), (inside & (F.greatest(*[F.col(f"b.{f}") for f in G.FIELDS[6:]]) < 180)).alias("inside"))


def euler_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether the angles taken back from a part's rotation matrix make the same matrix, by rotation."""
    p = D.part_rows(_parsed(spark, d)).select("rx", "ry", "rz").distinct()
    zero = [F.lit(0.0).alias(f) for f in G.FIELDS[:6]]
    a = p.select("rx", "ry", "rz", F.struct(*zero, *[F.col(f) for f in G.FIELDS[6:]]).alias("a")).select("rx", "ry", "rz", *G.axis_columns("a"))
    back = G.euler(tuple(tuple(F.col(f"a_{i}{j}") for j in range(3)) for i in range(3)))
    b = a.select("*", _once(F.struct(*zero, *[x.alias(f) for x, f in zip(back, G.FIELDS[6:])])).alias("b"))
    m = b.select("*", *G.axis_columns("b"))
    off = F.greatest(*[F.abs(F.col(f"a_{i}{j}") - F.col(f"b_{i}{j}")) for i in range(3) for j in range(3)])
    return m.select(*[F.col(c).cast("bigint").alias(c) for c in ("rx", "ry", "rz")], (off < 1e-6).alias("same"))


def _upright(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).filter(F.forall("parts", lambda p: (p["rx"] == 0) & (p["ry"] == 0) & (p["rz"] == 0)))


def upright_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Rewards of the last parts of designs without any rotation."""
    return S.rewards(_upright(spark, d)).select("entry_id", round_even(F.col("reward"), 6).alias("reward"), "reason", "hits")


def upright_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of neighbouring parts of designs without any rotation."""
    pairs = S.with_volume(D.with_gap(D.neighbours(_upright(spark, d))))
    return pairs.select("entry_id", "i", round_even(G.pair_score(F.col("gap"), F.col("volume")), 6).alias("score"))


def neighbour_gaps(spark: SparkSession, d: str) -> DataFrame:
    return D.with_gap(D.neighbours(_parsed(spark, d))).select("entry_id", "i", round_even(F.col("gap"), 6).alias("gap"))


def upright_overlaps(spark: SparkSession, d: str) -> DataFrame:
    pairs = D.neighbours(_parsed(spark, d)).filter("a.rx = 0 and a.ry = 0 and a.rz = 0 and b.rx = 0 and b.ry = 0 and b.rz = 0")
    return pairs.select("entry_id", "i", G.aligned_overlap("a", "b").alias("volume"))


def neighbour_scores(spark: SparkSession, d: str) -> DataFrame:
    pairs = S.with_volume(D.with_gap(D.neighbours(_parsed(spark, d))))
    return pairs.select("entry_id", "i", round_even(G.pair_score(F.col("gap"), F.col("volume")), 6).alias("score"))


def part_rewards(spark: SparkSession, d: str) -> DataFrame:
    return S.rewards(_parsed(spark, d)).select("entry_id", round_even(F.col("reward"), 6).alias("reward"), "reason", "hits")


def reward_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.reward_summary(S.rewards(_parsed(spark, d)))


def completion_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Rewards of the true next lines after random prefixes of the training texts."""
    rows = prefixes(spread(table(spark, d, "finetuning_data")).filter("messages is not null"), ["entry_id"])
    return C.completion_rewards(rows.select("entry_id", "prefix", F.col("next_line").alias("completion"), F.col("next_line").alias("target"))).select("entry_id", round_even(F.col("reward"), 6).alias("reward"), "reason")


def closest_sizes(spark: SparkSession, d: str) -> DataFrame:
    pair = G.closest_pair((F.col("dx"), F.col("dy"), F.col("dz")))
    return D.part_rows(_parsed(spark, d)).select(pair.alias("x")).groupBy("x.i", "x.j").agg(F.count("*").alias("n"), F.sum("x.off").cast("bigint").alias("off"))


def tenth_corners(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth corner of the designs' parts."""
    points = D.corner_points(_parsed(spark, d)).withColumn("idx", F.col("part_idx") * 8 + F.col("pt_idx"))
    return T.every_nth(points, "idx", 10).groupBy("entry_id").agg(F.count("*").alias("points"), round_even(F.sum("z"), 3).alias("z"))


def voxel_fits(spark: SparkSession, d: str) -> DataFrame:
    """How well one box around a design agrees with its parts, in voxels of 5."""
    fits = S.fit_designs(_parsed(spark, d).select("entry_id", "parts"), ["entry_id", "parts"])
    box = F.when(F.col("dx").isNotNull(), F.array(F.struct(*G.FIELDS))).otherwise(F.array())
    return V.fit_scores(fits.select("entry_id", "parts", box.alias("box")), ["entry_id"], "parts", "box", 5.0)


def design_extents(spark: SparkSession, d: str) -> DataFrame:
    points = _parsed(spark, d).select("entry_id", G.corner_array(F.col("parts")).alias("points"))
    return points.select("entry_id", *[round_even(c, 6).alias(n) for n, c in D.box_extents(F.col("points")).items()])


def normalised_extents(spark: SparkSession, d: str) -> DataFrame:
    e = D.extents(D.normalised(D.corner_points(_parsed(spark, d)), "entry_id"), "entry_id")
    return e.select("entry_id", round_even(F.greatest("wx", "wy"), 6).alias("widest"), *[round_even(F.col(c), 6).alias(c) for c in ("wx", "wy", "wz")])


def library_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = D.part_rows(_parsed(spark, d))
    best = G.best_in_catalogue((F.col("dx"), F.col("dy"), F.col("dz")), G.LIBRARY)
    return rows.select(best.alias("b")).groupBy(F.col("b.id").alias("part_id")).agg(F.count("*").alias("n"), round_even(F.avg("b.misfit"), 3).alias("misfit"))


def footprint_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = D.part_rows(_parsed(spark, d))
    best = G.best_in_catalogue((F.col("dx"), F.col("dy"), F.col("dz")), G.FOOTPRINTS)
    return rows.select(best.alias("b")).groupBy(F.col("b.id").alias("part_id")).agg(F.count("*").alias("n"), round_even(F.avg("b.misfit"), 3).alias("misfit"))


def _coded(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Each part as a line of the closest catalogue part, read back; counts and sums of sizes and centres by part id."""
    rows = D.part_rows(_parsed(spark, d))
    best = G.best_in_catalogue((F.col("dx"), F.col("dy"), F.col("dz")), G.LIBRARY if kind == "library" else G.FOOTPRINTS)
    at = [F.col(c) for c in G.FIELDS[3:]]
    line = D.library_text(F.col("id"), *at) if kind == "library" else D.footprint_text(F.col("id"), F.col("dz").cast("bigint"), *at)
    back = D.library_parts(rows.select("*", best["id"].alias("id")).select("id", line.alias("line")), "line", kind).filter("p is not null")
    return back.groupBy(F.col("id").alias("part_id")).agg(F.count("*").alias("n"), *[F.sum(F.col(f"p.{f}")).cast("bigint").alias(f) for f in ("dx", "dy", "dz", "cx", "rz")])


def library_lines(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d, "library")


def footprint_lines(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d, "footprint")


def axis_orders(spark: SparkSession, d: str) -> DataFrame:
    """Which order of the axes brings a part closest to a 48 x 24 strip, and whether that order is even."""
    best = G.best_order((F.col("dx"), F.col("dy"), F.col("dz")), F.array(F.lit(48.0), F.lit(24.0), F.lit(None).cast("double")))
    rows = D.part_rows(_parsed(spark, d)).select(best.alias("b"))
    return rows.groupBy(F.col("b.order").alias("axis_order"), G.order_parity(F.col("b.order")).alias("parity")).agg(F.count("*").alias("n"))


def box_fits(spark: SparkSession, d: str) -> DataFrame:
    """A box around the corners of each design."""
    return S.fit_designs(_parsed(spark, d), ["entry_id"])


def fitted_models(spark: SparkSession, d: str) -> DataFrame:
    """Designs as part trees (all parts, and below them the parts up to half the height and the others), fitted at two scales: the best scale, its agreement and number of boxes."""
    rows = S.fit_parts(_parsed(spark, d), ["entry_id", "parts"]).select("entry_id", "parts", "fits", F.array_max(F.transform("parts", lambda p: p["cz"])).alias("top"))
    objs = lambda keep: F.filter(F.transform("parts", lambda p, i: F.when(keep(p["cz"] <= F.col("top") / 2), i.cast("string"))), lambda x: x.isNotNull())
    node = lambda n, up, depth, keep: F.struct(F.lit(n).cast("bigint").alias("node_id"), F.lit(up).cast("bigint").alias("parent_id"), F.lit(depth).alias("depth"), objs(keep).alias("objs"))
    low = lambda x: F.coalesce(x, F.lit(False))
    nodes = F.filter(F.array(node(0, None, 0, lambda x: F.lit(True)), node(1, 0, 1, low), node(2, 0, 1, lambda x: ~low(x))), lambda n: F.size(n["objs"]) > 0)
    models = rows.select("entry_id", nodes.alias("nodes"), F.transform("fits", lambda p, i: F.struct(i.cast("string").alias("mesh_id"), p.alias("p"))).alias("meshes"))
    best = H.fit_trees(models, ["entry_id"], [1.0, 1.5], 10.0).filter("size(boxes) > 0")
    return best.select("entry_id", "scale", round_even(F.col("score"), 6).alias("score"), F.size("boxes").cast("bigint").alias("boxes"))


def layout(spark: SparkSession, d: str) -> DataFrame:
    """The side of the square sheet that shows a design's parts, and marks along it."""
    n = F.size("parts")
    return _parsed(spark, d).select("entry_id", grid_side(n).alias("side"), linspace(F.lit(0.0), n.cast("double"), 5).alias("marks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            design_parts, design_readable, design_text_sorted, part_rotations, canonical_rotations, canonical_same, euler_round_trip, upright_rewards, upright_scores, neighbour_gaps, upright_overlaps, neighbour_scores, part_rewards, reward_summary,
            completion_rewards, closest_sizes, tenth_corners, voxel_fits, design_extents, normalised_extents, library_fit, footprint_fit, library_lines, footprint_lines, axis_orders, box_fits, fitted_models, layout,
        )
    }


_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}]"
_PARTS = rf"""said as (select entry_id, [m.content for m in messages if lower(trim(regexp_replace(m.role, '{_SPACE}+', ' ', 'g'))) = 'assistant'][-1] as design from finetuning_data),
line as (select entry_id, design, unnest(string_split(regexp_replace(design, '^{_SPACE}+|{_SPACE}+$', '', 'g'), chr(10))) as raw, generate_subscripts(string_split(regexp_replace(design, '^{_SPACE}+|{_SPACE}+$', '', 'g'), chr(10)), 1) - 1 as idx from said where design is not null),
flat as (select entry_id, idx, trim(regexp_replace(raw, '{_SPACE}+', ' ', 'g')) as t from line),
okay as (select entry_id, bool_and(regexp_full_match(t, '[0-9]+( [0-9]+){{8}}')) as good from flat group by entry_id),
parts as (select entry_id, idx as part_idx, n[1] as dx, n[2] as dy, n[3] as dz, n[4] as cx, n[5] as cy, n[6] as cz, n[7] as rx, n[8] as ry, n[9] as rz
    from (select entry_id, idx, string_split(t, ' ')::bigint[] as n from flat join okay using (entry_id) where good))"""
_TURN = """turned as (select *, [cos(radians(rz))*cos(radians(ry)), sin(radians(rz))*cos(radians(ry)), -sin(radians(ry))] as u,
    [cos(radians(rz))*sin(radians(ry))*sin(radians(rx)) - sin(radians(rz))*cos(radians(rx)), sin(radians(rz))*sin(radians(ry))*sin(radians(rx)) + cos(radians(rz))*cos(radians(rx)), cos(radians(ry))*sin(radians(rx))] as v,
    [cos(radians(rz))*sin(radians(ry))*cos(radians(rx)) + sin(radians(rz))*sin(radians(rx)), sin(radians(rz))*sin(radians(ry))*cos(radians(rx)) - cos(radians(rz))*sin(radians(rx)), cos(radians(ry))*cos(radians(rx))] as w from parts)"""
_PAIRS = "pairs as (select a.entry_id, a.part_idx as i, a as a, b as b from {t} a join {t} b on a.entry_id = b.entry_id and b.part_idx = a.part_idx + 1)"
_POINTS = (
    "points as (select entry_id, part_idx, cx + u[1]*dx*i + v[1]*dy*j + w[1]*dz*k as x, cy + u[2]*dx*i + v[2]*dy*j + w[2]*dz*k as y, cz + u[3]*dx*i + v[3]*dy*j + w[3]*dz*k as z "
    "from turned, (values (-0.5::double), (0.5)) s1(i), (values (-0.5::double), (0.5)) s2(j), (values (-0.5::double), (0.5)) s3(k))"
)


def _sql_table(name: str, parts: tuple, columns: str) -> str:
    return f"{name}({columns}) as (values " + ", ".join(f"({k}, {', '.join(map(str, p))})" for k, p in enumerate(parts)) + ")"


def oracle_sql() -> dict[str, str]:
    up = " and ".join(f"{s}.{r} = 0" for s in ("a", "b") for r in ("rx", "ry", "rz"))
    common = " * ".join(f"greatest(0.0, least(a.{c} + a.{d} / 2, b.{c} + b.{d} / 2) - greatest(a.{c} - a.{d} / 2, b.{c} - b.{d} / 2))" for d, c in (("dx", "cx"), ("dy", "cy"), ("dz", "cz")))
    ortho = "[{x}[2]*{y}[3] - {x}[3]*{y}[2], {x}[3]*{y}[1] - {x}[1]*{y}[3], {x}[1]*{y}[2] - {x}[2]*{y}[1]]"
    crosses = ", ".join(ortho.format(x=f"a.{x}", y=f"b.{y}") for x in "uvw" for y in "uvw")
    order = {(0, 1, 2): "dx,dy", (0, 2, 1): "dx,dz", (1, 0, 2): "dy,dx", (1, 2, 0): "dy,dz", (2, 0, 1): "dz,dx", (2, 1, 0): "dz,dy"}
    flat = "flatparts as (select * from parts where entry_id in (select entry_id from parts group by entry_id having bool_and(rx = 0 and ry = 0 and rz = 0)))"
    axis_gap = "greatest(0.0::double, " + ", ".join(f"abs({{a}}.{c} - {{b}}.{c}) - ({{a}}.{d} + {{b}}.{d}) / 2" for d, c in (("dx", "cx"), ("dy", "cy"), ("dz", "cz"))) + ")"
    low, high = ([f"l.{c} {sign} l.{d} / 2" for d, c in (("dx", "cx"), ("dy", "cy"), ("dz", "cz"))] for sign in "-+")
    worst = "greatest(" + ", ".join([f"-({x})" for x in low] + [f"({x}) - {m}" for x, m in zip(high, (*G.BOUNDS[:2], S.HEIGHT))]) + ")"
    floor = ", ".join(f"{v}::double as {k}" for k, v in S.FLOOR.items())
    return {
        "canonical_same": f"with {_PARTS} select distinct rx, ry, rz, true as same, true as inside from parts",
        "euler_round_trip": f"with {_PARTS} select distinct rx, ry, rz, true as same from parts",
        "upright_scores": f"""with {_PARTS}, {flat}, {_PAIRS.format(t="flatparts")}, m as (select entry_id, i::int as i, {axis_gap.format(a="a", b="b")} as gap, {common} as volume from pairs)
select entry_id, i, round_even(case when gap > 0 then tanh(gap * 0.2) else tanh(volume * -0.001) end, 6) as score from m""",
        "upright_rewards": f"""with {_PARTS}, {flat}, n as (select *, max(part_idx) over (partition by entry_id) as newest from flatparts),
l as (select * from n where part_idx = newest), o as (select entry_id, part_idx + 1 as i, dx, dy, dz, cx, cy, cz from n where part_idx < newest union all select entry_id, 0, dx, dy, dz, cx, cy, cz from (select distinct entry_id, {floor} from n)),
pair as (select l.entry_id, o.i, {axis_gap.format(a="l", b="o")} as gap, case when o.i > 0 then {common.replace("a.", "l.").replace("b.", "o.")} else 0 end as volume from l join o using (entry_id)),
g as (select entry_id, sum(volume) as volume, list(i - 1 order by i) filter (volume > 0) as hits, arg_min(i, row(gap, i)) as i, min(gap) as gap from pair group by entry_id),
r as (select l.entry_id, case when newest = 0 then row(0.5, 'first_part', [])
    when least(dx, dy, dz) < {S.LEAST_SIZE} then row(0.0, 'too_small', []) when {low[2]} < 0 then row(1 - tanh({worst}), 'below_floor', []) when {worst} > 0 then row(0.0, 'out_of_bounds', [])
    when volume > 0 then row(1 - tanh(volume * 0.001), 'overlap', hits) when g.i = 0 then row(1 - tanh(gap * 0.2), 'floor_gap', []) else row(1 - tanh(gap * 0.2), 'part_gap', [g.i - 1]) end as x from l join g using (entry_id))
select entry_id, round_even(x[1]::double, 6) as reward, x[2] as reason, x[3]::int[] as hits from r""",
        "design_parts": f"with {_PARTS} select entry_id, part_idx::int as part_idx, dx, dy, dz, cx, cy, cz, rx, ry, rz from parts",
        "design_readable": f"with {_PARTS} select good as readable, count(*) as n from okay group by good",
        "design_text_sorted": f"with {_PARTS} select entry_id, coalesce(string_agg(concat_ws(' ', dx, dy, dz, cx, cy, cz, rx, ry, rz), chr(10) order by cz, part_idx) filter (least(dx, dy, dz) > 0), '') as text from parts group by entry_id",
        "part_rotations": f"with {_PARTS}, {_TURN} select rx, ry, rz, count(*) as n, " + ", ".join(f"round_even(any_value({c}[{i + 1}]), 6) as m{i}{j}" for j, c in enumerate("uvw") for i in range(3)) + " from turned group by rx, ry, rz",
        "neighbour_gaps": f"""with {_PARTS}, {_TURN}, {_PAIRS.format(t="turned")},
axes as (select entry_id, i, a, b, unnest([a.u, a.v, a.w, b.u, b.v, b.w, {crosses}]) as n from pairs),
gaps as (select entry_id, i, sqrt(list_dot_product(n, n)) as len, abs(list_dot_product(n, [b.cx - a.cx, b.cy - a.cy, b.cz - a.cz]::double[]))
    - (abs(list_dot_product(n, a.u)) * a.dx + abs(list_dot_product(n, a.v)) * a.dy + abs(list_dot_product(n, a.w)) * a.dz + abs(list_dot_product(n, b.u)) * b.dx + abs(list_dot_product(n, b.v)) * b.dy + abs(list_dot_product(n, b.w)) * b.dz) / 2 as gap from axes)
select entry_id, i::int as i, round_even(greatest(0.0, max(gap / len)), 6) as gap from gaps where len > 1e-12 group by entry_id, i""",
        "upright_overlaps": f"with {_PARTS}, {_PAIRS.format(t='parts')} select entry_id, i::int as i, {common} as volume from pairs where {up}",
        "closest_sizes": f"""with {_PARTS}, o as (select least(abs(dx - dy), abs(dx - dz), abs(dy - dz)) as off, dx, dy, dz from parts)
select case when off = abs(dy - dz) and off < abs(dx - dy) and off < abs(dx - dz) then 1 else 0 end as i, case when off = abs(dx - dy) then 1 else 2 end as j, count(*) as n, sum(off)::bigint as off from o group by 1, 2""",
        "tenth_corners": f"""with {_PARTS}, {_TURN}, n as (select entry_id, cz + u[3]*dx*i + v[3]*dy*j + w[3]*dz*k as z, part_idx * 8 + (case when i > 0 then 4 else 0 end) + (case when j > 0 then 2 else 0 end) + (case when k > 0 then 1 else 0 end) as idx
    from turned, (values (-0.5::double), (0.5)) s1(i), (values (-0.5::double), (0.5)) s2(j), (values (-0.5::double), (0.5)) s3(k))
select entry_id, count(*) as points, round_even(sum(z), 3) as z from n where idx % 10 = 0 group by entry_id""",
        "design_extents": f"with {_PARTS}, {_TURN}, {_POINTS} select entry_id, " + ", ".join(f"round_even(max({c}) - min({c}), 6) as w{c}, round_even(avg({c}), 6) as m{c}" for c in "xyz") + " from points group by entry_id",
        "normalised_extents": f"""with {_PARTS}, {_TURN}, {_POINTS}, e as (select entry_id, max(x) - min(x) as a, max(z) - min(z) as b, max(y) - min(y) as c from points group by entry_id)
select entry_id, 100.0::double as widest, round_even(100 * a / greatest(a, b), 6) as wx, round_even(100 * b / greatest(a, b), 6) as wy, round_even(100 * c / greatest(a, b), 6) as wz from e""",
        "library_fit": f"""with {_PARTS}, {_sql_table("lib", G.LIBRARY, "id, x, y, z")}, sized as (select entry_id, part_idx, list_sort([dx, dy, dz]) as s from parts),
best as (select entry_id, part_idx, id, sqrt(pow(s[1] - l[1], 2) + pow(s[2] - l[2], 2) + pow(s[3] - l[3], 2)) as misfit from sized, (select id, list_sort([x, y, z]) as l from lib) qualify row_number() over (partition by entry_id, part_idx order by misfit, id) = 1)
select id as part_id, count(*) as n, round_even(avg(misfit), 3) as misfit from best group by id""",
        "footprint_fit": f"""with {_PARTS}, {_sql_table("foot", G.FOOTPRINTS, "id, x, y")},
best as (select entry_id, part_idx, id, least({", ".join(f"sqrt(pow({o.split(',')[0]} - x, 2) + pow({o.split(',')[1]} - y, 2))" for o in order.values())}) as misfit from parts, foot qualify row_number() over (partition by entry_id, part_idx order by misfit, id) = 1)
select id as part_id, count(*) as n, round_even(avg(misfit), 3) as misfit from best group by id""",
        "library_lines": f"""with {_PARTS}, {_sql_table("lib", G.LIBRARY, "id, x, y, z")}, sized as (select *, list_sort([dx, dy, dz]) as s from parts),
best as (select id, x, y, z, cx, rz, sqrt(pow(s[1] - l[1], 2) + pow(s[2] - l[2], 2) + pow(s[3] - l[3], 2)) as misfit from sized, (select *, list_sort([x, y, z]) as l from lib) qualify row_number() over (partition by entry_id, part_idx order by misfit, id) = 1)
select id as part_id, count(*) as n, sum(x)::bigint as dx, sum(y)::bigint as dy, sum(z)::bigint as dz, sum(cx)::bigint as cx, sum(rz)::bigint as rz from best group by id""",
        "footprint_lines": f"""with {_PARTS}, {_sql_table("foot", G.FOOTPRINTS, "id, x, y")},
best as (select id, x, y, dz, cx, rz, least({", ".join(f"sqrt(pow({o.split(',')[0]} - x, 2) + pow({o.split(',')[1]} - y, 2))" for o in order.values())}) as misfit from parts, foot qualify row_number() over (partition by entry_id, part_idx order by misfit, id) = 1)
select id as part_id, count(*) as n, sum(x)::bigint as dx, sum(y)::bigint as dy, sum(dz)::bigint as dz, sum(cx)::bigint as cx, sum(rz)::bigint as rz from best group by id""",
        "axis_orders": f"""with {_PARTS}, o(k, axis_order, parity) as (values {", ".join(f"({k}, {list(o)}, {1 if o in ((0, 1, 2), (1, 2, 0), (2, 0, 1)) else -1})" for k, o in enumerate(sorted(order)))}),
best as (select axis_order, parity, sqrt(pow([dx, dy, dz][axis_order[1] + 1] - 48, 2) + pow([dx, dy, dz][axis_order[2] + 1] - 24, 2)) as off, k from parts, o qualify row_number() over (partition by entry_id, part_idx order by off, k) = 1)
select axis_order, parity, count(*) as n from best group by axis_order, parity""",
        "layout": f"""with {_PARTS}, c as (select entry_id, count(*) as n from parts group by entry_id) select entry_id, ceil(sqrt(n))::int as side, [n * i / 4.0::double for i in [0, 1, 2, 3, 4]] as marks from c""",
    }
