"""Queries on vectors and rotations, obstacles, solves held by their residuals, and lattices that grow with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as vec
from ..meta import Grid
from ..operators import fluid, graph, lattice, mesh, physics, resample, solve, stencil
from ..operators.geometry import Box, Sphere, line_trace
from .grids import ORACLE_SQL as _GRID_SQL
from .grids import nb, r6
from .tables import G_SQL, NX, NY, P_SQL, line_field, line_grid, part_field, part_points, plain_points, rounded, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def xy() -> dict:
    return {"x": F.col("x"), "y": F.col("y")}


def xyz() -> dict:
    """Points in space from size, price and their ratio."""
    return {"x": F.col("x") / 10 - 2, "y": F.col("y") / 50 - 1, "z": F.col("x") / 25 + F.col("y") / 100 - 1.5}


_XYZ = f"s as (select elem_id, x / 10 - 2 as x, y / 50 - 1 as y, x / 25 + y / 100 - 1.5 as z from ({{}}))".replace("({})", "p")
_N = "sqrt(x * x + y * y + z * z)"


def _named(**columns) -> list:
    out = []
    for name, c in columns.items():
        out += [v.alias(f"{name}_{a}") for a, v in c.items()] if isinstance(c, dict) else [c.alias(name)]
    return out


def _picked(spark, sf_dir, **columns):
    return rounded(plain_points(spark, sf_dir).select("elem_id", *_named(**columns)))


# --- vectors -----------------------------------------------------------------------------------------


@query(f"""with {P_SQL}, {_XYZ} select elem_id, {r6("x * x + y * y + z * z", "squared")}, {r6("x * y + y * z + z * x", "dotted")},
{r6(f"case when {_N} = 0 then 0.0 else x / {_N} end", "unit_x")}, {r6(f"case when {_N} = 0 then 0.0 else y / {_N} end", "unit_y")}, {r6(f"case when {_N} = 0 then 0.0 else z / {_N} end", "unit_z")},
{r6(f"case when {_N} = 0 then 0.0 else x * greatest(0.5, least(2.0, {_N})) / {_N} end", "clipped_x")}, {r6(f"case when {_N} = 0 then 0.0 else z * greatest(0.5, least(2.0, {_N})) / {_N} end", "clipped_z")},
{r6("y * x - z * z", "crossed_x")}, {r6("z * y - x * x", "crossed_y")}, {r6("x * z - y * y", "crossed_z")},
{r6("case when y = 0 then 0.0 else x / y end", "quotient")}, {r6("x * y", "multiplied")}, {r6("x - 0.25 * (x + y + z) * 4 / 3", "flat_x")} from s""")
def vector_lengths_and_products(spark, sf_dir):
    p = xyz()
    turned = {"x": p["y"], "y": p["z"], "z": p["x"]}
    third = {a: F.lit(1 / 3**0.5) for a in p}
    clipped, flat = vec.clip_length(p, 0.5, 2.0), vec.without_part(p, third)
    return _picked(
        spark, sf_dir, squared=vec.squared(p), dotted=vec.dot(p, turned), unit=vec.normalize(p), clipped_x=clipped["x"], clipped_z=clipped["z"],
        crossed=vec.cross(p, turned), quotient=vec.divide(p["x"], p["y"]), multiplied=vec.product(p["x"], p["y"]), flat_x=flat["x"],
    )


_CA, _SA = "cos(0.7)", "sin(0.7)"


@query(f"""with {P_SQL} select elem_id, {r6(f"{_CA} * x - {_SA} * y", "turned_x")}, {r6(f"{_SA} * x + {_CA} * y", "turned_y")},
{r6(f"{_CA} * x + {_SA} * y", "back_x")}, {r6(f"-{_SA} * x + {_CA} * y", "back_y")}, {r6(f"{_CA} * x - {_SA} * y", "matrix_x")}, {r6(f"{_SA} * x + {_CA} * y", "matrix_y")},
round(0.7, 6) as angle, {r6("-0.4 / sqrt(1.16)", "normal_x")}, {r6("1 / sqrt(1.16)", "normal_y")}, {r6("(y - 0.4 * x) / sqrt(1.16)", "offset")}, {r6("y - 0.4 * x", "meets")} from p""")
def plane_rotations(spark, sf_dir):
    p, m = xy(), vec.rotation_matrix(0.7)
    normal, offset = vec.plane_from_slope({"x": 0.4}, "y", p)
    return _picked(
        spark, sf_dir, turned=vec.rotate2(p, 0.7), back=vec.rotate2(p, 0.7, invert=True), matrix=vec.apply_matrix(m, p),
        angle=vec.rotation_angles(m), normal=normal, offset=offset, meets=vec.height_at_zero(0.4, p["x"], p["y"]),
    )


_E = {f"{f[0]}{k}": f"{f}({v})" for f in ("sin", "cos") for k, v in (("x", 0.3), ("y", -0.5), ("z", 1.1))}
_ROWS = {
    "x": "{cz}*{cy}*x + ({cz}*{sy}*{sx} - {sz}*{cx})*y + ({cz}*{sy}*{cx} + {sz}*{sx})*z",
    "y": "{sz}*{cy}*x + ({sz}*{sy}*{sx} + {cz}*{cx})*y + ({sz}*{sy}*{cx} - {cz}*{sx})*z",
    "z": "-{sy}*x + {cy}*{sx}*y + {cy}*{cx}*z",
}


@query(f"""with {P_SQL}, {_XYZ} select elem_id, {", ".join(r6(t.format(**_E), f"euler_{a}") for a, t in _ROWS.items())},
0.3 as angles_x, -0.5 as angles_y, 1.1 as angles_z, {r6("x", "again_x")}, {r6("y", "again_y")}, {r6("z", "again_z")},
{r6(f"cos({_N}) + (y - z) * sin({_N}) / {_N} + x * (x + y + z) * (1 - cos({_N})) / ({_N} * {_N})", "about_x")} from s where {_N} > 0""")
def space_rotations(spark, sf_dir):
    p = xyz()
    m = vec.euler_matrix({"x": F.lit(0.3), "y": F.lit(-0.5), "z": F.lit(1.1)})
    one = {a: F.lit(1.0) for a in p}
    about = vec.apply_matrix(vec.rotation_matrix(p), one)["x"]
    euler = vec.apply_matrix(m, p)
    rows = plain_points(spark, sf_dir).where(vec.length(p) > 0)
    columns = _named(euler=euler, angles=vec.rotation_angles(m), again=vec.apply_matrix(m, euler, invert=True), about_x=about)
    return rounded(rows.select("elem_id", *columns))


_T = "greatest(0.0, least(1.0, (3 * (x - 1) + 4 * (y - 2)) / 25))"
_D = "(2 * x - y + 3 * z - 0.5) / sqrt(14)"


@query(f"""with {P_SQL}, {_XYZ} select elem_id, {r6(_D, "distance")}, {r6(f"x - 2 / sqrt(14) * ({_D})", "foot_x")}, {r6(f"z - 3 / sqrt(14) * ({_D})", "foot_z")},
{r6(f"1 + 3 * {_T}", "near_x")}, {r6(f"2 + 4 * {_T}", "near_y")},
{r6("sqrt(greatest(0.0, (x - 1) * (x - 1) + (y - 2) * (y - 2) + z * z - ((3 * (x - 1) + 4 * (y - 2)) / 5) * ((3 * (x - 1) + 4 * (y - 2)) / 5)))", "from_line")},
{r6("(2 * x - 3 * y) / 7", "first")}, {r6("(x + 2 * y) / 7", "second")}, {r6("(x * 4 + y * 1.5) / 16.3", "re")} from s""")
def planes_and_lines(spark, sf_dir):
    p = xyz()
    normal = vec.normalize({"x": F.lit(2.0), "y": F.lit(-1.0), "z": F.lit(3.0)})
    offset = F.lit(0.5 / 14**0.5)
    a, b = {"x": F.lit(1.0), "y": F.lit(2.0), "z": F.lit(0.0)}, {"x": F.lit(4.0), "y": F.lit(6.0), "z": F.lit(0.0)}
    foot, near = vec.closest_on_plane(offset, normal, p), vec.closest_on_segment(a, b, p)
    first, second = vec.solve2x2(2.0, 3.0, -1.0, 2.0, p["x"], p["y"])
    product = vec.complex_multiply(vec.complex_(p["x"] / 16.3, p["y"] / 16.3), vec.complex_(4.0, -1.5))
    return _picked(
        spark, sf_dir, distance=vec.plane_distance(offset, normal, p), foot_x=foot["x"], foot_z=foot["z"], near_x=near["x"], near_y=near["y"],
        from_line=vec.line_distance(a, vec.subtract(b, a), p), first=first, second=second, re=product["re"],
    )


# --- fields -------------------------------------------------------------------------------------------


@query(f"""with {G_SQL} select ix, iy, (v >= u)::double as at_least, (v < u)::double as less, (v <= 0.04)::double as low, -v as negative, abs(v - 0.04) as off, (v <> 0)::double as mask from g""")
def field_comparisons(spark, sf_dir):
    from ..field import Field

    df, grid = line_field(spark, sf_dir), line_grid()
    v, u = Field(df.select("ix", "iy", "v"), grid), Field(df.select("ix", "iy", "u"), grid, "u")
    parts = {"at_least": v >= u, "less": v < u, "low": v <= 0.04, "negative": -v, "off": abs(v - 0.04), "mask": v.mask()}
    out = None
    for name, f in parts.items():
        part = f.df.select("ix", "iy", F.col("v").alias(name))
        out = part if out is None else out.join(part, ["ix", "iy"])
    return out.select("ix", "iy", *[(F.col(c) + 0.0).alias(c) for c in parts])


_BALL_AT = "sqrt((ix + 0.5 - 20) * (ix + 0.5 - 20) + (iy + 0.5 - 5) * (iy + 0.5 - 5))"


@query(f"""with {G_SQL} select ix, iy, ({_BALL_AT} <= 4)::double as hard, {r6(f"greatest(0.0, least(1.0, 0.5 - ({_BALL_AT} - 4) / sqrt(0.5)))", "soft")} from g""")
def geometry_masks(spark, sf_dir):
    grid = line_grid()
    ball = Sphere({"x": 20.0, "y": 5.0}, 4.0)
    spot = lattice.centers(grid)
    cells = lattice.lattice(spark, grid)
    return rounded(cells.select("ix", "iy", ball.lies_inside(spot).cast("double").alias("hard"), ball.fraction_inside(spot, F.lit(0.5**0.5)).alias("soft")))


@query(_GRID_SQL["semi_lagrangian_step"])
def advect_lattice(spark, sf_dir):
    df, grid = line_field(spark, sf_dir), line_grid(0.0)
    out = physics.advect(df.select("ix", "iy", "v"), df.select("ix", "iy", "w", "u"), grid, {"x": "w", "y": "u"}, 3.0)
    return rounded(out.select("ix", "iy", "v"))


@query(_GRID_SQL["advect_points_euler"])
def advect_cloud(spark, sf_dir):
    out = physics.advect(part_points(spark, sf_dir), line_field(spark, sf_dir), line_grid(0.0), {"x": "w", "y": "u"}, 2.0)
    return rounded(out.select("elem_id", "x", "y"))


@query(f"""with {G_SQL}, mid as (select avg(v) as m from g) select ix, iy, true as kept from g, mid where v > m""")
def cells_with_points(spark, sf_dir):
    df, grid = line_field(spark, sf_dir), line_grid()
    mean = F.broadcast(df.agg(F.avg("v").alias("m")))  # one row
    marked = df.crossJoin(mean).withColumn("mask", (F.col("v") > F.col("m")).cast("double"))
    points = lattice.distribute_points(marked, grid, "mask", per_cell=3, seed=4)
    at = lattice.cell_of(grid, False, x=F.col("x"), y=F.col("y"))
    held = points.select(*[c.alias(k) for k, c in at.items()]).groupBy("ix", "iy").agg((F.count("*") == 3).alias("kept"))
    return held


# --- meshes -------------------------------------------------------------------------------------------


def _mesh(spark):
    return mesh.quad_mesh(spark, Grid.of(x=NX, y=NY))


def _values(spark, sf_dir):
    return line_field(spark, sf_dir).select((F.col("ix") * NY + F.col("iy")).cast("long").alias("eid"), "v")


def _slope(dx: int, dy: int) -> str:
    """SQL of the least-squares slope along one axis of unit squares whose rim has slope 0: the rim's faces are half as far."""
    n, i = (NX, "a.ix") if dx else (NY, "a.iy")
    up, down = nb("v", dx, dy, "edge", "edge"), nb("v", -dx, -dy, "edge", "edge")
    return f"(case when {i} < {n - 1} then {up} - a.v else 0.0 end - case when {i} > 0 then {down} - a.v else 0.0 end) / 2"


@query(f"with {G_SQL} select (a.ix * {NY} + a.iy)::bigint as eid, {r6(_slope(1, 0), 'dx')}, {r6(_slope(0, 1), 'dy')} from g a")
def least_squares_slopes(spark, sf_dir):
    m = _mesh(spark)
    rules = {n: "edge" for n in ("x-", "x+", "y-", "y+")}
    return rounded(mesh.least_squares_gradient(m, mesh.faces(m), _values(spark, sf_dir), rules))


@query(f"""with {G_SQL} select (a.ix * {NY} + a.iy)::bigint as eid, ((a.ix > 0)::int + (a.ix < {NX - 1})::int + (a.iy > 0)::int + (a.iy < {NY - 1})::int)::bigint as sides,
((case when a.ix in (0, {NX - 1}) then 2 else 3 end) * (case when a.iy in (0, {NY - 1}) then 2 else 3 end) - 1)::bigint as touching,
((a.ix > 0)::int + (a.ix < {NX - 1})::int + (a.iy > 0)::int + (a.iy < {NY - 1})::int)::double as far from g a""")
def mesh_connectivity(spark, sf_dir):
    m = _mesh(spark)
    rows = mesh.faces(m)
    sides = mesh.cell_connectivity(rows).groupBy("eid").agg(F.count("*").alias("sides"))
    touching = mesh.element_connectivity(m.elements).groupBy(F.col("a").alias("eid")).agg(F.count("*").alias("touching"))
    far = mesh.distance_matrix(m, rows).groupBy("eid").agg(F.round(F.sum("distance"), 6).alias("far"))
    return sides.join(touching, "eid").join(far, "eid")


@query(f"""select * from (values ({(NX + 1) * (NY + 1)}::bigint, {2 * (NX * (NY + 1) + NY * (NX + 1))}::bigint, {2 * (NX + NY)}::bigint, 0.0::double, 0.0::double, {NX}.0::double, {NY}.0::double)) t(vertices, links, rim, lower_x, lower_y, upper_x, upper_y)""")
def mesh_counts(spark, sf_dir):
    m = mesh.filter_unused(_mesh(spark))
    counts = m.vertices.agg(F.count("*").alias("vertices"))
    links = mesh.vertex_connectivity(m.elements).agg(F.count("*").alias("links"))
    rim = mesh.boundary_connectivity(mesh.faces(m)).agg(F.count("*").alias("rim"))
    return counts.crossJoin(links).crossJoin(rim).crossJoin(mesh.bounds(m))  # one row each


# --- graphs of orders -----------------------------------------------------------------------------------


@query("""with n as (select s_suppkey as node, s_acctbal / 1000 as x, s_nationkey::double as y from supplier),
e as (select a.node as src, b.node as dst, b.x - a.x as dx, b.y - a.y as dy from n a join n b on a.y = b.y and a.node < b.node and b.node - a.node <= 50)
select src, dst, round(dx, 6) + 0.0 as dx, round(case when dx * dx + dy * dy = 0 then 0.0 else dx / sqrt(dx * dx + dy * dy) end, 6) + 0.0 as unit_x,
round(max(sqrt(dx * dx + dy * dy)) over (), 6) as longest from e""")
def supplier_graph(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") / 1000).cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    near = nodes.select(F.col("node").alias("src"), "y").join(nodes.select(F.col("node").alias("dst"), "y"), "y")
    edges = graph.edges_of(nodes, near.where("src < dst and dst - src <= 50").select("src", "dst"), ("x", "y"))
    longest = F.broadcast(graph.bounding_distance(edges).toDF("longest"))  # one row
    out = graph.unit_deltas(edges, ("x", "y")).crossJoin(longest)
    units = [c for c in out.columns if c not in (*edges.columns, "longest")]
    return rounded(out.select("src", "dst", "dx", F.col(units[0]).alias("unit_x"), "longest"))


# --- solves, held by their residuals ----------------------------------------------------------------------

_CELLS_SMALL = f"with {G_SQL} select ix, iy, true as small from g"


def _small(df, grid, residual: str, limit: float):
    return df.select(*grid.keys, (F.abs(F.col(residual)) < limit).alias("small"))


@query(_CELLS_SMALL)
def poisson_residual(spark, sf_dir):
    grid = line_grid(0.0)
    b = line_field(spark, sf_dir).select("ix", "iy", (-F.col("v")).alias("b"))
    x = solve.solve_lattice(b, grid, "b", "x", relative=1e-10)
    both = stencil.laplace(x, grid, "x", "l").join(b, grid.keys)
    return _small(both.withColumn("r", F.col("l") + F.col("b")), grid, "r", 1e-8)


@query(_CELLS_SMALL)
def implicit_diffusion_residual(spark, sf_dir):
    grid = line_grid({"x": (0.5, "edge"), "y": 0.1})
    v = line_field(spark, sf_dir).select("ix", "iy", "v")
    x = physics.diffuse_implicit(v, grid, 0.4, 1.5, relative=1e-11)
    back = stencil.laplace(x, grid, "v", "l").withColumn("back", F.col("v") - F.col("l") * 0.6).select("ix", "iy", "back")
    return _small(back.join(v, grid.keys).withColumn("r", F.col("back") - F.col("v")), grid, "r", 1e-8)


@query(_CELLS_SMALL)
def fourier_laplace_residual(spark, sf_dir):
    grid = line_grid("periodic")
    v = line_field(spark, sf_dir).select("ix", "iy", "v")
    back = solve.fourier_laplace(solve.fourier_poisson(v, grid), grid).withColumnRenamed("v", "back")
    mean = F.broadcast(v.agg(F.avg("v").alias("m")))  # one row
    both = back.join(v, grid.keys).crossJoin(mean)
    return _small(both.withColumn("r", F.col("back") - F.col("v") + F.col("m")), grid, "r", 1e-8)


@query(_CELLS_SMALL)
def compact_scheme_residual(spark, sf_dir):
    """The left side of the compact schemes, applied to their results, is their right side."""
    grid = line_grid("periodic")
    v = line_field(spark, sf_dir).select("ix", "iy", "v")
    found = stencil.compact_gradient(v, grid, axes=("x",)).join(stencil.compact_laplace(v, grid, axes=("x",)).drop("v"), grid.keys)
    at = lambda c, k: f"{c}_{k + 2}"
    near = stencil.shifted(found, grid, {at(c, k): (c, "x", k) for c in ("v", "dx", "laplace") for k in (-2, -1, 0, 1, 2)})
    of = lambda c, k: F.col(at(c, k))
    first = of("dx", 0) + (of("dx", 1) + of("dx", -1)) / 3 - (of("v", 1) - of("v", -1)) * 7 / 9 - (of("v", 2) - of("v", -2)) / 36
    second = of("laplace", 0) + (of("laplace", 1) + of("laplace", -1)) * 2 / 11
    second = second - (of("v", 1) - 2 * of("v", 0) + of("v", -1)) * 12 / 11 - (of("v", 2) - 2 * of("v", 0) + of("v", -2)) * 3 / 44
    return _small(near.withColumn("r", F.abs(first) + F.abs(second)), grid, "r", 1e-9)


@query(_CELLS_SMALL)
def obstacle_projection_residual(spark, sf_dir):
    """Around a ball that moves and a turning box, the projected field has no divergence where there is fluid."""
    grid = line_grid(0.0)
    faces = stencil.at_faces(part_field(spark, sf_dir), grid, "v")
    box = fluid.Obstacle(Box({"x": 30.0, "y": 3.0}, {"x": 36.0, "y": 7.0}), angular_velocity=0.1)
    ball = fluid.Obstacle(Sphere({"x": 12.0, "y": 5.5}, 3.0), {"x": 0.2})
    free, _ = fluid.make_incompressible(faces, grid, [box, ball], relative=1e-9)
    spot = lattice.centers(grid)
    wet = lattice.lattice(spark, grid).where(~(box.geometry.lies_inside(spot) | ball.geometry.lies_inside(spot)))
    div = wet.join(stencil.divergence(free, grid, "r"), grid.keys, "left").na.fill(0.0, ["r"])
    # a moving obstacle takes fluid in or gives it off: the balance is the same in all fluid cells
    mean = F.broadcast(div.agg(F.avg("r").alias("m")))  # one row
    fluid_cells = _small(div.crossJoin(mean).withColumn("r", F.col("r") - F.col("m")), grid, "r", 1e-6)
    dry = lattice.lattice(spark, grid).join(fluid_cells, grid.keys, "left_anti")
    return fluid_cells.union(dry.select(*grid.keys, F.lit(True)))


@query(f"with {P_SQL} select elem_id, true as small from p")
def line_trace_residual(spark, sf_dir):
    """Where sphere tracing meets a ball, the distance is 0; rays that miss it pass farther off than it."""
    ball = Sphere({"x": 20.0, "y": 40.0}, 15.0)
    p = xy()
    way = vec.normalize({"x": 25.0 - p["x"], "y": 45.0 - p["y"]})
    t = line_trace(ball, p, way, steps=96, factor=1.0)
    hit = ball.sdf({a: p[a] + way[a] * t for a in p})
    start = ball.sdf(p) > 0
    met = F.when(start & t.isNotNull(), F.abs(hit) < 1e-2)
    return plain_points(spark, sf_dir).select("elem_id", F.coalesce(met, F.lit(True)).alias("small"))


# --- lattices that grow -----------------------------------------------------------------------------------

#: Line numbers of an order, and the unit of prices: results then have no ties where they are rounded.
LINES, PRICE = 7, 97531.0


def order_lattice(spark, sf_dir, boundary="edge") -> tuple:
    """(ix, iy, v, w) by order number and line number: scaled price, scaled discount; as many cells as orders times lines."""
    rows = table(spark, sf_dir, "lineitem")
    n = int(rows.agg(F.max("l_orderkey")).first()[0]) + 1
    grid = Grid.of(boundary, x=n, y=LINES)
    found = rows.groupBy(F.col("l_orderkey").cast("int").alias("ix"), (F.col("l_linenumber") - 1).cast("int").alias("iy")).agg(
        (F.sum("l_extendedprice") / PRICE).alias("v"), (F.sum("l_discount") / 0.97).alias("w")
    )
    return lattice.lattice(spark, grid).join(found, ["ix", "iy"], "left").na.fill(0.0), grid


O_SQL = f"""size as (select max(l_orderkey) + 1 as n from lineitem),
found as (select l_orderkey::int as ix, (l_linenumber - 1)::int as iy, sum(l_extendedprice) / {PRICE} as v, sum(l_discount) / 0.97 as w from lineitem group by 1, 2),
o as (select i.ix::int as ix, j.iy::int as iy, coalesce(v, 0.0) as v, coalesce(w, 0.0) as w
  from (select unnest(range(n)) as ix from size) i cross join (select unnest(range({LINES})) as iy) j left join found on i.ix = found.ix and j.iy = found.iy)"""


def along(c: str, k: int, axis: str, fallback: str) -> str:
    other = "iy" if axis == "ix" else "ix"
    f = "lead" if k > 0 else "lag"
    return f"coalesce({f}({c}, {abs(k)}) over (partition by {other} order by {axis}), {fallback})"


def _four(c: str, fallback: str) -> str:
    return " + ".join(along(c, k, a, fallback) for a in ("ix", "iy") for k in (1, -1))


@query(f"with {O_SQL} select ix, iy, {r6(f'{_four("v", "v")} - 4 * v', 'laplace')} from o")
def orders_laplace(spark, sf_dir):
    df, grid = order_lattice(spark, sf_dir)
    return rounded(stencil.laplace(df.select("ix", "iy", "v"), grid).select("ix", "iy", "laplace"))


@query(f"with {O_SQL} select ix, iy, {r6(f'({along("v", 1, "ix", "v")} - {along("v", -1, "ix", "v")} + {along("w", 1, "iy", "w")} - {along("w", -1, "iy", "w")}) / 2', 'divergence')} from o")
def orders_divergence(spark, sf_dir):
    df, grid = order_lattice(spark, sf_dir)
    return rounded(stencil.divergence_centered(df, grid, {"x": "v", "y": "w"}).select("ix", "iy", "divergence"))


@query(f"""with {O_SQL}, s1 as (select ix, iy, v + 0.1 * ({_four("v", "v")} - 4 * v) as v from o), s2 as (select ix, iy, v + 0.1 * ({_four("v", "v")} - 4 * v) as v from s1)
select ix, iy, {r6("v", "v")} from s2""")
def orders_diffuse_2(spark, sf_dir):
    df, grid = order_lattice(spark, sf_dir)
    return rounded(physics.diffuse_explicit(df.select("ix", "iy", "v"), grid, 0.1, 2.0, substeps=2).select("ix", "iy", "v"))


@query(f"""with {O_SQL}, p as (select l_orderkey as k, l_linenumber as m, l_orderkey + min(l_tax) as x, l_linenumber - 1 + min(l_discount) as y from lineitem group by 1, 2),
b as (select k, m, floor(x - 0.5) as bx, floor(y - 0.5) as by_, x - 0.5 - floor(x - 0.5) as fx, y - 0.5 - floor(y - 0.5) as fy from p),
c as (select k, m, i, j, (case when i = 1 then fx else 1 - fx end) * (case when j = 1 then fy else 1 - fy end) as weight,
  greatest(0, least(n - 1, bx + i))::int as ix, greatest(0, least({LINES - 1}, by_ + j))::int as iy from b, size, (values (0), (1)) s(i), (values (0), (1)) t(j))
select k, m, {r6("sum(weight * v)", "v")} from c join o using (ix, iy) group by k, m""")
def orders_sample(spark, sf_dir):
    df, grid = order_lattice(spark, sf_dir)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("m"))
    points = rows.agg(F.min("l_tax").alias("t"), F.min("l_discount").alias("d"))
    points = points.select("k", "m", (F.col("k") + F.col("t")).cast("double").alias("x"), (F.col("m") - 1 + F.col("d")).cast("double").alias("y"))
    return rounded(resample.interpolate(points, df.select("ix", "iy", "v"), grid, ["v"]).select("k", "m", "v"))


@query(f"""with {O_SQL}, s as (select o_orderkey::int as ix, (o_orderkey % {LINES})::int as iy, sum(o_totalprice / {PRICE}) as t from orders group by 1, 2)
select ix, iy, {r6("coalesce(t, 0.0)", "v")} from o left join s using (ix, iy)""")
def orders_scatter(spark, sf_dir):
    _, grid = order_lattice(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 0.5).cast("double").alias("x"), (F.col("o_orderkey") % LINES + 0.5).cast("double").alias("y"), (F.col("o_totalprice") / PRICE).alias("v")
    )
    return rounded(resample.scatter(rows, grid, "v", mode="add", outside="discard"))
