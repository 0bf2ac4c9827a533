"""Queries on lattices: scatter, stencils, reductions, diffusion, advection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..meta import EDGE, PERIODIC, ZERO, Grid
from ..operators import aggregate as agg
from ..operators import physics, resample, solve, stencil
from .tables import G_SQL, NX, NY, P_SQL, Q_SQL, line_field, line_grid, part_field, part_points, plain_points, rounded, table

MIXED = {"x": EDGE, "y": ZERO}
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def nb(c: str, dx: int, dy: int, rule_x: str, rule_y: str) -> str:
    """SQL for a neighbour's value: joins are by index arithmetic on table g."""
    x = {"edge": f"greatest(0, least({NX - 1}, a.ix + {dx}))", "periodic": f"((a.ix + {dx} + {NX}) % {NX})", "zero": f"a.ix + {dx}"}[rule_x]
    y = {"edge": f"greatest(0, least({NY - 1}, a.iy + {dy}))", "periodic": f"((a.iy + {dy} + {NY}) % {NY})", "zero": f"a.iy + {dy}"}[rule_y]
    return f"coalesce((select b.{c} from g b where b.ix = {x} and b.iy = {y}), 0.0)"


def lap(c: str, rx: str, ry: str) -> str:
    return f"({nb(c, 1, 0, rx, ry)} + {nb(c, -1, 0, rx, ry)} + {nb(c, 0, 1, rx, ry)} + {nb(c, 0, -1, rx, ry)} - 4 * a.{c})"


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 as {name}"


@query(f"""with {G_SQL} select ix, iy, v from g""")
def grid_scatter_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 0.5).alias("x"), (F.round(F.col("l_discount") * 100) + 0.5).alias("y"), F.col("l_tax").alias("v"))
    return rounded(resample.scatter(rows, line_grid(), "v"), 9)


@query(f"""with {G_SQL}, s as (select cast(l_quantity as int) - 1 as ix, cast(round(100 * l_discount) as int) as iy, sum(l_quantity) as v from lineitem group by 1, 2)
select ix, iy, {r6("coalesce(s.v, 0.0)", "v")} from lat left join s using (ix, iy)""")
def grid_scatter_add(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 0.5).alias("x"), (F.round(F.col("l_discount") * 100) + 0.5).alias("y"), F.col("l_quantity").alias("v"))
    return rounded(resample.scatter(rows, line_grid(), "v", mode="add"))


_SCATTER = """with {p}, c as (select {cell} as ix, {row} as iy, x from p {where})
select ix::int as ix, iy::int as iy, round(avg(x), 6) + 0.0 as x from c group by 1, 2"""
_SMALL = Grid.of(0.0, lower={"x": 5, "y": 10}, upper={"x": 45, "y": 90}, x=8, y=8)


@query(_SCATTER.format(p=P_SQL, cell="least(7, greatest(0, floor((x - 5) / 5)))", row="least(7, greatest(0, floor((y - 10) / 10)))", where=""))
def scatter_clamp(spark, sf_dir):
    points = plain_points(spark, sf_dir)
    out = resample.scatter(points.withColumn("v", F.col("x")), _SMALL, "v", outside="clamp", base=None)
    return rounded(out.withColumnRenamed("v", "x"))


@query(_SCATTER.format(p=P_SQL, cell="floor((x - 5) / 5)", row="floor((y - 10) / 10)", where="where x >= 5 and x < 45 and y >= 10 and y < 90"))
def scatter_discard(spark, sf_dir):
    points = plain_points(spark, sf_dir)
    out = resample.scatter(points.withColumn("v", F.col("x")), _SMALL, "v", outside="discard", base=None)
    return rounded(out.withColumnRenamed("v", "x"))


@query(f"""with {G_SQL} select a.ix, a.iy, {r6(lap("v", "edge", "zero"), "laplace")} from g a""")
def laplace_mixed_boundary(spark, sf_dir):
    return rounded(stencil.laplace(line_field(spark, sf_dir), line_grid(MIXED), "v").drop("v"))


@query(f"""with {G_SQL} select a.ix, a.iy, round(({f"2 * ({nb('v', 1, 0, 'periodic', 'periodic')} + {nb('v', -1, 0, 'periodic', 'periodic')} - 2 * v) + 3 * ({nb('v', 0, 1, 'periodic', 'periodic')} + {nb('v', 0, -1, 'periodic', 'periodic')} - 2 * v)"}), 9) + 0.0 as laplace from g a""")
def laplace_weighted(spark, sf_dir):
    return rounded(stencil.laplace(line_field(spark, sf_dir), line_grid("periodic"), "v", weights={"x": 2.0, "y": 3.0}).drop("v"), 9)


def _fourth(d: str) -> str:
    at = lambda k: nb("v", *((k, 0) if d == "x" else (0, k)), "periodic", "periodic")
    return f"((-{at(2)} + 16 * {at(1)} - 30 * v + 16 * {at(-1)} - {at(-2)}) / 12.0)"


@query(f"""with {G_SQL} select a.ix, a.iy, {r6(f"{_fourth('x')} + {_fourth('y')}", "laplace")} from g a""")
def laplace_order4(spark, sf_dir):
    return rounded(stencil.laplace(line_field(spark, sf_dir), line_grid("periodic"), "v", order=4).drop("v"))


@query(f"""with {G_SQL} select a.ix, a.iy, {r6(f"({nb('v', 1, 0, 'edge', 'edge')} - {nb('v', -1, 0, 'edge', 'edge')}) / 2", "dx")}, {r6(f"({nb('v', 0, 1, 'edge', 'edge')} - {nb('v', 0, -1, 'edge', 'edge')}) / 2", "dy")} from g a""")
def gradient_center(spark, sf_dir):
    return rounded(stencil.gradient(line_field(spark, sf_dir), line_grid("edge"), "v").drop("v"))


def _staggered(f: str) -> str:
    return f"""select 'x' as axis, hi.ix, hi.iy, {f} as v from g lo join g hi on hi.ix = lo.ix + 1 and hi.iy = lo.iy
union all select 'y', hi.ix, hi.iy, {f} from g lo join g hi on hi.iy = lo.iy + 1 and hi.ix = lo.ix"""


@query(f"""with {G_SQL}, f as ({_staggered("hi.v - lo.v")}) select axis, ix, iy, {r6("v", "v")} from f""")
def gradient_face(spark, sf_dir):
    return rounded(stencil.face_gradient(line_field(spark, sf_dir), line_grid(0.0), "v"))


@query(f"""with {G_SQL}, f as ({_staggered("least(lo.v, hi.v)")}) select axis, ix, iy, {r6("v", "v")} from f""")
def stagger_min(spark, sf_dir):
    return rounded(stencil.stagger(line_field(spark, sf_dir), line_grid(0.0), F.least, "v"))


@query(f"""with {G_SQL} select a.ix, a.iy, {r6(f"{nb('v', 1, 0, 'periodic', 'periodic')} - v", "d")} from g a""")
def periodic_forward_diff(spark, sf_dir):
    out = stencil.shift(line_field(spark, sf_dir).select("ix", "iy", "v"), line_grid("periodic"), (1,), ("x",))
    return rounded(out.select("ix", "iy", (F.col("x_p1") - F.col("v")).alias("d")))


@query(f"""with {G_SQL} select a.ix, a.iy, {r6(f"({nb('v', 1, 0, 'periodic', 'periodic')} - {nb('v', -1, 0, 'periodic', 'periodic')}) / 2 + ({nb('w', 0, 1, 'periodic', 'periodic')} - {nb('w', 0, -1, 'periodic', 'periodic')}) / 2", "divergence")} from g a""")
def divergence_centered(spark, sf_dir):
    out = stencil.divergence_centered(line_field(spark, sf_dir), line_grid("periodic"), {"x": "v", "y": "w"})
    return rounded(out.drop("v", "w"))


@query(f"""with {G_SQL}, f as ({_staggered("(lo.v + hi.v) / 2")}), s as (select ix, iy, case axis when 'x' then -v else -v end as v from f
union all select ix - 1, iy, v from f where axis = 'x' union all select ix, iy - 1, v from f where axis = 'y')
select ix, iy, {r6("sum(v)", "divergence")} from s group by ix, iy""")
def divergence_staggered(spark, sf_dir):
    faces = stencil.at_faces(line_field(spark, sf_dir), line_grid(0.0), "v")
    return rounded(stencil.divergence(faces, line_grid(0.0)))


@query(f"""with {G_SQL}, f as ({_staggered("(lo.v + hi.v) / 2")}), s as (select axis, ix, iy, v / 2 as v from f
union all select axis, ix - 1, iy, v / 2 from f where axis = 'x' union all select axis, ix, iy - 1, v / 2 from f where axis = 'y')
select ix, iy, {r6("coalesce(sum(v) filter (where axis = 'x'), 0)", "vx")}, {r6("coalesce(sum(v) filter (where axis = 'y'), 0)", "vy")} from s group by ix, iy""")
def faces_to_centers(spark, sf_dir):
    faces = stencil.at_faces(line_field(spark, sf_dir), line_grid(0.0), "v")
    return rounded(stencil.at_centers(faces, line_grid(0.0)))


@query(f"""with {G_SQL}, f as ({_staggered("hi.v * lo.v + hi.iy")}), s as (
select ix, iy, v from f where axis = 'y' union all select ix + 1, iy, -v from f where axis = 'y'
union all select ix, iy, -v from f where axis = 'x' union all select ix, iy + 1, v from f where axis = 'x')
select ix::int as ix, iy::int as iy, {r6("sum(v)", "curl")} from s where ix between 1 and {NX - 1} and iy between 1 and {NY - 1} group by 1, 2""")
def curl_2d(spark, sf_dir):
    # a value that also depends on the row, so the curl is not 0
    df = line_field(spark, sf_dir)
    faces = stencil.stagger(df, line_grid(0.0), lambda lo, hi: hi * lo, "v").withColumn("v", F.col("v") + F.col("iy"))
    return rounded(stencil.curl_corners(faces, line_grid(0.0)))


@query(f"""with {G_SQL}, w as (select (i.range // {NY + 2})::int as ix, (i.range % {NY + 2})::int as iy from range({(NX + 2) * (NY + 2)}) i)
select w.ix, w.iy, {r6("case when w.iy in (0, " + str(NY + 1) + ") then 0.5 else g.v end", "v")} from w
left join g on g.ix = greatest(0, least({NX - 1}, w.ix - 1)) and g.iy = w.iy - 1""")
def pad_grid(spark, sf_dir):
    return rounded(stencil.pad(line_field(spark, sf_dir), line_grid({"x": EDGE, "y": 0.5}), {"x": 1, "y": 1}, "v"))


@query(f"""with {G_SQL} select a.ix, a.iy, {r6("v", "v")}, {r6(nb("v", -2, 0, "edge", "edge"), "x_m2")}, {r6(nb("v", 1, 0, "edge", "edge"), "x_p1")}, {r6(nb("v", 0, -2, "edge", "edge"), "y_m2")}, {r6(nb("v", 0, 1, "edge", "edge"), "y_p1")} from g a""")
def shift_grid(spark, sf_dir):
    return rounded(stencil.shift(line_field(spark, sf_dir).select("ix", "iy", "v"), line_grid("edge"), (-2, 1)))


@query(f"""with {G_SQL} select (ix // 2)::int as ix, (iy // 2)::int as iy, {r6("avg(v)", "v")} from g group by 1, 2""")
def downsample2x(spark, sf_dir):
    return rounded(stencil.downsample2x(line_field(spark, sf_dir), line_grid(), "v")[0])


@query(f"""with {G_SQL}, e as (select a.ix, a.iy, v, {nb("v", -1, 0, "edge", "edge")} as m, {nb("v", 1, 0, "edge", "edge")} as p from g a),
h as (select 2 * ix as ix, iy, 0.75 * v + 0.25 * m as v from e union all select 2 * ix + 1, iy, 0.75 * v + 0.25 * p from e),
k as (select h.ix, h.iy, h.v, m.v as m, p.v as p from h join h m on m.ix = h.ix and m.iy = greatest(0, h.iy - 1) join h p on p.ix = h.ix and p.iy = least({NY - 1}, h.iy + 1))
select ix::int as ix, (2 * iy)::int as iy, {r6("0.75 * v + 0.25 * m", "v")} from k union all select ix::int, (2 * iy + 1)::int, {r6("0.75 * v + 0.25 * p", "v")} from k""")
def upsample2x(spark, sf_dir):
    return rounded(stencil.upsample2x(line_field(spark, sf_dir), line_grid("edge"), "v")[0])


_S = """s as (select p_size - 1 as ix, floor(p_retailprice - 900)::int as iy, round(avg(p_retailprice), 9) as v from part group by 1, 2),
f as (select (i.range // 100)::int as ix, (i.range % 100)::int as iy, s.v from range(5000) i left join s on s.ix = i.range // 100 and s.iy = i.range % 100)"""


@query(f"""with {_S} select a.ix, a.iy, round(coalesce(a.v, (select avg(b.v) from f b where abs(b.ix - a.ix) <= 1 and abs(b.iy - a.iy) <= 1)), 6) + 0.0 as v from f a""")
def finite_fill(spark, sf_dir):
    grid = Grid.of("none", x=50, y=100)
    rows = table(spark, sf_dir, "part").groupBy((F.col("p_size") - 1).cast("int").alias("ix"), F.floor(F.col("p_retailprice") - 900).cast("int").alias("iy")).agg(F.round(F.avg("p_retailprice"), 9).alias("v"))
    from ..operators.lattice import lattice

    return rounded(stencil.finite_fill(lattice(spark, grid).join(rows, ["ix", "iy"], "left"), grid, "v"))


@query(f"""with {G_SQL} select {r6("avg(v)", "mean")} from g""")
def field_mean(spark, sf_dir):
    return rounded(agg.mean(line_field(spark, sf_dir), "v"))


@query(f"""with {G_SQL} select {r6("sum((ix + 0.5) * v) / sum(v)", "x")}, {r6("sum((iy + 0.5) * v) / sum(v)", "y")} from g""")
def center_of_mass(spark, sf_dir):
    return rounded(agg.center_of_mass(line_field(spark, sf_dir), line_grid(), "v"))


@query(f"""with {G_SQL} select {r6("sum(v)", "integral")} from g where (ix + 0.5 - 25) * (ix + 0.5 - 25) + (iy + 0.5 - 5) * (iy + 0.5 - 5) <= 16""")
def integrate_region(spark, sf_dir):
    from ..operators.geometry import Sphere

    ball = Sphere({"x": 25.0, "y": 5.0}, 4.0)
    return rounded(agg.integrate(line_field(spark, sf_dir), line_grid(), ball.lies_inside({"x": F.col("x"), "y": F.col("y")}), "v"))


@query(f"""with {G_SQL} select ix, iy, (row_number() over (order by v desc, ix, iy) <= {NX * NY // 4})::int as mark from g""")
def discretize_top25(spark, sf_dir):
    return agg.discretize(line_field(spark, sf_dir), line_grid(), 0.25, "v")


@query(f"""with {G_SQL} select ix, iy, {r6("case when u > 0.05 then v else w end", "v")}, {r6("greatest(v, w)", "high")}, {r6("least(v, w)", "low")} from g""")
def where_min_max(spark, sf_dir):
    from ..field import Field, maximum, minimum, where

    df = line_field(spark, sf_dir)
    f = lambda c: Field(df.select("ix", "iy", F.col(c).alias("v")), line_grid())
    a, b, m = f("v"), f("w"), f("u") > 0.05
    chosen = where(m, a, b).df
    high, low = maximum(a, b).df.withColumnRenamed("v", "high"), minimum(a, b).df.withColumnRenamed("v", "low")
    return rounded(chosen.join(high, ["ix", "iy"]).join(low, ["ix", "iy"]))


@query(f"""with {G_SQL} select ix, iy, {r6("(v + 2 * w) * u - v / (w + 1) + pow(v, 2)", "v")} from g""")
def field_arithmetic(spark, sf_dir):
    from ..field import Field

    df = line_field(spark, sf_dir)
    f = lambda c: Field(df.select("ix", "iy", F.col(c).alias("v")), line_grid())
    v, w, u = f("v"), f("w"), f("u")
    return rounded(((v + 2 * w) * u - v / (w + 1) + v**2).df)


@query(f"""with {G_SQL}, t as (select sum(v) as sv, sum(w) as sw from g) select ix, iy, {r6("v * (sw / sv)", "v")} from g, t""")
def normalize_field(spark, sf_dir):
    df = line_field(spark, sf_dir)
    return rounded(agg.normalize(df.select("ix", "iy", "v"), df.select(F.col("w").alias("v")), "v"))


def _steps(n: int, step: str, first: str) -> str:
    """Chained CTEs g0, g1, ...; ``step`` uses table g."""
    out = [f"g0 as ({first})"]
    for k in range(n):
        out.append(f"g{k + 1} as ({step.replace('from g b', f'from g{k} b').replace('from g a', f'from g{k} a')})")
    return ", ".join(out)


@query(f"""with {G_SQL}, {_steps(5, f"select a.ix, a.iy, v + 0.1 * {lap('v', 'edge', 'zero')} as v from g a", "select ix, iy, v from g")} select ix, iy, {r6("v", "v")} from g5""")
def diffuse_explicit_5(spark, sf_dir):
    out = physics.diffuse_explicit(line_field(spark, sf_dir), line_grid(MIXED), 0.1, 5.0, substeps=5)
    return rounded(out.select("ix", "iy", "v"))


def _varying(d: str) -> str:
    at = lambda c, k: nb(c, *((k, 0) if d == "x" else (0, k)), "edge", "edge")
    return f"least(u, {at('u', 1)}) * ({at('v', 1)} - v) - least(u, {at('u', -1)}) * (v - {at('v', -1)})"


@query(f"""with {G_SQL} select a.ix, a.iy, {r6(f"{_varying('x')} + {_varying('y')}", "rate")} from g a""")
def diffuse_varying(spark, sf_dir):
    df = line_field(spark, sf_dir).select("ix", "iy", "v", "u")
    return rounded(physics.diffusion_rate(df, line_grid("edge"), "v", "u").select("ix", "iy", "rate"))


@query(f"""with {G_SQL} select a.ix, a.iy, {r6(f"2 * v - w + 0.01 * {lap('v', 'zero', 'zero')}", "v")} from g a""")
def wave_step(spark, sf_dir):
    df = line_field(spark, sf_dir)
    near = stencil.laplace(df, line_grid(0.0), "v").drop("v")
    return rounded(df.join(near, ["ix", "iy"]).select("ix", "iy", (2 * F.col("v") - F.col("w") + 0.01 * F.col("laplace")).alias("v")))


_RD = "select a.ix, a.iy, v + 0.2 * {lv} - v * w * w + 0.03 * (1 - v) as v, w + 0.1 * {lw} + v * w * w - 0.09 * w as w from g a"


@query(f"""with {G_SQL}, {_steps(3, _RD.format(lv=lap('v', 'periodic', 'periodic'), lw=lap('w', 'periodic', 'periodic')), "select ix, iy, v, w from g")} select ix, iy, {r6("v", "v")}, {r6("w", "w")} from g3""")
def reaction_diffusion_3(spark, sf_dir):
    grid, df = line_grid("periodic"), line_field(spark, sf_dir).select("ix", "iy", "v", "w")
    for _ in range(3):
        t = stencil.tiled(df, grid, {"x": 1, "y": 1}, ("v", "w"))
        near = {}
        for c in ("v", "w"):
            around = [t.neighbour(c, a, o) for a in grid.axes for o in (-1, 1)]
            near[f"_{c}"] = sum(around, F.lit(0.0)) - 4 * F.col(c)
        v, w = F.col("v"), F.col("w")
        react = v * w * w
        new = {"v": v + 0.2 * F.col("_v") - react + 0.03 * (1 - v), "w": w + 0.1 * F.col("_w") + react - 0.09 * w}
        df = t.own(t.df.withColumns(near).withColumns({f"n{c}": e for c, e in new.items()})).select("ix", "iy", F.col("nv").alias("v"), F.col("nw").alias("w"))
    return rounded(df)


@query()
def poisson_cg(spark, sf_dir):
    """Pressure of the mixed-boundary Poisson problem; its residual is tested, not an SQL form."""
    rows = line_field(spark, sf_dir).select("ix", "iy", F.col("v").alias("b"))
    return rounded(solve.solve_lattice(rows, line_grid(MIXED), relative=1e-10))


@query()
def fourier_poisson(spark, sf_dir):
    return rounded(solve.fourier_poisson(line_field(spark, sf_dir), line_grid("periodic"), "v"))


@query()
def fft_diffuse(spark, sf_dir):
    return rounded(physics.diffuse_fourier(line_field(spark, sf_dir), line_grid("periodic"), 0.5, 1.0))


@query()
def spectral_noise(spark, sf_dir):
    from ..operators.lattice import lattice

    return rounded(solve.noise(lattice(spark, line_grid("periodic")), line_grid("periodic"), seed=3))


def _bilinear(points: str, x: str, y: str, c: str = "v", keys: str = "elem_id") -> str:
    """Bilinear lookup with zero beyond the lattice, of positions (x, y) of a table."""
    u, w = f"greatest(-1.0, least({NX}.0, {x} - 0.5))", f"greatest(-1.0, least({NY}.0, {y} - 0.5))"
    at = f"(select {keys}, least(floor({u}), {NX - 1}) as bx, least(floor({w}), {NY - 1}) as by_, {u} - least(floor({u}), {NX - 1}) as fx, {w} - least(floor({w}), {NY - 1}) as fy from {points})"
    corner = lambda i, j: f"coalesce((select b.{c} from g b where b.ix = bx + {i} and b.iy = by_ + {j}), 0.0)"
    value = f"{corner(0, 0)} * (1 - fx) * (1 - fy) + {corner(1, 0)} * fx * (1 - fy) + {corner(0, 1)} * (1 - fx) * fy + {corner(1, 1)} * fx * fy"
    return f"select {keys}, {value} as {c} from {at}"


@query(f"""with {G_SQL}, {Q_SQL}, r as ({_bilinear("q", "x", "y")}) select elem_id, {r6("v", "v")} from r""")
def grid_sample_bilinear(spark, sf_dir):
    out = resample.interpolate(part_points(spark, sf_dir), line_field(spark, sf_dir), line_grid(0.0), ["v"])
    return rounded(out.select("elem_id", "v"))


@query(f"""with {G_SQL}, {Q_SQL} select elem_id, {r6("v", "v")} from q join g on g.ix = greatest(0, least({NX - 1}, floor(x))) and g.iy = greatest(0, least({NY - 1}, floor(y)))""")
def grid_sample_nearest(spark, sf_dir):
    out = resample.nearest(part_points(spark, sf_dir), line_field(spark, sf_dir), line_grid(), ["v"])
    return rounded(out.select("elem_id", "v"))


@query(f"""with {G_SQL}, back as (select ix, iy, ix + 0.5 - w * 3 as x, iy + 0.5 - u * 3 as y from g), r as ({_bilinear("back", "x", "y", keys="ix, iy")}) select ix, iy, {r6("v", "v")} from r""")
def semi_lagrangian_step(spark, sf_dir):
    out = physics.semi_lagrangian(line_field(spark, sf_dir), line_grid(0.0), ["v"], {"x": "w", "y": "u"}, 3.0)
    return rounded(out.select("ix", "iy", "v"))


def _corner_bounds(points: str) -> str:
    """Least and greatest of the four values around positions (x, y) of a table of cells."""
    at = f"select ix, iy, least(floor(greatest(-1.0, least({NX}.0, x - 0.5))), {NX - 1}) as bx, least(floor(greatest(-1.0, least({NY}.0, y - 0.5))), {NY - 1}) as by_ from {points}"
    corner = [f"coalesce((select b.v from g b where b.ix = bx + {i} and b.iy = by_ + {j}), 0.0)" for i in (0, 1) for j in (0, 1)]
    return f"select ix, iy, least({', '.join(corner)}) as low, greatest({', '.join(corner)}) as high from ({at})"


@query(f"""with {G_SQL}, back as (select ix, iy, ix + 0.5 - w * 1.5 as x, iy + 0.5 - u * 1.5 as y from g), fwd as ({_bilinear("back", "x", "y", keys="ix, iy")}),
lim as ({_corner_bounds("back")}), ahead as (select ix, iy, ix + 0.5 + w * 1.5 as x, iy + 0.5 + u * 1.5 as y from g),
bwd as ({_bilinear("ahead", "x", "y", keys="ix, iy").replace("from g b", "from fwd b")})
select g.ix, g.iy, {r6("greatest(low, least(fwd.v + 0.5 * (g.v - bwd.v), high))", "v")} from g join fwd using (ix, iy) join bwd using (ix, iy) join lim using (ix, iy)""")
def mac_cormack_step(spark, sf_dir):
    out = physics.mac_cormack(line_field(spark, sf_dir), line_grid(0.0), "v", {"x": "w", "y": "u"}, 1.5)
    return rounded(out.select("ix", "iy", "v"))


@query(f"""with {G_SQL}, {Q_SQL}, a as ({_bilinear("q", "x", "y", "w")}), b as ({_bilinear("q", "x", "y", "u")})
select elem_id, {r6("x + 2.0 * w", "x")}, {r6("y + 2.0 * u", "y")} from q join a using (elem_id) join b using (elem_id)""")
def advect_points_euler(spark, sf_dir):
    out = physics.advect_points(part_points(spark, sf_dir), line_field(spark, sf_dir), line_grid(0.0), {"x": "w", "y": "u"}, 2.0)
    return rounded(out.select("elem_id", "x", "y"))


def _stage(k: int, points: str) -> str:
    """CTEs of the velocity (w, u) at the positions of a table, as table k<k>."""
    return f"kw{k} as ({_bilinear(points, 'x', 'y', 'w')}), ku{k} as ({_bilinear(points, 'x', 'y', 'u')}), k{k} as (select elem_id, w, u from kw{k} join ku{k} using (elem_id))"


def _ahead(k: int, part: float) -> str:
    return f"p{k} as (select elem_id, x + {part} * w as x, y + {part} * u as y from q join k{k} using (elem_id))"


@query(f"""with {G_SQL}, {Q_SQL}, {_stage(1, "q")}, {_ahead(1, 1.0)}, {_stage(2, "p1")}, {_ahead(2, 1.0)}, {_stage(3, "p2")}, {_ahead(3, 2.0)}, {_stage(4, "p3")}
select elem_id, {r6("x + 2.0 * (k1.w + 2 * k2.w + 2 * k3.w + k4.w) / 6", "x")}, {r6("y + 2.0 * (k1.u + 2 * k2.u + 2 * k3.u + k4.u) / 6", "y")}
from q join k1 using (elem_id) join k2 using (elem_id) join k3 using (elem_id) join k4 using (elem_id)""")
def advect_points_rk4(spark, sf_dir):
    out = physics.advect_points(part_points(spark, sf_dir), line_field(spark, sf_dir), line_grid(0.0), {"x": "w", "y": "u"}, 2.0, "rk4")
    return rounded(out.select("elem_id", "x", "y"))


@query(f"""with {G_SQL}, near as (select a.ix, a.iy, w, u, ({nb('v', 1, 0, 'edge', 'edge')} - {nb('v', -1, 0, 'edge', 'edge')}) / 2 as dx, ({nb('v', 0, 1, 'edge', 'edge')} - {nb('v', 0, -1, 'edge', 'edge')}) / 2 as dy from g a)
select ix, iy, {r6("-(w * dx + u * dy)", "rate")} from near""")
def advection_rate(spark, sf_dir):
    df = line_field(spark, sf_dir)
    return rounded(physics.advection_rate(df, line_grid("edge"), "v", {"x": "w", "y": "u"}).select("ix", "iy", "rate"))


@query()
def incompressible_projection(spark, sf_dir):
    """A closed lattice of sizes by prices, whose faces have the mean price share of all parts around them, without its divergence."""
    grid = line_grid(0.0)
    faces = stencil.at_faces(part_field(spark, sf_dir), grid, "v")
    return rounded(physics.make_incompressible(faces, grid, 1e-10)[0])
