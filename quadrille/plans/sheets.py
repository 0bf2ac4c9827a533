"""Queries on surfaces: planes of height maps, surfaces of fields, sheets, ranks of curves, transforms by lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..meta import Grid
from ..operators import aggregate, lattice, solve, stencil, surfaces
from ..sources import scene
from .grids import r6
from .more import O_SQL, along, order_lattice
from .tables import G_SQL, P_SQL, line_field, line_grid, plain_points, rounded, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


# --- height maps ------------------------------------------------------------------------------------------

_SQUARES = f"""{G_SQL}, c as (select ix, iy, w as a, lead(w) over (partition by iy order by ix) as b from g),
q as (select *, lead(a) over (partition by ix order by iy) as d, lead(b) over (partition by ix order by iy) as e from c),
s as (select *, (b - a + e - d) / 2 as sx, (d - a + e - b) / 2 as sy, (a + b + d + e) / 4 as cz from q where b is not null and d is not null),
n as (select *, sqrt(1 + sx * sx + sy * sy) as l from s)"""


@query(f"""with {_SQUARES} select ix, iy, {r6('cz', 'cz')}, {r6('-sx / l', 'nx')}, {r6('-sy / l', 'ny')}, {r6('1 / l', 'nz')},
{r6('(sx * (ix + 1) + sy * (iy + 1) - cz) / l', 'offset')}, {r6('least(a, b, d, e)', 'lowest')}, {r6('greatest(a, b, d, e)', 'highest')} from n""")
def height_planes(spark, sf_dir):
    heights = line_field(spark, sf_dir).select("ix", "iy", F.col("w").alias("h"))
    planes = surfaces.height_planes(heights, line_grid("edge"), "z")
    return rounded(planes.select("ix", "iy", "cz", "nx", "ny", "nz", "offset", "lowest", "highest"))


# --- the surface of a field in space ----------------------------------------------------------------------

#: Line items by quantity, discount and tax; a cell is inside if fewer than the mean number are in it.
SPACE = {"x": 50, "y": 11, "z": 9}


def crowding(spark, sf_dir):
    """(ix, iy, iz, d): how many line items there are by quantity, discount and tax, less the mean; both times the number of cells."""
    rows = table(spark, sf_dir, "lineitem")
    found = rows.groupBy(
        (F.col("l_quantity").cast("int") - 1).alias("ix"), F.round(F.col("l_discount") * 100).cast("int").alias("iy"), F.round(F.col("l_tax") * 100).cast("int").alias("iz")
    ).agg(F.count("*").alias("n"))
    total = F.broadcast(rows.agg(F.count("*").alias("m")))  # one row
    grid = Grid.of("edge", **SPACE)
    cells = lattice.lattice(spark, grid).join(found, grid.keys, "left").crossJoin(total)
    return cells.select(*grid.keys, (F.coalesce("n", F.lit(0)) * grid.size - F.col("m")).cast("double").alias("d")), grid


_N = SPACE["x"] * SPACE["y"] * SPACE["z"]
_SPACE_SQL = f"""n as (select cast(l_quantity as int) - 1 as ix, cast(round(100 * l_discount) as int) as iy, cast(round(100 * l_tax) as int) as iz, count(*) as n from lineitem group by 1, 2, 3),
cells as (select i.range as ix, j.range as iy, k.range as iz from range({SPACE['x']}) i, range({SPACE['y']}) j, range({SPACE['z']}) k),
f as (select ix::int as ix, iy::int as iy, iz::int as iz, (coalesce(n, 0) * {_N} - (select count(*) from lineitem))::double as d from cells left join n using (ix, iy, iz)),
e as (select 0 as axis, ix, iy, iz, d as a, lead(d) over (partition by iy, iz order by ix) as b from f
  union all select 1, ix, iy, iz, d, lead(d) over (partition by ix, iz order by iy) from f
  union all select 2, ix, iy, iz, d, lead(d) over (partition by ix, iy order by iz) from f),
x as (select *, a / (a - b) as t from e where b is not null and (a < 0) <> (b < 0))"""


@query(f"""with {_SPACE_SQL},
cuts as (select ix + case when axis = 0 then 0 else -p end as cx, iy + case when axis = 1 then 0 when axis = 0 then -p else -q end as cy,
  iz + case when axis = 2 then 0 else -q end as cz, ix + case when axis = 0 then t else 0 end as x, iy + case when axis = 1 then t else 0 end as y,
  iz + case when axis = 2 then t else 0 end as z from x, (values (0), (1)) u(p), (values (0), (1)) v(q))
select (cx * {SPACE['y']} + cy) * {SPACE['z']} + cz as vid, {r6('avg(x) + 0.5', 'x')}, {r6('avg(y) + 0.5', 'y')}, {r6('avg(z) + 0.5', 'z')} from cuts
where cx between 0 and {SPACE['x'] - 2} and cy between 0 and {SPACE['y'] - 2} and cz between 0 and {SPACE['z'] - 2} group by cx, cy, cz""")
def surface_vertices(spark, sf_dir):
    return rounded(surfaces.surface_net(*crowding(spark, sf_dir)).vertices)


@query(f"""with {_SPACE_SQL} select axis, count(*) * 2 as triangles from x
where (axis = 0 or ix between 1 and {SPACE['x'] - 2}) and (axis = 1 or iy between 1 and {SPACE['y'] - 2}) and (axis = 2 or iz between 1 and {SPACE['z'] - 2}) group by axis""")
def surface_triangles(spark, sf_dir):
    elements = surfaces.surface_net(*crowding(spark, sf_dir)).elements
    axis = F.floor(F.col("eid") % 6 / 2).cast("int")
    return elements.groupBy(axis.alias("axis")).agg(F.count("*").alias("triangles"))


# --- sheets -----------------------------------------------------------------------------------------------

_BENT = [[(0.0, 0.0, 1.0), (0.0, 1.0, 2.0), (0.0, 2.0, 0.0)], [(1.0, 0.0, 3.0), (1.5, 1.0, 0.5), (1.0, 2.0, 1.0)], [(2.0, 0.0, 0.0), (2.0, 1.0, -1.0), (2.0, 2.5, 2.0)]]
BENT = [[dict(zip("xyz", c, strict=True)) for c in row] for row in _BENT]
_B = {"u": ["(1 - u) * (1 - u)", "2 * u * (1 - u)", "u * u"], "v": ["(1 - v) * (1 - v)", "2 * v * (1 - v)", "v * v"]}
_S = {"u": ["2 * u - 2", "2 - 4 * u", "2 * u"], "v": ["2 * v - 2", "2 - 4 * v", "2 * v"]}


def _sum(bu, bv, k: int) -> str:
    return " + ".join(f"({bu[i]}) * ({bv[j]}) * ({_BENT[i][j][k]})" for i in range(3) for j in range(3))


_UV = f"{P_SQL}, uv as (select elem_id, x / 51 as u, least(1.0, y / 1013) as v from p)"
_SHEET = ", ".join(
    [f"{_sum(_B['u'], _B['v'], k)} as {x}" for k, x in enumerate("xyz")]
    + [f"{_sum(_S['u'], _B['v'], k)} as u{x}" for k, x in enumerate("xyz")]
    + [f"{_sum(_B['u'], _S['v'], k)} as v{x}" for k, x in enumerate("xyz")]
)


def _parameters(spark, sf_dir):
    p = plain_points(spark, sf_dir)
    return p.select("elem_id", (F.col("x") / 51).alias("u"), F.least(F.lit(1.0), F.col("y") / 1013).alias("v"))


@query(f"""with {_UV}, s as (select elem_id, {_SHEET} from uv),
n as (select *, uy * vz - uz * vy as a, uz * vx - ux * vz as b, ux * vy - uy * vx as c from s)
select elem_id, {', '.join(r6(x, x) for x in ('x', 'y', 'z', 'ux', 'vz'))}, {', '.join(r6(f'{m} / sqrt(a * a + b * b + c * c)', f'n{x}') for m, x in zip('abc', 'xyz', strict=True))} from n""")
def sheet_surface(spark, sf_dir):
    """A clamped sheet of order 2 with three control points each way is a patch of Bernstein polynomials."""
    rows = surfaces.sheet_surface(_parameters(spark, sf_dir), BENT)
    return rounded(rows.select("elem_id", "x", "y", "z", "ux", "vz", "nx", "ny", "nz"))


@query(f"with {_UV} select elem_id, true as small from uv")
def closest_on_sheet_residual(spark, sf_dir):
    """Points put a little off a sheet along its normals are found at that distance."""
    off = F.when(F.col("elem_id") % 2 == 0, 0.05).otherwise(-0.05)
    at = surfaces.sheet_surface(_parameters(spark, sf_dir), BENT)
    at = at.select("elem_id", off.alias("off"), *[(F.col(x) + off * F.col(f"n{x}")).alias(x) for x in "xyz"])
    found = surfaces.closest_on_sheet(at, BENT, steps=6)
    return found.select("elem_id", (F.abs(F.abs("distance") - 0.05) < 1e-3).alias("small"))


# --- curves and transforms --------------------------------------------------------------------------------


@query(f"""with o as (select o_orderkey, o_totalprice::double as v from orders)
select o_orderkey, {r6("avg(v) over (order by o_orderkey rows between 3 preceding and 2 following) / 1000", "smooth")} from o""")
def smooth_orders(spark, sf_dir):
    """One curve of all orders, by ranges of the order's number."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("v"))
    smoothed = aggregate.smooth(rows, "o_orderkey", "v", 6)
    return rounded(smoothed.select("o_orderkey", (F.col("smooth") / 1000).alias("smooth")))


@query("""with r as (select o_orderkey, row_number() over (order by o_orderkey) as k, count(*) over () as n from orders)
select o_orderkey from r where (k - 1) % 50 = 0 or k = n""")
def down_sample_orders(spark, sf_dir):
    return aggregate.down_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 50)


@query("""with d as (select c_nationkey, c_custkey, (c_custkey % 97)::long as step from customer)
select c_custkey, (sum(step) over (partition by c_nationkey order by c_custkey))::bigint as time from d""")
def cumulative_time_by_nation(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") % 97).cast("long").alias("step"))
    return scene.cumulative_time(rows, "step", "c_custkey", ("c_nationkey",)).select("c_custkey", "time")


@query(f"with {G_SQL} select ix, iy, true as small from g")
def fourier_by_lines_residual(spark, sf_dir):
    """The transform axis by axis, as for lattices beyond one worker: its inverse Laplacian has the field as Laplacian, less the mean."""
    grid = line_grid("periodic")
    v = line_field(spark, sf_dir).select("ix", "iy", "v")
    back = solve.fourier_poisson(v, grid, distributed=True)
    back = solve.fourier_laplace(back, grid, distributed=True).withColumnRenamed("v", "back")
    mean = F.broadcast(v.agg(F.avg("v").alias("m")))  # one row
    both = back.join(v, grid.keys).crossJoin(mean)
    return both.select(*grid.keys, (F.abs(F.col("back") - F.col("v") + F.col("m")) < 1e-8).alias("small"))


# --- one-sided differences, limits ------------------------------------------------------------------------


def _side(axis: str, k: int) -> str:
    one, two = along("v", k, axis, "v"), along("v", 2 * k, axis, f"last{axis}{'u' if k > 0 else 'd'}")
    return f"({-k} * (1.5 * v - 2 * {one} + 0.5 * {two}))"


@query(f"""with {O_SQL}, d as (select ix, iy, v, w, l_x, f_x, l_y, f_y from (select *, last_value(v) over (partition by iy order by ix rows between unbounded preceding and unbounded following) as l_x,
  first_value(v) over (partition by iy order by ix) as f_x, last_value(v) over (partition by ix order by iy rows between unbounded preceding and unbounded following) as l_y,
  first_value(v) over (partition by ix order by iy) as f_y from o)),
e as (select ix, iy, v, w, l_x as lastixu, f_x as lastixd, l_y as lastiyu, f_y as lastiyd from d),
g as (select ix, iy, w, {_side('ix', -1)} as bx, {_side('ix', 1)} as ax, {_side('iy', -1)} as by_, {_side('iy', 1)} as ay from e)
select ix, iy, {r6("case when ix % 3 = 0 then bx when ix % 3 = 1 then (ax + bx) / 2 else ax end", "dx")},
  {r6("case when iy % 2 = 0 then by_ else ay end", "dy")} from g""")
def orders_upwind_gradient(spark, sf_dir):
    """Second order, by a velocity that comes from below, is 0, or from above by turns."""
    df, grid = order_lattice(spark, sf_dir)
    flow = df.select("ix", "iy", "v", (1.0 - F.col("ix") % 3).alias("p"), F.when(F.col("iy") % 2 == 0, 0.5).otherwise(-0.5).alias("q"))
    return rounded(stencil.upwind_gradient(flow, grid, {"x": "p", "y": "q"}, order=2).select("ix", "iy", "dx", "dy"))


@query(f"""with s as (select min(s_acctbal - 0.1) as lx, max(s_acctbal + 0.1) as ux, min(s_suppkey - 0.1) as ly, max(s_suppkey + 0.1) as uy, min(s_suppkey) as my from supplier)
select {r6("((lx + ux) / 2 - (ux - lx) * 0.55)::double", "lower_x")}, {r6("((lx + ux) / 2 + (ux - lx) * 0.55)::double", "upper_x")},
{r6("case when ly > 0 then ly * 0.95 else my * pow(my / uy, 0.1) end::double", "lower_y")}, {r6("(uy * 1.05)::double", "upper_y")} from s""")
def plot_limits(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("x"), F.col("s_suppkey").alias("y"))
    return rounded(aggregate.plot_limits(rows, ("x", "y"), log=("y",)))
